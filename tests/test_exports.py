"""Diagram queries over written tables: what they build, and their lines and rows on dirty input."""

import pytest

from graphloom.graph import Graph
from graphloom.operators import trees
from graphloom.plans import reference_rest as rest
from graphloom.runtime import write_table
from graphloom.sources import export as ex
from graphs import edge, frames, node


@pytest.fixture
def save(spark, tmp_path):
    """Writes nodes, edges and shared ids as tables and gives a function that runs a query over them."""

    def put(nodes, edges):
        for name, df in zip(("nodes", "edges", "shared_nodes"), frames(spark, nodes, edges, ["s"])):
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return Graph(spark, str(tmp_path))

    return put


def _no_hierarchy(monkeypatch):
    """Edge lines need no places of nodes; on large tables these are what fails."""

    def placed(*_):
        raise AssertionError("the hierarchy was built for edge lines")

    monkeypatch.setattr(ex, "placed", placed)


NODES_ = [node("app", "/app"), node("core", "/app/my-core"), node("cli", "/app/cli"), node("x", "/x"), node("y", "/y")]
EDGES_ = [edge("1", "app", "core"), edge("2", "app", "cli"), edge("3", "x", "y"), edge("4", "y", "x"), edge("5", "cli", "core", "depends"), edge("6", "x", "cli", "calls"), edge("7", "cli", "ghost", "calls"), edge("8", "cli", None, "calls")]


def _lines(df):
    return sorted(r["line"] for r in df.collect())


def test_dot_edges_without_hierarchy(save, monkeypatch):
    _no_hierarchy(monkeypatch)
    assert _lines(rest.snk_export_dot_edges(save(NODES_, EDGES_))) == ['    app_cli -> app_my_core [label="depends"];', '    x -> app_cli [label="calls"];']


def test_mermaid_edges_without_hierarchy(save, monkeypatch):
    _no_hierarchy(monkeypatch)
    assert _lines(rest.snk_export_mermaid_edges(save(NODES_, EDGES_))) == ["    app_cli -->|depends| app_my_core", "    x -->|calls| app_cli"]


def test_c4_relations_without_hierarchy(save, monkeypatch):
    """Of two parents both are boundaries, as in the SQL, though only one of them places the child."""
    _no_hierarchy(monkeypatch)
    ns = [*NODES_, node("zoo", "/zoo")]
    es = [*EDGES_, edge("9", "zoo", "core"), edge("10", "zoo", "cli", "calls"), edge("11", "app", "cli", "calls")]
    assert _lines(rest.snk_web_c4(save(ns, es))) == ['    Rel(cli, core, "depends")', '    Rel(cli, ghost, "calls")']


def test_equal_times_are_told_by_metadata(save):
    """Deliveries of one time differ in how their JSON is written; the largest text counts, null last, in any order of rows."""
    texts = ['{"a":1}', '{"a": 1}', None, '{ "a":1}']
    ns = [(*node(f" N{k % 40}", "/a")[:9], texts[(k // 40 + k) % 4], *node("", "/a")[10:]) for k in range(160)]
    es = [(*edge(f"E{k % 40} ", "a", "b")[:5], texts[(k // 40 + k) % 4], *edge("", "a", "b")[6:]) for k in range(160)]
    g = save(ns, es)
    for df in (g.nodes, g.edges):
        assert sorted((r["id"][0], r["metadata"] or "") for r in df.collect()) == [(df.first()["id"][0], max(x for x in texts if x))] * 40


MERMAID = ["flowchart TD", '    subgraph app["/app"]', '        subgraph app_cli["/app/cli"]', '            app_cli_deep["/app/cli/deep"]', "        end", '        app_my_core["/app/my-core"]', "    end", "    app_cli -->|depends| app_my_core"]


def _drawn(save, monkeypatch, query):
    """The lines of a diagram of trees of three levels beside a cycle of eight nodes, and the longest list that was written for it."""
    sizes = []

    def write(df, name):
        out = write_table(df, name)
        if "line" in out.columns:
            sizes.append(out.selectExpr("max(size(line))").first()[0] or 0)
        return out

    monkeypatch.setattr(trees, "write_table", write)
    ring = [node(f"r{i}") for i in range(8)]
    turn = [edge(f"t{i}", f"r{i}", f"r{(i + 1) % 8}") for i in range(8)]
    df = query(save([*NODES_[:3], node("deep", "/app/cli/deep"), *ring], [*EDGES_[:2], EDGES_[4], edge("d", "cli", "deep"), *turn]))
    return [r["line"] for r in df.collect()], max(sizes)


def test_flowchart_lists_do_not_grow_round_cycles(save, monkeypatch):
    lines, longest = _drawn(save, monkeypatch, rest.snk_web_flowchart)
    assert lines == MERMAID and longest <= 3


def test_mermaid_lists_do_not_grow_round_cycles(save, monkeypatch):
    lines, longest = _drawn(save, monkeypatch, rest.snk_export_mermaid)
    assert lines == MERMAID and longest <= 3


def test_dot_lists_do_not_grow_round_cycles(save, monkeypatch):
    lines, longest = _drawn(save, monkeypatch, rest.snk_export_dot)
    assert longest <= 3 and lines[3:] == [
        "    subgraph cluster_app {", '        label="/app";', "        subgraph cluster_app_cli {", '            label="/app/cli";', '            app_cli_deep [label="/app/cli/deep"];', "        }",
        '        app_my_core [label="/app/my-core"];', "    }", '    app_cli -> app_my_core [label="depends"];', "}",
    ]
