"""The command line, the configuration and the streams."""

import json

import pytest
from graphs import edge, node

from graphloom import config
from graphloom.__main__ import main
from graphloom.sources.store import Store
from graphloom.streaming.ingest import OrphanCounts, stream_into_store, stream_orphans

DOC = """
format: graph/v1
kind: design
nodes:
  - canonical_path: /app
    kind: system
    children:
      - {canonical_path: /app/cli, kind: service}
      - {canonical_path: /app/core, kind: service}
edges:
  - {source: /app/core, target: /app/cli, kind: depends}
constraints:
  - {name: low, kind: must_not_depend, scope: /app/core/**, target: /app/cli/**, message: core is low}
"""


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "d.yaml").write_text(DOC)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    g()\n\ndef g(): ...\n")
    at = ["--store", str(tmp_path / "store"), "--project", "demo"]
    assert main([*at, "init"]) == 0 and main([*at, "import", str(tmp_path / "d.yaml")]) == 0
    assert main([*at, "check"]) == 1
    assert main([*at, "analyze", str(tmp_path / "src")]) == 0
    assert main([*at, "check", "--analysis"]) == 0
    capsys.readouterr()
    assert main([*at, "export", "--version", "1"]) == 0
    assert "app_core -->|depends| app_cli" in capsys.readouterr().out
    assert main([*at, "export", "--format", "json", "--version", "1"]) == 0
    assert {n["canonical_path"] for n in json.loads(capsys.readouterr().out)["nodes"]} == {"/app", "/app/cli", "/app/core"}
    assert main([*at, "diff", "1", "2"]) == 0
    assert "removed /app" in capsys.readouterr().out
    assert main([*at, "roots", "--version", "1"]) == 0 and "containment_roots /app" in capsys.readouterr().out
    assert main([*at, "info"]) == 0 and main([*at, "push", str(tmp_path / "out")]) == 0 and main([*at, "compact"]) == 0 and main([*at, "reset"]) == 2 and main([*at, "reset", "--force"]) == 0


def test_config(tmp_path):
    c = config.load("project: demo\ndesign: d.yaml\nsources: [src]\n", str(tmp_path))
    assert (c.project, c.design, c.sources) == ("demo", ["d.yaml"], ["src"])
    for bad in ("project: Demo", "project: demo\ndesign: d.txt", "project: demo\nsources: [../x]", "project: demo\nmore: 1", "[", "- 1"):
        with pytest.raises(config.ConfigError):
            config.load(bad, str(tmp_path))


def test_streams(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"id": "a", "canonical_path": "/a", "project_id": "p", "version": 1}\n{"id": "b", "canonical_path": "/b", "project_id": "p", "version": 2}\n')
    s = Store(spark, str(tmp_path / "store"))
    stream_into_store(s, "nodes", str(inbox), str(tmp_path / "cp")).awaitTermination()
    (inbox / "2.json").write_text('{"id": "a", "canonical_path": "/a2", "project_id": "p", "version": 1}\n')
    stream_into_store(s, "nodes", str(inbox), str(tmp_path / "cp")).awaitTermination()
    assert {(r["id"], r["version"], r["canonical_path"]) for r in s.read("nodes").collect()} == {("a", 1, "/a2"), ("b", 2, "/b")}

    nodes = spark.createDataFrame([node("a")], "id string, canonical_path string, qualified_name string, kind string, sub_kind string, name string, language string, provenance string, source_ref string, metadata string, project_id string, version long, loaded_at timestamp")
    counts = OrphanCounts(spark, str(tmp_path / "counts"))
    box = tmp_path / "edges"
    box.mkdir()
    later = tmp_path / "nodes"
    later.mkdir()
    fields = ("id", "source", "target", "kind", "provenance", "metadata", "project_id", "version", "loaded_at")
    for k, e in enumerate([edge("1", "a", "ghost"), edge("2", "a", "ghost"), edge("3", "a", "a")]):
        (box / f"{k}.json").write_text(json.dumps(dict(zip(fields, (*e[:-1], e[-1].isoformat()), strict=True))) + "\n")
        stream_orphans(counts, str(box), str(tmp_path / "cp2"), nodes, node_folder=str(later)).awaitTermination()
    assert [tuple(r) for r in counts.orphans(2).collect()] == [("p", 1, "ghost", 2)]
    # A node that arrives later clears the orphan.
    (later / "n.json").write_text(json.dumps({"id": "ghost", "canonical_path": "/g", "kind": "unit", "project_id": "p", "version": 1, "loaded_at": "2024-01-02T00:00:00"}) + "\n")
    stream_orphans(counts, str(box), str(tmp_path / "cp2"), nodes, node_folder=str(later)).awaitTermination()
    assert counts.orphans(3).count() == 0
