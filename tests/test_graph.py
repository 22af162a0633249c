"""Graph operators on small scenarios with results written by hand, and properties."""

import random

import pytest
from graphs import EDGES, NODES, edge, node
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as fx
from graphloom.graph import SNAP
from graphloom.operators import aggregates as ag
from graphloom.operators import conformance as cf
from graphloom.operators import lookups as lk
from graphloom.operators import relations as rl
from graphloom.operators import traversal as tv
from graphloom.operators import trees as tr

LAYERED = ["api", "service", "repository", "database"]


@pytest.fixture(scope="module")
def layered(spark):
    """/app holds four layers, each depends on the next; api also holds a handler that calls the service."""
    ns = [node("app", "/app", kind="system"), *[node(x, f"/app/{x}", kind="component") for x in LAYERED], node("h", "/app/api/handler")]
    es = [edge(f"c{x}", "app", x) for x in LAYERED] + [edge("ch", "api", "h")]
    es += [edge(f"d{a}", a, b, "depends") for a, b in zip(LAYERED, LAYERED[1:])] + [edge("k", "h", "service", "calls")]
    return spark.createDataFrame(ns, NODES).cache(), spark.createDataFrame(es, EDGES).cache()


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_traversal(layered):
    n, e = layered
    c = tv.closure(tv.parent_edges(e, n))
    assert got(c.filter("node = 'h'"), "ancestor", "dist") == [("api", 1), ("app", 2)]
    start = n.filter("id = 'api'").select(*SNAP, "id")
    assert got(tv.reachable(e, start), "node", "dist") == [("database", 3), ("repository", 2), ("service", 1)]
    assert got(tv.reachable(e, n.filter("id = 'database'").select(*SNAP, "id"), reverse=True), "node") == [("api",), ("repository",), ("service",)]
    links = tr.parent_table(n, e)
    assert got(tr.top_modules(links).filter("node = 'h'"), "top") == [("api",)]
    assert got(tr.chains(links).filter("node = 'h'").select(F.array_join("line", "/").alias("line")), "line") == [("app/api/h",)]
    assert tv.cyclic_core(e, "depends").count() == 0
    ends = start.select(*SNAP, F.lit("h").alias("a"), F.lit("database").alias("b"))
    assert got(tr.tree_paths(links, ends), "path") == [("h/api/app/database",)]
    assert got(tv.simple_paths(e, start, 2), "path") == [("api/service",), ("api/service/repository",)]


def test_visible_and_meta_edges(layered):
    n, e = layered
    shown = tr.visible(tr.parent_table(n, e), n.filter("id = 'app'").select(*SNAP, "id"))
    assert got(shown.filter("node in ('h', 'api', 'app')"), "node", "shown") == [("api", "api"), ("app", "app"), ("h", "api")]
    assert got(ag.meta_edges(e, shown).filter("is_meta"), "src", "tgt", "kind", "n") == [("api", "service", "calls", 1)]
    assert got(ag.hierarchical_matrix(e, shown).filter("src = 'api'"), "tgt", "n", "is_cyclic", "is_dark") == [("service", 2, False, True)]


def test_roots_and_counts(layered):
    n, e = layered
    found = got(ag.roots(n, e), "category", "node_id")
    assert ("containment_roots", "app") in found and ("call_tree_roots", "h") in found and ("leaf_sinks", "database") in found
    c = tr.parent_table(n, e)
    assert got(ag.count_descendants(c).filter("id in ('app', 'api', 'h')"), "id", "n_descendants") == [("api", 1), ("app", 5), ("h", 0)]
    assert got(ag.hierarchy_sum(n, c, F.lit(0.0)).filter("id = 'app'"), "total") == [(4.0,)]
    assert got(ag.fan_counts(n, e).filter("id = 'service'"), "fan_in", "fan_out") == [(2, 1)]


def test_lookups(layered):
    n, e = layered
    assert got(lk.search(n, "/app/**"), "id") == sorted([("api",), ("database",), ("h",), ("repository",), ("service",), ("app",)])
    assert got(lk.search(n, "/app/*"), "id") == [("api",), ("database",), ("repository",), ("service",)]
    with pytest.raises(ValueError):
        lk.search(n, "")
    assert got(lk.edges_of(e, "service", "both"), "id") == [("cservice",), ("dapi",), ("dservice",), ("k",)]
    kept, inside = lk.view_filter(n, e, tr.parent_table(n, e), F.col("id") == "h", ["calls"])
    assert got(kept, "id") == [("api",), ("app",), ("h",)] and got(inside, "id") == [("capi",), ("ch",)]


def test_conformance(layered):
    n, e = layered
    snaps = n.select(*SNAP).distinct()
    rules = [
        cf.Constraint("up", "must_not_depend", "/app/repository/**", "/app/api/**"),
        cf.Constraint("down", "must_not_depend", "/app/api/**", "/app/service/**", severity="warning"),
        cf.Constraint("none", "must_not_depend", "/app/**"),
        cf.Constraint("edge of db", "boundary", "/app/database/**"),
        cf.Constraint("has h", "must_contain", "/app/api", params={"child_pattern": "h", "child_kind": "unit"}),
        cf.Constraint("lost", "must_contain", "/nowhere", params={"child_pattern": "h"}),
        cf.Constraint("fan", "max_fan_in", "/app/service", params={"limit": 0}, message="fan"),
        cf.Constraint("odd", "layer_order", "/**", params={"layers": LAYERED}),
    ]
    res = {r["constraint"]: (r["status"], r["n_violations"], r["message"]) for r in cf.evaluate(n, e, snaps, rules).collect()}
    assert [res[k][0] for k in ("up", "down", "none", "edge of db", "has h", "lost", "fan", "odd")] == ["pass", "fail", "pass", "fail", "pass", "not_evaluable", "fail", "not_evaluable"]
    assert res["fan"][2] == "fan (fan-in: 1, limit: 0)" and "not found" in res["lost"][2]
    s = cf.summary(cf.evaluate(n, e, snaps, rules)).first()
    assert (s["passed"], s["failed"], s["warned"], s["not_evaluable"]) == (3, 2, 1, 2)
    assert cf.exit_code(cf.evaluate(n, e, snaps, rules[1:2])).first()["exit_code"] == 0
    assert cf.exit_code(cf.evaluate(n, e, snaps, rules[1:2]), "warning").first()["exit_code"] == 1
    assert cf.violations(n, e, [cf.Constraint("l", "layer_order", "/**", params={"layers": LAYERED[::-1]})], extended=True).count() == 3
    assert cf.violations(n, e, [cf.Constraint("o", "must_only_depend", "/app/api/**", params={"targets": ["/app/service"]})], extended=True).count() == 0
    with pytest.raises(ValueError):
        cf.exit_code(cf.evaluate(n, e, snaps, rules[:1]), "fatal")


def test_integrity_and_phantoms(spark, layered):
    n, e = layered
    lost = spark.createDataFrame([edge("x", "ghost", "api"), edge("y", "api", "gone", "depends"), edge("z", "n1", "n2", "calls")], EDGES)
    none = spark.createDataFrame([], "id string")
    assert got(rl.missing_ends(e.union(lost), n, none), "edge_id", "endpoint") == [("x", "source"), ("y", "target"), ("z", "source"), ("z", "target")]
    assert got(rl.phantom_parents(e.union(lost), n), "id", "canonical_path", "label") == [("ghost", "/app", "app")]


def test_scalar_functions(spark):
    import uuid

    cases = {"FooBar": "foo-bar", "HTTPServer": "http-server", "snake_case": "snake-case", "_lead": "lead", "a1B": "a1b", "already-kebab": "already-kebab", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r[0]: r[1] for r in df.select("s", fx.kebab(F.col("s"))).collect()} == cases
    paths = {"/a/b-c": None, "a/b": "missing_leading_slash", "/a/": "trailing_slash", "/": "empty_segment", "/a//b": "empty_segment", "/A": "invalid_segment", "/a\n": "invalid_segment"}
    df = spark.createDataFrame([(k,) for k in paths], "s string")
    assert {r[0]: r[1] for r in df.select("s", fx.path_error(F.col("s"))).collect()} == paths
    df = spark.createDataFrame([("/a/b",), ("é",)], "s string")
    assert all(r[1] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r[0])) for r in df.select("s", fx.uuid5(F.col("s"))).collect())
    types = {"Option<Vec<app::Row>>": "app::Row", "&mut Result<app::A, Error>": "app::A", "HashMap<K, V>": "HashMap<K, V>", "Arc<Mutex<X>>": "Mutex<X>"}
    df = spark.createDataFrame([(k,) for k in types], "s string")
    assert {r[0]: r[1] for r in df.select("s", fx.unwrap_type(F.col("s"))).collect()} == types


GLOBS = [("/a/*", "/a/b", True), ("/a/*", "/a/b/c", False), ("/a/**", "/a/b/c", True), ("/a/**", "/a", True), ("/a/**/z", "/a/z", True), ("/a/?", "/a/b", True), ("/a/{b,c}", "/a/c", True), ("/a/[!b]", "/a/b", False), ("/a.b", "/axb", False), ("", "/a", False)]


def test_globs(spark):
    for pattern, path, want in GLOBS:
        assert spark.createDataFrame([(path,)], "s string").select(fx.glob_match(F.col("s"), pattern)).first()[0] is want, (pattern, path)


def _random_links(seed, n=40):
    """A forest with some cycles: node -> parent or None."""
    rng = random.Random(seed)
    up = {f"n{i}": None if rng.random() < 0.12 else f"n{rng.randrange(i)}" if i and rng.random() < 0.85 else f"n{rng.randrange(n)}" for i in range(n)}
    return up


@pytest.mark.parametrize("seed", [1])
def test_trees_against_brute_force(spark, seed):
    """Depths, holders, scopes, sums and paths of random forests with cycles, walked node by node."""
    up = _random_links(seed)
    links = spark.createDataFrame([("p", 1, k, v) for k, v in up.items()], "project_id string, version long, node string, parent string")

    def line(x):
        out = [x]
        while up[out[-1]] is not None and up[out[-1]] not in out:
            out.append(up[out[-1]])
        return out, up[out[-1]] is None

    trees = {x for x in up if line(x)[1]}
    marks = {x for x in up if int(x[1:]) % 5 == 0}
    marked = spark.createDataFrame([("p", 1, m) for m in marks], "project_id string, version long, id string")
    assert got(tr.depths(links), "node", "depth") == sorted((x, len(line(x)[0]) - 1) for x in trees)
    first = {x: next((a for a in line(x)[0] if a in marks), None) for x in up}
    assert got(tr.holders(links, marked), "node", "holder") == sorted((x, h) for x, h in first.items() if h and (x in trees or h == x))
    assert got(tr.below(links, marked), "id", "dist") == sorted((x, line(x)[0].index(h)) for x, h in first.items() if h)
    assert got(tr.above(links, marked), "id") == sorted({(a,) for m in marks for a in line(m)[0]})
    assert got(tr.cycle_members(links), "id") == sorted({(line(x)[0][-1],) for x in up if x not in trees} | {(a,) for x in up if x not in trees for a in line(x)[0][line(x)[0].index(up[line(x)[0][-1]]) :]})
    assert got(ag.count_descendants(links), "id", "n_descendants") == sorted((x, sum(x in line(y)[0] for y in trees) - 1 if x in trees else 0) for x in up)
    shown = {x: next((a for a in reversed(line(x)[0]) if a not in marks), x) if x in trees else x for x in up}
    assert got(tr.visible(links, marked), "node", "shown") == sorted(shown.items())
    assert got(tr.top_modules(links), "node", "top") == sorted((x, line(x)[0][-2]) for x in trees if len(line(x)[0]) > 1)
    some = spark.createDataFrame([("p", 1, x) for x in sorted(up)[:6]], "project_id string, version long, id string")
    want = set()
    for x in sorted(up)[:6]:
        seen, at, d = {}, up[x], 1
        while at is not None and at not in seen:
            seen[at], at, d = d, up[at], d + 1
        want |= {(x, a, k) for a, k in seen.items()}
    assert got(tr.ancestors(links, some), "node", "ancestor", "dist") == sorted(want)


@pytest.mark.parametrize("seed", [1])
def test_nodes_on_cycles_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(17)}
    es = [edge(f"{a}{b}", a, b, "depends") for a, b in pairs]
    reach = {(a, b) for a, b in pairs}
    for _ in range(14):
        reach |= {(a, d) for a, b in reach for c, d in pairs if b == c}
    assert got(tv.nodes_on_cycles(spark.createDataFrame(es, EDGES), "depends"), "id") == sorted({(a,) for a, b in reach if a == b})


def test_types_at_any_depth(spark):
    deep = "Option<" * 9 + "a::B<C<D<E<F>>>, G>" + ">" * 9
    rows = [("&mut Vec<Option<a::B>>", "a::B"), (deep, "a::B<C<D<E<F>>>, G>"), ("std::result::Result<Vec<a::T>, E>", "a::T"), ("a::B", "a::B")]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(fx.unwrap_type(F.col("t"))).collect()] == [b for _, b in rows]
    firsts = spark.createDataFrame([("M<A<B<C<D<E>>>>, F>",), ("usize",)], "t string").select(fx.first_type_argument(F.col("t"))).collect()
    assert [r[0] for r in firsts] == ["A<B<C<D<E>>>>", None]


def test_flow_view_closes_large_snapshots(spark):
    """Up to 200 nodes all are shown; above, containers are closed."""
    for n, seen in ((150, 150), (250, 2)):
        ns = [node("r", "/r", kind="service"), node("c", "/r/c", kind="component"), *[node(f"u{i}", f"/r/c/u{i}", kind="unit") for i in range(n - 2)]]
        es = [edge("rc", "r", "c"), *[edge(f"e{i}", "c", f"u{i}") for i in range(n - 2)]]
        nodes, edges = spark.createDataFrame(ns, NODES), spark.createDataFrame(es, EDGES)
        assert ag.flow_view(nodes, tr.parent_table(nodes, edges)).select("shown").distinct().count() == seen


def test_scores_and_pairs(spark):
    mapping = spark.createDataFrame([("p", 1, "c", "/a"), ("p", 1, "c", "/b"), ("p", 1, "empty", None)], "project_id string, version long, component string, path string")
    v = spark.createDataFrame([("p", 1, "/a")], "project_id string, version long, source_path string")
    assert got(cf.scores(mapping, v), "component", "n_violations", "score") == [("c", 1, 0.5), ("empty", 0, 0.0)]
    by = ["k"]
    design = spark.createDataFrame([(1, "/a"), (1, "/a/b"), (1, "/gone")], "k int, canonical_path string")
    analysis = spark.createDataFrame([(1, "/a"), (1, "/a/b/c"), (1, "/new"), (1, "/new/too/deep")], "k int, canonical_path string")
    results = spark.createDataFrame([("p", 2, "rule", "error", "fail", "no", 3)], "project_id string, version long, constraint string, severity string, status string, message string, n_violations long")
    pairs = spark.createDataFrame([(1, "p", 2)], "k int, project_id string, version long")
    assert got(cf.evaluate_pairs(design, analysis, results, pairs, by), "constraint", "status", "n_violations") == [("rule", "fail", 3), ("undocumented", "listed", 1), ("unimplemented", "listed", 1)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14))
def test_closure_is_reachability(spark, links):
    """Direct pairs are in the closure, the closure is closed, and distances are shortest."""
    df = spark.createDataFrame([("p", 1, f"{a}", f"{b}") for a, b in links], "project_id string, version long, node string, parent string")
    have = {(r["node"], r["ancestor"]): r["dist"] for r in tv.closure(df).collect()}
    want = {}
    for s in {f"{a}" for a, _ in links}:
        front, d = {s}, 0
        while front:
            d += 1
            front = {f"{b}" for a, b in links if f"{a}" in front} - {x for (y, x) in want if y == s}
            want |= {(s, x): d for x in front}
    assert have == want


def test_snapshot_view(layered):
    from graphloom.api import SnapshotView, filters_active, toggled, with_single_root

    n, e = layered
    v = SnapshotView(n, e)
    assert got(v.children("app"), "other_id") == [("api",), ("database",), ("repository",), ("service",)]
    assert got(v.parent("h"), "other_id") == [("api",)] and got(v.ancestors("h"), "ancestor") == [("api",), ("app",)]
    assert got(v.descendants("app", kind="unit"), "id") == [("h",)]
    assert got(v.dependencies("api"), "target") == [("service",)] and v.dependencies("api", transitive=True).count() == 3
    assert got(v.dependents("service"), "source") == [("api",)] and got(v.node("h"), "canonical_path") == [("/app/api/handler",)]
    nodes, meta = v.view("/app", n.filter("id = 'app'").select(*SNAP, "id"), edge_kinds=["calls"])
    assert got(nodes, "id") == [("api",), ("app",), ("database",), ("repository",), ("service",)] and got(meta, "src", "tgt", "n") == [("api", "service", 1)]
    flat = v.graph()[0].withColumn("parent", F.when(F.col("id") != "h", F.lit(None)).otherwise(F.col("parent")))
    assert ("__root__", None) in {tuple(r) for r in with_single_root(flat).select("id", "parent").collect()}
    assert toggled({1}, 1) == set() and not filters_active({"k": {1}}, {"k": {1}}) and filters_active({}, {"k": {1}})


def test_reachable_has_no_bound_of_its_own(spark):
    """Every node of a chain is reached, over several tables of rounds, and a cycle at its end does not keep the rounds going."""
    import inspect

    assert inspect.signature(tv.reachable).parameters["most"].default is None
    schema = "project_id string, version long, source string, target string, kind string"
    e = spark.createDataFrame([("p", 1, f"n{i}", f"n{i + 1}", "depends") for i in range(8)] + [("p", 1, "n8", "n6", "depends")], schema)
    start = spark.createDataFrame([("p", 1, "n0")], "project_id string, version long, id string")
    fold, tv.FOLD = tv.FOLD, 3
    try:
        assert sorted((r["node"], r["dist"]) for r in tv.reachable(e, start).collect()) == [(f"n{i}", i) for i in range(1, 9)]
        assert {r["dist"] for r in tv.reachable(e, start, most=5).collect()} == {1, 2, 3, 4, 5}
    finally:
        tv.FOLD = fold
