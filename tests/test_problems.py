"""The general data problems against brute force, and their defined results on odd input."""

import pytest
from graphs import EDGES, NODES, SHARED, at, changes, edge, frames, hierarchy, latest, node, norm, orphans, random_tables
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.operators import hierarchy as hi
from graphloom.operators import hotkeys as hk
from graphloom.operators import orphans as op
from graphloom.operators import snapshot_changes as sc
from graphloom.tables import norm_id, pack_id, unpack_id


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


P2 = ("project_id", "version", "edge_id", "endpoint", "reason")
P3 = ("project_id", "from_version", "to_version", "item", "source_path", "target_path", "edge_kind", "change")
P6 = ("project_id", "version", "node_id", "root_id", "depth")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sc, "CHUNK_ROWS", 4)
    monkeypatch.setattr(hi, "SPLIT_EVERY", 3)
    ns, es, sh = random_tables(seed)
    n, e, s = frames(spark, ns, es, sh)
    assert rows(op.orphan_references(e, n, s), *P2) == orphans(ns, es, sh)
    assert rows(sc.snapshot_changes(n, e, s), *P3) == changes(ns, es, sh)
    assert rows(hi.node_depths(n, e), *P6) == hierarchy(ns, es)
    want = {}
    for x in latest(es).values():
        if x[3] == "depends":
            for i, ref in enumerate((norm(x[2]), norm(x[1]))):
                if ref:
                    want.setdefault(ref, [0, 0])[i] += 1
    assert {r[0]: [r[1], r[2]] for r in hk.depends_degrees(e).select("node_id", "depends_in", "depends_out").collect()} == want


def test_extra_columns_repeats_and_clashing_names(spark):
    ns, es, sh = random_tables(3, n=12, versions=2)
    n, e, s = frames(spark, ns, es, sh)
    plain = [rows(op.orphan_references(e, n, s), *P2), rows(sc.snapshot_changes(n, e, s), *P3), rows(hi.node_depths(n, e), *P6)]
    more = {c: F.lit("x") for c in ("ref", "edge", "src", "tgt", "node", "cur", "delta", "chunk", "at", "path", "h", "_old", "_salt", "count")}
    n2, e2, s2 = (d.union(d).withColumns(more) for d in (n, e, s))
    assert plain == [rows(op.orphan_references(e2, n2, s2), *P2), rows(sc.snapshot_changes(n2, e2, s2), *P3), rows(hi.node_depths(n2, e2), *P6)]


def test_empty_tables(spark):
    n, e, s = (spark.createDataFrame([], x) for x in (NODES, EDGES, SHARED))
    for df in (op.orphan_references(e, n, s), sc.snapshot_changes(n, e, s), hk.heavy_targets(e), hi.node_depths(n, e), hi.node_paths(n, e), hi.descendants(n, e)):
        assert df.count() == 0
    ns = [node("a"), node("b", version=2)]
    n, _, _ = frames(spark, ns, [])
    assert rows(sc.snapshot_changes(n, e, s), *P3) == {("p", 1, 2, "node", "/a", "", "", "removed"), ("p", 1, 2, "node", "/b", "", "", "added")}
    assert rows(hi.node_depths(n, e), *P6) == {("p", 1, "a", "a", 0), ("p", 2, "b", "b", 0)}


def test_nulls_in_every_column(spark):
    full_n, full_e = node("a"), edge("e", "a", "b")
    ns = [full_n, node("b"), *[(*full_n[:i], None, *full_n[i + 1 :]) for i in range(len(full_n))]]
    es = [full_e, *[(*full_e[:i], None, *full_e[i + 1 :]) for i in range(len(full_e))]]
    n, e, s = frames(spark, ns, es, ["s"])
    for df in (op.orphan_references(e, n, s), sc.snapshot_changes(n, e, s), hk.depends_degrees(e), hi.node_depths(n, e), hi.node_paths(n, e)):
        df.collect()
    assert ("p", 1, "a", "a", 0) in rows(hi.node_depths(n, e), *P6)


def test_reasons(spark):
    ns = [node("a", minute=0), node("late", minute=99), node("gone", version=1), node("a", version=2), node("next", version=3), node("a", version=3)]
    es = [edge("e1", "a", "late", version=1), edge("e2", "a", "gone", version=2), edge("e3", "a", "next", version=2), edge("e4", "a", "never", version=2), edge("e5", None, " ", version=2), edge("e6", "a", "S", version=2)]
    n, e, s = frames(spark, ns, es, ["s"])
    got = rows(op.orphan_references(e, n, s), "edge_id", "endpoint", "reason")
    assert got == {("e1", "target", "late"), ("e2", "target", "deleted"), ("e3", "target", "late"), ("e4", "target", "missing")}
    rates = rows(op.orphan_rates(op.orphan_references(e, n, s)), "table_name", "month", "endpoint", "reason", "n")
    assert ("edges", "2024-01", "target", "late", 2) in rates


def test_counts_can_be_merged(spark):
    ns, es, sh = random_tables(4, n=10, versions=2)
    n, e, _ = frames(spark, ns, es, sh)
    whole = op.reference_counts(e, n)
    empty_n, empty_e = spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)
    parts = op.merge_counts(op.reference_counts(e, empty_n), op.reference_counts(empty_e, n))
    assert rows(whole, *whole.columns) == rows(parts, *whole.columns)


def test_corrected_delivery_moves_the_reference(spark):
    n, e, s = frames(spark, [node("a")], [edge("e", "a", "ghost", minute=1), edge(" E ", "a", "a", minute=2)])
    assert rows(op.orphan_references(e, n, s), *P2) == set()
    counts = {r["ref"]: r["refs"] for r in op.reference_counts(e, n).withColumn("ref", unpack_id(F.col("ref"))).collect()}
    assert counts == {"ghost": 0, "a": 2}


def test_long_chain_cycles_and_several_parents(spark):
    ns = [node(f"c{i}") for i in range(150)] + [node(x) for x in ("self", "x", "y", "below", "kid", "pa", "pb")]
    es = [edge(f"e{i}", f"c{i}", f"c{i + 1}") for i in range(149)]
    es += [edge("s", "self", "self"), edge("xy", "x", "y"), edge("yx", "y", "x"), edge("yb", "y", "below"), edge("k1", "pb", "kid"), edge("k2", "pa", "kid")]
    n, e, _ = frames(spark, ns, es)
    got = {r[0]: (r[1], r[2]) for r in hi.node_depths(n, e).select("node_id", "root_id", "depth").collect()}
    assert all(got[f"c{i}"] == ("c0", i) for i in range(150))
    assert {got[x] for x in ("self", "x", "y", "below")} == {("", -1)} and got["kid"] == ("pa", 1)
    path = {r[0]: r[1] for r in hi.node_paths(n, e).select("node_id", "path").collect()}
    assert path["c3"] == "c0/c1/c2/c3" and path["x"] == "" and path["pa"] == "pa"
    below = rows(hi.descendants(n, e).filter("node_id = 'c147'"), "descendant_id", "distance")
    assert below == {("c148", 1), ("c149", 2)}


@pytest.mark.parametrize("every", [1, 10**9])
def test_all_or_no_splitters(spark, every, monkeypatch):
    monkeypatch.setattr(hi, "SPLIT_EVERY", every)
    ns, es, _ = random_tables(5, n=15, versions=1)
    n, e, _ = frames(spark, ns, es)
    assert rows(hi.node_depths(n, e), *P6) == hierarchy(ns, es)


def test_packed_ids_round_trip(spark):
    ids = ["7a43298e-c016-522d-b51e-2e7306b98a43", "x", "é" * 9, "a" * 15, "a" * 16, "a" * 17, "7a43298e-c016-522d-b51e", "7A43298E-C016-522D-B51E-2E7306B98A43", " \t", None]
    df = spark.createDataFrame([(i,) for i in ids], "i string").select("i", norm_id(F.col("i")).alias("n")).withColumn("p", pack_id(F.col("n"))).withColumn("u", unpack_id(F.col("p")))
    got = df.collect()
    assert all(r["u"] == r["n"] for r in got)
    assert len({bytes(r["p"]) for r in got if r["p"] is not None}) == len({r["n"] for r in got if r["n"] is not None})


def test_salted_join_keeps_all_rows(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    right = spark.range(990).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = runtime.hot_hashes(left, ["k"], at_least=100)
    assert len(hot) == 1
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = runtime.salted_join(left, right, ["k"], how, F.col("row"), hot)
        assert sorted(map(tuple, a.select(*sorted(a.columns)).collect()), key=str) == sorted(map(tuple, (b := left.join(right, "k", how)).select(*sorted(b.columns)).collect()), key=str)


class _Session:
    """Just what shared_dir asks of a session."""

    def __init__(self, folder, master="spark://x"):
        self.conf, self.sparkContext = self, self
        self.folder, self.master = folder, master

    def get(self, key, default):
        assert key == "spark.checkpoint.dir"
        return self.folder or default


def test_shared_dir_is_read_from_the_session():
    assert runtime.shared_dir(_Session("file:///shared")) == "file:///shared"
    with pytest.raises(RuntimeError):
        runtime.shared_dir(_Session(None))
    assert runtime.shared_dir(_Session(None, "local[2]"))


def test_time_is_only_of_the_node(spark):
    n, e, s = frames(spark, [node("a", minute=5), node("a", minute=50)], [edge("e", "a", "a", minute=5)])
    assert rows(op.orphan_references(e, n, s), *P2) == set()
    assert at(5) == n.agg(F.min("loaded_at")).first()[0]
