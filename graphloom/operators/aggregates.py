"""Counts, degree classes, roll-ups, matrices and hierarchy sums over all snapshots at once.

Every aggregation is of fixed-width states, so it combines on the map side before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import SNAP, of_kind
from graphloom.operators.trees import acyclic, below, gather, holders, top_modules, visible


def count_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.groupBy(*SNAP).agg(F.count(F.lit(1)).alias(name))


def store_info(snapshots: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project_id, version, kind, n_nodes, n_edges, n_snapshots (of the project)."""
    counted = snapshots.select(*SNAP, "kind").join(count_rows(nodes, "n_nodes"), SNAP, "left").join(count_rows(edges, "n_edges"), SNAP, "left").fillna(0, ["n_nodes", "n_edges"])
    per = snapshots.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_snapshots"))
    return counted.join(per, "project_id")


def degree_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNAP, id, calls_in, calls_out, depends_in, depends_out, is_contained, has_in, has_out of every node, in one pass over the edges."""
    def state(end: str, incoming: bool) -> Column:
        def one(c: Column) -> Column:
            return c.cast("long")

        k, no = F.col("kind"), F.lit(0).cast("long")
        return F.struct(
            F.col(end).alias("id"),
            *[(one(k == kind) if incoming == (side == "in") else no).alias(f"{kind}_{side}") for kind in ("calls", "depends") for side in ("in", "out")],
            (one(k == "contains") if incoming else no).alias("held"),
            F.lit(1 if incoming else 0).cast("long").alias("ins"),
            F.lit(0 if incoming else 1).cast("long").alias("outs"),
        )

    s = edges.select(*SNAP, F.explode(F.array(state("target", True), state("source", False))).alias("s")).select(*SNAP, "s.*").filter("id is not null")
    columns = ["calls_in", "calls_out", "depends_in", "depends_out", "held", "ins", "outs"]
    d = s.groupBy(*SNAP, "id").agg(*[F.sum(c).alias(c) for c in columns])
    d = nodes.select(*SNAP, "id").join(d, [*SNAP, "id"], "left").fillna(0, columns)
    return d.select(*SNAP, "id", *columns[:4], (F.col("held") > 0).alias("is_contained"), (F.col("ins") > 0).alias("has_in"), (F.col("outs") > 0).alias("has_out"))


ROOT_CATEGORIES = ["call_tree_roots", "dependency_sources", "dependency_sinks", "containment_roots", "leaf_sinks"]


def roots(nodes: DataFrame, edges: DataFrame, ratio: int = 3) -> DataFrame:
    """SNAP, category, node_id, canonical_path, name: one row per class a node is in."""
    d = degree_stats(nodes, edges).join(nodes.select(*SNAP, "id", "canonical_path", "name", "kind"), [*SNAP, "id"])
    c = F.col
    tests = [
        (c("calls_out") > 0) & (c("calls_in") == 0),
        (c("depends_in") > 0) & (c("depends_in") >= ratio * (c("depends_out") + 1)),
        (c("depends_out") > 0) & (c("depends_out") >= ratio * (c("depends_in") + 1)),
        c("kind").isin("system", "service") & ~c("is_contained"),
        c("has_in") & ~c("has_out"),
    ]
    classes = F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in zip(tests, ROOT_CATEGORIES, strict=True)]))
    return d.select(*SNAP, F.explode(classes).alias("category"), c("id").alias("node_id"), "canonical_path", "name")


def last_category(found: DataFrame) -> DataFrame:
    """One category per node: the last in ROOT_CATEGORIES."""
    order = F.array_position(F.array(*map(F.lit, ROOT_CATEGORIES)), F.col("category"))
    return found.groupBy(*SNAP, "node_id").agg(F.max_by("category", order).alias("category"))


def fan_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNAP, id, fan_in, fan_out of all edges but containment, parallel ones counted each."""
    e = edges.filter(F.col("kind") != "contains")
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    s = e.select(*SNAP, F.explode(F.array(F.struct(F.col("target").alias("id"), one.alias("i"), no.alias("o")), F.struct(F.col("source").alias("id"), no.alias("i"), one.alias("o")))).alias("s")).select(*SNAP, "s.*")
    s = s.filter("id is not null").groupBy(*SNAP, "id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select(*SNAP, "id").join(s, [*SNAP, "id"], "left").fillna(0, ["fan_in", "fan_out"])


def mapped_edges(edges: DataFrame, mapping: DataFrame, to: str) -> DataFrame:
    """Edges but containment with both ends replaced by ``to`` of a mapping SNAP, node, ``to``; others are left out."""
    e = edges.filter(F.col("kind") != "contains").filter("source is not null and target is not null")
    a = mapping.select(*SNAP, F.col("node").alias("source"), F.col(to).alias("src"))
    b = mapping.select(*SNAP, F.col("node").alias("target"), F.col(to).alias("tgt"))
    return e.join(a, [*SNAP, "source"]).join(b, [*SNAP, "target"])


def dependency_matrix(edges: DataFrame, links: DataFrame) -> DataFrame:
    """SNAP, src, tgt, n: edges between different top modules."""
    e = mapped_edges(edges, top_modules(links), "top")
    return e.filter(F.col("src") != F.col("tgt")).groupBy(*SNAP, "src", "tgt").agg(F.count(F.lit(1)).alias("n"))


def cyclic_matrix(cells: DataFrame) -> DataFrame:
    """The cells with is_cyclic (the reverse cell exists), max_n of the snapshot and is_dark (more than half of it)."""
    back = cells.select(*SNAP, F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.lit(True).alias("back"))
    top = cells.groupBy(*SNAP).agg(F.max("n").alias("max_n"))
    out = cells.join(back, [*SNAP, "src", "tgt"], "left").join(top, SNAP)
    return out.select(*SNAP, "src", "tgt", "n", F.coalesce("back", F.lit(False)).alias("is_cyclic"), "max_n", (2 * F.col("n") > F.col("max_n")).alias("is_dark"))


def hierarchical_matrix(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """The matrix between the visible stand-ins of both ends. shown: SNAP, node, shown."""
    e = mapped_edges(edges, shown, "shown")
    cells = e.filter(F.col("src") != F.col("tgt")).groupBy(*SNAP, "src", "tgt").agg(F.count(F.lit(1)).alias("n"))
    return cyclic_matrix(cells)


def meta_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """SNAP, src, tgt, kind, n, is_meta: edges with a hidden end merged per visible ends and kind, others as they are; no self loops among the merged."""
    e = mapped_edges(edges, shown, "shown")
    hidden = (F.col("src") != F.col("source")) | (F.col("tgt") != F.col("target"))
    plain = e.filter(~hidden).select(*SNAP, "src", "tgt", "kind", F.lit(1).cast("long").alias("n"), F.lit(False).alias("is_meta"))
    merged = e.filter(hidden & (F.col("src") != F.col("tgt"))).groupBy(*SNAP, "src", "tgt", "kind").agg(F.count(F.lit(1)).alias("n"))
    return plain.unionByName(merged.withColumn("is_meta", F.lit(True)))


def flow_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """SNAP, src, tgt, kind, n over visible stand-ins; self loops stay only for transforms and data_flow."""
    e = mapped_edges(edges, shown, "shown").filter((F.col("src") != F.col("tgt")) | F.col("kind").isin("transforms", "data_flow"))
    return e.groupBy(*SNAP, "src", "tgt", "kind").agg(F.count(F.lit(1)).alias("n"))


def count_descendants(links: DataFrame) -> DataFrame:
    """SNAP, id, n_descendants; 0 on and below cycles."""
    n = gather(acyclic(links), F.lit(1).cast("long")).select(*SNAP, "node", (F.col("total") - 1).alias("n"))
    return links.select(*SNAP, "node").join(n, [*SNAP, "node"], "left").select(*SNAP, F.col("node").alias("id"), F.coalesce("n", F.lit(0)).alias("n_descendants"))


def leaf_values(nodes: DataFrame, links: DataFrame, value: Column) -> DataFrame:
    """SNAP, id, value of the nodes without children: the metric if above 0, else 1."""
    inner = links.filter("parent is not null").select(*SNAP, F.col("parent").alias("id")).distinct()
    v = F.when(value > 0, value).otherwise(F.lit(1.0))
    return nodes.join(inner, [*SNAP, "id"], "left_anti").select(*SNAP, "id", v.alias("value"))


def hierarchy_sum(nodes: DataFrame, links: DataFrame, value: Column) -> DataFrame:
    """SNAP, id, total: the sum of leaf values in each node's subtree (trees only; a leaf below a cycle has its own value)."""
    leaves = leaf_values(nodes, links, value).withColumnRenamed("id", "node")
    own = acyclic(links).join(leaves, [*SNAP, "node"], "left")
    sums = gather(own, F.coalesce("value", F.lit(0.0)))
    lost = leaves.join(sums, [*SNAP, "node"], "left_anti").select(*SNAP, "node", F.col("value").alias("total"))
    return sums.unionByName(lost).withColumnRenamed("node", "id")


def edge_kind_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*SNAP, "kind").agg(F.count(F.lit(1)).alias("n"))


def over_limit(edges: DataFrame, kind: str, end: str, most: int) -> DataFrame:
    """SNAP, ``end``, n of the ends with more than ``most`` edges of a kind."""
    return of_kind(edges, kind).filter(F.col(end).isNotNull()).groupBy(*SNAP, end).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def method_call_stats(warnings: DataFrame) -> DataFrame:
    """warnings, resolved, unresolved: sums over texts of the form 'N method call(s): M resolved, K could not be resolved ...'."""
    w = warnings.filter(F.col("text").contains("method call(s):"))

    def number(pattern: str) -> Column:
        return F.sum(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")).cast("long"))

    return w.agg(F.count(F.lit(1)).alias("warnings"), number(r"method call\(s\):.*?(\d+) resolved").alias("resolved"), number(r", (\d+) could not be resolved").alias("unresolved"))


def edges_between(edges: DataFrame, mapping: DataFrame, to: str, pairs: DataFrame, kinds: tuple[str, ...] = ("depends", "calls", "data_flow")) -> DataFrame:
    """SNAP, src, tgt, kind, n, sample: the edges behind given pairs (SNAP, src, tgt) of a mapping's values."""
    e = mapped_edges(of_kind(edges, *kinds), mapping, to).join(pairs, [*SNAP, "src", "tgt"], "left_semi")
    return e.groupBy(*SNAP, "src", "tgt", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("sample"))


#: Nodes of a snapshot above which its containers are closed in the flow view, and above which all of them are (fixed values).
FLOW_CLOSED, FLOW_ALL_CLOSED = 200, 1000


def flow_view(nodes: DataFrame, links: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """SNAP, node, shown of the progressive flow view. Large snapshots close containers but those expanded (SNAP, id): all of
    them in very large ones, else components and units; where more than FLOW_CLOSED nodes are left in sight, all."""
    held = links.filter("parent is not null").select(*SNAP, F.col("parent").alias("id")).distinct()
    if expanded is not None:
        held = held.join(expanded, [*SNAP, "id"], "left_anti")
    size = count_rows(nodes, "size")
    boxes = nodes.select(*SNAP, "id", "kind").join(held, [*SNAP, "id"], "left_semi").join(size, SNAP)
    shut = boxes.filter((F.col("size") > FLOW_ALL_CLOSED) | ((F.col("size") > FLOW_CLOSED) & F.col("kind").isin("component", "unit"))).select(*SNAP, "id")
    hidden = below(links, shut).filter("dist > 0 or above").groupBy(*SNAP).agg(F.count(F.lit(1)).alias("hidden"))
    full = size.join(hidden, SNAP, "left").filter(F.col("size") - F.coalesce("hidden", F.lit(0)) > FLOW_CLOSED).select(*SNAP)
    shut = shut.unionByName(held.join(full, SNAP, "left_semi")).distinct()
    return visible(links, nodes.select(*SNAP, "id").join(shut, [*SNAP, "id"], "left_anti"))


def rollup(edges: DataFrame, mapping: DataFrame, to: str, kinds: tuple[str, ...] = ("depends", "calls", "data_flow")) -> DataFrame:
    """SNAP, src, tgt, weight, kinds, samples: edges between the ``to`` of both ends, with their kinds and the three smallest edge ids."""
    e = mapped_edges(of_kind(edges, *kinds), mapping, to).filter(F.col("src") != F.col("tgt"))
    # Per kind first: the sets stay small, and the samples are minima, not lists of all edges.
    per = e.groupBy(*SNAP, "src", "tgt", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lowest"), F.max("id").alias("highest"))
    return per.groupBy(*SNAP, "src", "tgt").agg(F.sum("n").alias("weight"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"), F.min("lowest").alias("first_edge"), F.max("highest").alias("last_edge"))


def ancestor_of_kind(nodes: DataFrame, links: DataFrame, kind: str) -> DataFrame:
    """SNAP, node, holder: the nearest ancestor (or the node itself) of a kind."""
    return holders(links, nodes.filter(F.col("kind") == kind))


def children_of(links: DataFrame, parents: DataFrame) -> DataFrame:
    """SNAP, node, child: for the nodes at or below children of the given nodes (SNAP, id), the child they are in."""
    held = links.join(parents.select(*SNAP, F.col("id").alias("parent")).distinct(), [*SNAP, "parent"], "left_semi")
    return holders(links, held.select(*SNAP, F.col("node").alias("id"))).withColumnRenamed("holder", "child")


def neighbourhood(edges: DataFrame, node_id: str) -> DataFrame:
    """SNAP, id: the node and its neighbours over any edge."""
    e = edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    return e.select(*SNAP, F.explode(F.array("source", "target")).alias("id")).filter("id is not null").distinct()
