"""Containment trees by pointer doubling: depth, chains, holders, scopes and subtree sums without pairs of nodes.

``links`` holds SNAP, node, parent (null for roots), one row per node; of several parents the smallest id counts, as in ``hierarchy``.
A climb lets every node carry values over the stretch of its line up to a pointer; each round joins pointers to the
pointers there, so stretches double and a tree of depth d takes log2(d) rounds over fixed-width rows. A gathering sends sums down
the same pointers the other way. Nodes still climbing after more steps than any acyclic line could need lie on or below a
cycle. Rounds are written to the shared folder; hot parents are salted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import SNAP
from graphloom.operators.traversal import parent_edges
from graphloom.runtime import HOT_ROWS, salted_join, union_all, write_table

Values = dict[str, Column]


def parent_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The links of all nodes, as a written table."""
    up = parent_edges(edges, nodes).groupBy(*SNAP, "node").agg(F.min("parent").alias("parent"))
    return write_table(nodes.select(*SNAP, F.col("id").alias("node")).join(up, [*SNAP, "node"], "left"), "parents")


def _sizes(active: DataFrame) -> tuple[int, int]:
    """Rows of the largest snapshot, and of all."""
    most, total = active.groupBy(*SNAP).count().agg(F.max("count"), F.sum("count")).first()
    return most or 0, total or 0


def climb(links: DataFrame, values: Values, combine: Callable[[Values, Values], Values]) -> DataFrame:
    """SNAP, node, ptr and the values of each node's whole line; ptr is null but for nodes on or below cycles.

    values: what a node alone gives, over the columns of links. combine: the values of a stretch and of the one above it
    to those of both.
    """
    names = list(values)
    start = links.select(*SNAP, "node", F.col("parent").alias("ptr"), *[c.alias(n) for n, c in values.items()])
    ended, active = [start.filter("ptr is null")], start.filter("ptr is not null")
    steps, bound = 1, None
    while True:
        most, total = _sizes(active)
        if not most:
            break
        bound = steps + most if bound is None else min(bound, steps + most)
        if steps > bound:
            ended.append(active)
            break
        look = union_all([*ended, active]).select(*SNAP, F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), *[F.col(n).alias(f"{n}2") for n in names])
        step = salted_join(active, look, [*SNAP, "ptr"], "inner", F.col("node"), None if total >= HOT_ROWS else [])
        both = combine({n: F.col(n) for n in names}, {n: F.col(f"{n}2") for n in names})
        active = write_table(step.select(*SNAP, "node", F.col("ptr2").alias("ptr"), *[both[n].alias(n) for n in names]), f"climb-{steps}")
        ended, active = [*ended, active.filter("ptr is null")], active.filter("ptr is not null")
        steps *= 2
    return union_all(ended)


def gather(links: DataFrame, value: Column, cycles: bool = False) -> DataFrame:
    """SNAP, node, total: the sum of a value over each node's subtree, itself in it; with ``cycles`` the maximum, over cycles too.

    Sums need links without cycles.
    """
    fold = F.max if cycles else F.sum
    now = write_table(links.select(*SNAP, "node", F.col("parent").alias("ptr"), value.alias("total")), "gather")
    steps, bound = 1, None
    while True:
        active = now.filter("ptr is not null")
        most, total = _sizes(active)
        bound = steps + most if bound is None else min(bound, steps + most)
        if not most or steps > bound:
            return now.select(*SNAP, "node", "total")
        below = active.groupBy(*SNAP, F.col("ptr").alias("node")).agg(fold("total").alias("below"))
        above = now.filter("ptr is not null").select(*SNAP, F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"))
        more = F.greatest("total", "below") if cycles else F.col("total") + F.coalesce("below", F.lit(0))
        step = salted_join(now, above, [*SNAP, "ptr"], "left", F.col("node"), None if total >= HOT_ROWS else [])
        now = write_table(step.join(below, [*SNAP, "node"], "left").select(*SNAP, "node", F.col("ptr2").alias("ptr"), more.alias("total")), f"gather-{steps}")
        steps *= 2


def _first(low: Values, high: Values) -> Values:
    return {n: F.coalesce(low[n], high[n]) for n in low}


def _last(low: Values, high: Values) -> Values:
    return {n: F.coalesce(high[n], low[n]) for n in low}


def depths(links: DataFrame) -> DataFrame:
    """SNAP, node, depth of the nodes that are not on or below a cycle; roots have 0."""
    up = F.col("parent").isNotNull().cast("long")
    return climb(links, {"depth": up}, lambda a, b: {"depth": a["depth"] + b["depth"]}).filter("ptr is null").drop("ptr")


def acyclic(links: DataFrame) -> DataFrame:
    """The links of the nodes that are not on or below a cycle, with depth."""
    return write_table(links.join(depths(links), [*SNAP, "node"]), "trees")


def cycle_members(links: DataFrame) -> DataFrame:
    """SNAP, id of the nodes on cycles: those at which climbs without end are left, since a cycle maps onto itself."""
    return climb(links, {}, lambda a, b: {}).filter("ptr is not null").select(*SNAP, F.col("ptr").alias("id")).distinct()


def chains(links: DataFrame) -> DataFrame:
    """SNAP, node, line (array): ids from the root down to the node; none on or below a cycle."""
    lines = climb(links, {"line": F.array("node")}, lambda a, b: {"line": F.concat(a["line"], b["line"])})
    return lines.filter("ptr is null").select(*SNAP, "node", F.reverse("line").alias("line"))


def top_modules(links: DataFrame) -> DataFrame:
    """SNAP, node, top: the ancestor one below the root (the node itself at depth 1); roots and cycles have none."""
    return climb(links, {"top": F.when(F.col("parent").isNotNull(), F.col("node"))}, _last).filter("ptr is null and top is not null").drop("ptr")


def holders(links: DataFrame, marked: DataFrame) -> DataFrame:
    """SNAP, node, holder: the nearest of the marked (SNAP, id) nodes at or above a node; trees only, but a marked node holds itself."""
    m = _marked(links, marked)
    up = climb(m, {"holder": F.when(F.col("marked"), F.col("node"))}, _first)
    return up.filter("(ptr is null or holder = node) and holder is not null").drop("ptr")


def visible(links: DataFrame, expanded: DataFrame) -> DataFrame:
    """SNAP, node, shown: the node itself if all its ancestors are expanded (SNAP, id), else its topmost ancestor that is not.

    Nodes on or below a cycle are shown themselves.
    """
    top = climb(_marked(links, expanded), {"shown": F.when(~F.col("marked"), F.col("node"))}, _last)
    return top.select(*SNAP, "node", F.when(F.col("ptr").isNull(), F.coalesce("shown", "node")).otherwise(F.col("node")).alias("shown"))


def below(links: DataFrame, marked: DataFrame) -> DataFrame:
    """SNAP, id, dist, above: the nodes at or below a marked one (SNAP, id), with the fewest steps up to one, and whether a marked
    one is strictly above; cycles are followed."""
    here, one = F.when(F.col("marked"), F.lit(0).cast("long")), F.lit(1).cast("long")

    def both(a: Values, b: Values) -> Values:
        return {"dist": F.coalesce(a["dist"], a["size"] + b["dist"]), "size": a["size"] + b["size"], "above": a["above"] | b["dist"].isNotNull()}

    up = climb(_marked(links, marked), {"dist": here, "size": one, "above": F.lit(False)}, both)
    return up.filter("dist is not null").select(*SNAP, F.col("node").alias("id"), "dist", "above")


def above(links: DataFrame, marked: DataFrame) -> DataFrame:
    """SNAP, id of the marked nodes (SNAP, id) and all above them; cycles are followed."""
    hit = gather(_marked(links, marked), F.col("marked"), cycles=True)
    return hit.filter("total").select(*SNAP, F.col("node").alias("id"))


def _marked(links: DataFrame, marked: DataFrame) -> DataFrame:
    m = marked.select(*SNAP, F.col("id").alias("node")).distinct().withColumn("marked", F.lit(True))
    return links.join(m, [*SNAP, "node"], "left").withColumn("marked", F.coalesce("marked", F.lit(False)))


def ancestors(links: DataFrame, starts: DataFrame) -> DataFrame:
    """SNAP, node, ancestor, dist of the given nodes (SNAP, id); a node is its own ancestor only over a cycle.

    The pointers of all nodes double; only the starts keep the lists of what they have met.
    """
    met = write_table(starts.select(*SNAP, F.col("id").alias("node")).distinct().join(links, [*SNAP, "node"]).filter("parent is not null").select(*SNAP, "node", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("dist")), "met")
    now = links.filter("parent is not null").select(*SNAP, F.col("node").alias("at"), F.col("parent").alias("ptr"))
    steps, n = 1, met.count()
    while n:
        far = salted_join(met.withColumnRenamed("ancestor", "at"), now, [*SNAP, "at"], "inner", F.col("node"))
        far = far.select(*SNAP, "node", F.col("ptr").alias("ancestor"), (F.col("dist") + steps).alias("dist"))
        met = write_table(met.unionByName(far).groupBy(*SNAP, "node", "ancestor").agg(F.min("dist").alias("dist")), f"met-{steps}")
        m = met.count()
        if m == n:
            break
        n = m
        hop = now.select(*SNAP, F.col("at").alias("ptr"), F.col("ptr").alias("ptr2"))
        now = write_table(salted_join(now, hop, [*SNAP, "ptr"], "inner", F.col("at")).select(*SNAP, "at", F.col("ptr2").alias("ptr")), f"hops-{steps}")
        steps *= 2
    return met


def tree_paths(links: DataFrame, ends: DataFrame) -> DataFrame:
    """SNAP, a, b, path: ids from a up to the lowest common ancestor and down to b, joined by '/'. ends: SNAP, a, b; trees only.

    The common part of both lines is a prefix, so the lowest common ancestor is found within two rows.
    """
    lines = chains(links)
    la, lb = (lines.select(*SNAP, F.col("node").alias(x), F.col("line").alias(f"l{x}")) for x in "ab")
    both = ends.join(la, [*SNAP, "a"]).join(lb, [*SNAP, "b"]).filter(F.col("la")[0] == F.col("lb")[0])
    same = F.size(F.filter(F.arrays_zip("la", "lb"), lambda x: x["la"] == x["lb"]))
    path = F.concat(F.reverse(F.slice("la", same, F.greatest(F.size("la") - same + 1, F.lit(0)))), F.slice("lb", same + 1, F.greatest(F.size("lb") - same, F.lit(0))))
    return both.select(*SNAP, "a", "b", F.array_join(path, "/").alias("path"))
