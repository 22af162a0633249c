"""Closures and walks over a snapshot's edges, cycle-safe.

Iterative operators write each round to the shared folder, so plans stay short and a lost executor loses nothing.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import SNAP, of_kind
from graphloom.runtime import union_all, write_table

#: Rounds after which those so far are written as one table.
FOLD = 32


def parent_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNAP, node, parent for containment edges whose ends are nodes; distinct."""
    keys = nodes.select(*SNAP, "id")
    e = of_kind(edges, "contains").select(*SNAP, F.col("target").alias("node"), F.col("source").alias("parent")).distinct()
    return e.join(keys.withColumnRenamed("id", "node"), [*SNAP, "node"], "left_semi").join(keys.withColumnRenamed("id", "parent"), [*SNAP, "parent"], "left_semi")


def closure(links: DataFrame, a: str = "node", b: str = "parent", most: int | None = None) -> DataFrame:
    """All pairs (a, b, dist) joined by a path, with the fewest steps; path lengths double in each round.

    A node is paired with itself only if it lies on a cycle. ``most`` bounds the steps.
    """
    pairs = write_table(links.select(*SNAP, F.col(a).alias("node"), F.col(b).alias("ancestor"), F.lit(1).cast("long").alias("dist")).distinct(), "closure")
    reach = 1
    n = pairs.count()
    while most is None or reach < most:
        left = pairs.select(*SNAP, "node", F.col("ancestor").alias("mid"), F.col("dist").alias("d1"))
        right = pairs.select(*SNAP, F.col("node").alias("mid"), "ancestor", F.col("dist").alias("d2"))
        step = left.join(right, [*SNAP, "mid"]).select(*SNAP, "node", "ancestor", (F.col("d1") + F.col("d2")).alias("dist"))
        pairs = write_table(pairs.unionByName(step).groupBy(*SNAP, "node", "ancestor").agg(F.min("dist").alias("dist")), "closure")
        reach *= 2
        m = pairs.count()
        if m == n:
            break
        n = m
    return pairs.filter(F.col("dist") <= most) if most is not None else pairs


def reachable(edges: DataFrame, starts: DataFrame, kind: str = "depends", reverse: bool = False, most: int | None = None) -> DataFrame:
    """SNAP, start, node, dist of all nodes reached from the starts; a start itself only over a cycle. Semi-naive rounds.

    ``most`` bounds the steps; without it the rounds end when no new node appears.
    """
    a, b = ("target", "source") if reverse else ("source", "target")
    e = of_kind(edges, kind).filter(F.col("source").isNotNull() & F.col("target").isNotNull()).select(*SNAP, F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    e = write_table(e, "steps")
    front = starts.select(*SNAP, F.col("id").alias("start"), F.col("id").alias("node"))
    seen: DataFrame | None = None
    for dist in itertools.count(1) if most is None else range(1, most + 1):
        new = front.join(e, [*SNAP, "node"]).select(*SNAP, "start", F.col("next").alias("node")).distinct()
        if seen is not None:
            new = new.join(seen.drop("dist"), [*SNAP, "start", "node"], "left_anti")
        new = write_table(new.withColumn("dist", F.lit(dist).cast("long")), "reached")
        if new.isEmpty():
            return seen if seen is not None else new
        seen = new if seen is None else seen.unionByName(new)
        if dist % FOLD == 0:  # else the plan grows with the rounds
            seen = write_table(seen, "reached")
        front = new.drop("dist")
    return seen


def cyclic_core(edges: DataFrame, kind: str) -> DataFrame:
    """SNAP, source, target left when nodes without incoming or without outgoing edges are trimmed again and again.

    Empty if and only if the edges of the kind have no cycle; all cycles lie within. No closure is built.
    """
    return _trimmed(of_kind(edges, kind).filter("source is not null and target is not null").select(*SNAP, "source", "target").distinct())


def _trimmed(links: DataFrame) -> DataFrame:
    e = write_table(links, "core")
    n = e.count()
    while n:
        e2 = e.join(e.select(*SNAP, F.col("target").alias("source")).distinct(), [*SNAP, "source"], "left_semi").join(e.select(*SNAP, F.col("source").alias("target")).distinct(), [*SNAP, "target"], "left_semi")
        e = write_table(e2, "core")
        m = e.count()
        if m == n:
            break
        n = m
    return e


def nodes_on_cycles(edges: DataFrame, kind: str) -> DataFrame:
    """SNAP, id of the nodes that reach themselves over edges of a kind, by colouring.

    Each node takes the smallest id that reaches it as its colour; those that reach the node of their own colour within it
    form its strongly connected component. Components are taken out, the rest is trimmed, and so on until nothing is left. No
    pairs are built: a round's rows are the nodes whose colour changed.
    """
    e = cyclic_core(edges, kind)
    found = [e.filter("source = target").select(*SNAP, F.col("source").alias("id")).distinct()]
    e = write_table(e.filter("source <> target"), "cyclic")
    while not e.isEmpty():
        ids = e.select(*SNAP, F.col("source").alias("id"))
        colour = write_table(ids.distinct().withColumn("colour", F.col("id")), "colours")
        changed = colour
        while not changed.isEmpty():
            sent = changed.withColumnRenamed("id", "source").join(e, [*SNAP, "source"]).groupBy(*SNAP, F.col("target").alias("id")).agg(F.min("colour").alias("new"))
            both = write_table(colour.join(sent, [*SNAP, "id"], "left").select(*SNAP, "id", F.least("colour", "new").alias("colour"), F.coalesce(F.col("new") < F.col("colour"), F.lit(False)).alias("moved")), "colours")
            changed, colour = both.filter("moved").drop("moved"), both.drop("moved")
        c1, c2 = (colour.select(*SNAP, F.col("id").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("source", "target"))
        inside = write_table(e.join(c1, [*SNAP, "source"]).join(c2, [*SNAP, "target"]).filter("source_colour = target_colour").select(*SNAP, "source", "target"), "coloured")
        front = colour.filter("id = colour").select(*SNAP, "id")
        seen = write_table(front, "component")
        while True:  # backwards from the node that gave the colour
            new = inside.join(front.withColumnRenamed("id", "target"), [*SNAP, "target"], "left_semi").select(*SNAP, F.col("source").alias("id")).distinct().join(seen, [*SNAP, "id"], "left_anti")
            front = write_table(new, "component")
            if front.isEmpty():
                break
            seen = write_table(seen.unionByName(front), "component")
        within = inside.join(seen.withColumnRenamed("id", "source"), [*SNAP, "source"], "left_semi").join(seen.withColumnRenamed("id", "target"), [*SNAP, "target"], "left_semi")
        found.append(write_table(within.select(*SNAP, F.col("source").alias("id")).distinct(), "on-cycles"))
        rest = e.join(seen.withColumnRenamed("id", "source"), [*SNAP, "source"], "left_anti").join(seen.withColumnRenamed("id", "target"), [*SNAP, "target"], "left_anti")
        e = _trimmed(rest)
    return union_all(found).distinct()


def simple_paths(edges: DataFrame, starts: DataFrame, most: int, kinds: tuple[str, ...] = ("depends",), ends: DataFrame | None = None) -> DataFrame:
    """SNAP, start, node, path, steps: paths without repeated nodes of at most ``most`` steps."""
    e = of_kind(edges, *kinds).filter("source is not null and target is not null").select(*SNAP, F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    front = starts.select(*SNAP, F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("ids"))
    found = []
    for step in range(1, most + 1):
        front = front.join(e, [*SNAP, "node"]).filter(~F.array_contains("ids", F.col("next")))
        front = front.select(*SNAP, "start", F.col("next").alias("node"), F.array_append("ids", F.col("next")).alias("ids"))
        found.append(front.withColumn("steps", F.lit(step)))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if ends is not None:
        out = out.join(ends.select(*SNAP, F.col("id").alias("node")), [*SNAP, "node"], "left_semi")
    return out.select(*SNAP, "start", "node", F.array_join("ids", "/").alias("path"), "steps")
