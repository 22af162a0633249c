"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, with cycles found.

Splitters are the nodes whose key hash is 0 modulo SPLIT_EVERY; every task can tell them without a lookup. Each node
walks up to its next splitter or root, in rounds that double the steps taken. The splitters then form a graph smaller by
SPLIT_EVERY in which only roots end a walk; it is solved the same way, and every node adds its own piece to its
splitter's. Nodes still walking after more steps than any acyclic walk among them could need lie on or below a cycle
(in the first phase: one without a splitter).

Defined results: ends that are null or no nodes of the snapshot are ignored; of several parents the one with the smallest
id counts; a self loop is a cycle; nodes on or below a cycle have root '' and depth -1 and no path; repeated rows count
once; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import HOT_ROWS, hot_hashes, salted_join, union_all, write_table
from graphloom.tables import latest, pack_id, packed_edges, packed_nodes, unpack_id

#: One node in so many is a splitter.
SPLIT_EVERY = 8
SNAP = ["project_id", "version"]


def _is_splitter(node: Column) -> Column:
    return F.pmod(F.xxhash64(*SNAP, node), F.lit(SPLIT_EVERY)) == 0


def parent_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project_id, version, node, parent (null for roots), as a written table."""
    n = packed_nodes(nodes).select(*SNAP, "node").distinct()
    e = packed_edges(edges, (F.col("kind") == "contains").alias("holds"))
    # Deliveries of other kinds are only needed to tell which delivery counts, so their ends stay behind.
    e = e.withColumns({end: F.when(F.col("holds"), F.col(end)) for end in ("src", "tgt")})
    # Hot parents are told from all deliveries: those that do not count can only add keys to salt.
    hot = hot_hashes(e.filter(F.col("holds") & F.col("src").isNotNull()).select(*SNAP, F.col("src").alias("node")), [*SNAP, "node"])
    e = latest(e, [*SNAP, "edge"]).filter(F.col("holds") & F.col("src").isNotNull() & F.col("tgt").isNotNull())
    e = e.select(*SNAP, F.col("src").alias("node"), F.col("tgt").alias("child"))
    e = salted_join(e, n, [*SNAP, "node"], "left_semi", F.col("child"), hot)
    up = e.groupBy(*SNAP, F.col("child").alias("node")).agg(pack_id(F.min(unpack_id(F.col("node")))).alias("parent"))
    return write_table(n.join(up, [*SNAP, "node"], "left"), "parents")


def _walk(start: DataFrame, name: str, with_paths: bool) -> DataFrame:
    """Walk to the next stop. start: SNAP, node, cur, dist, stopped[, seg]; returns it with stopped false only for cycles.

    Every row is looked up by its cur until that row's own walk has stopped, so steps double in each round. Rows are
    written once, when they stop; only those still walking go on.
    """
    ended, active = [start.filter("stopped")], start.filter("not stopped")
    steps, bound = 1, None
    while True:
        sizes = active.groupBy(*SNAP).count().agg(F.max("count"), F.sum("count")).first()
        per_snap, total = sizes[0] or 0, sizes[1] or 0
        if not per_snap:
            break
        # All nodes on a walk of d > steps that have more than steps before them are active too, so d <= steps + per_snap.
        bound = steps + per_snap if bound is None else min(bound, steps + per_snap)
        if steps > bound:
            ended.append(active)
            break
        hot = None if total >= HOT_ROWS else []  # so few rows hold no hot key
        look = union_all([*ended, active]).select(*SNAP, F.col("node").alias("cur"), F.col("cur").alias("cur2"), F.col("dist").alias("dist2"), F.col("stopped").alias("stopped2"), *([F.col("seg").alias("seg2")] if with_paths else []))
        step = salted_join(active, look, [*SNAP, "cur"], "inner", F.col("node"), hot)
        more = [F.concat("seg", "seg2").alias("seg")] if with_paths else []
        step = step.select(*SNAP, "node", F.col("cur2").alias("cur"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("stopped2").alias("stopped"), *more)
        active = write_table(step, f"{name}-{steps}")
        ended, active = [*ended, active.filter("stopped")], active.filter("not stopped")
        steps *= 2
    return union_all(ended)


def hierarchy(nodes: DataFrame, edges: DataFrame, with_paths: bool = False) -> DataFrame:
    """project_id, version, node, root, depth[, path (root to node)], ids packed; root and path null on or below a cycle."""
    links = parent_links(nodes, edges)
    own = [F.when(F.col("parent").isNull(), F.array().cast("array<binary>")).otherwise(F.array("node")).alias("seg")] if with_paths else []
    # A root stops at itself; a node whose parent is a splitter stops there; a splitter is a stop for others but walks on itself.
    start = links.select(*SNAP, "node", F.coalesce("parent", "node").alias("cur"), F.col("parent").isNotNull().cast("long").alias("dist"), (F.col("parent").isNull() | _is_splitter(F.col("parent"))).alias("stopped"), F.col("parent").isNull().alias("is_root"), *own)
    walked = write_table(_walk(start.drop("is_root"), "walk", with_paths), "walked")

    # Reduced graph: roots stop at themselves (dist 0), splitters point to the stop of their walk.
    stops = walked.filter(((F.col("cur") == F.col("node")) & (F.col("dist") == 0)) | _is_splitter(F.col("node")))
    at_root = (F.col("cur") == F.col("node")) & (F.col("dist") == 0)
    reduced = stops.withColumn("stopped", at_root)
    lost = stops.filter(~F.col("stopped"))  # on or below a cycle without splitters
    reduced = reduced.join(lost.select(*SNAP, "node"), [*SNAP, "node"], "left_anti")
    solved = _walk(reduced, "reduced", with_paths)
    look = solved.filter("stopped").select(*SNAP, F.col("node").alias("cur"), F.col("cur").alias("root"), F.col("dist").alias("dist2"), *([F.col("seg").alias("seg2")] if with_paths else []))
    look = write_table(look, "solved")
    full = salted_join(walked.withColumn("known", F.col("stopped")), look, [*SNAP, "cur"], "left", F.col("node"))
    good = F.col("known") & F.col("root").isNotNull()
    path = [F.when(good, F.concat(F.array("root"), F.reverse(F.concat("seg", "seg2")))).alias("path")] if with_paths else []
    return full.select(*SNAP, "node", F.when(good, F.col("root")).alias("root"), F.when(good, F.col("dist") + F.col("dist2")).otherwise(F.lit(-1)).cast("long").alias("depth"), *path)


def node_depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project_id, version, node_id, root_id, depth."""
    h = hierarchy(nodes, edges)
    return h.select(*SNAP, unpack_id(F.col("node")).alias("node_id"), F.coalesce(unpack_id(F.col("root")), F.lit("")).alias("root_id"), "depth")


def node_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_depths with path: the ids from the root to the node joined by '/', '' on or below a cycle."""
    h = hierarchy(nodes, edges, with_paths=True)
    path = F.array_join(F.transform("path", unpack_id), "/")
    return h.select(*SNAP, unpack_id(F.col("node")).alias("node_id"), F.coalesce(unpack_id(F.col("root")), F.lit("")).alias("root_id"), "depth", F.coalesce(path, F.lit("")).alias("path"))


def descendants(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """project_id, version, node_id, descendant_id, distance: one row per node and node below it (none for cycles)."""
    h = hierarchy(nodes, edges, with_paths=True).filter("depth > 0")
    above = h.select(*SNAP, F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("level", "node"))
    return above.select(*SNAP, unpack_id(F.col("node")).alias("node_id"), unpack_id(F.col("descendant")).alias("descendant_id"), (F.col("depth") - F.col("level")).alias("distance"))
