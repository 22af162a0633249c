"""References to records that do not exist, by signed counts.

Every delivery of an edge is a change: +1 for each of its ends and, once a later delivery replaces it, -1 for the
same ends. Every delivery of a node is +1 of existence. Summed per key (project, version, id) these give the state
(refs, exists, first_loaded, first_ref), which can be kept and merged with later deltas (``merge_counts``). Keys with
refs > 0 and exists = 0 are the current orphans; keys whose node arrived after a reference are the late ones.

Defined results: null or blank ends are no references; rows without an id are ignored; empty tables give no rows;
repeated rows count once (their signed counts cancel); extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import HOT_ROWS, HOT_SHARE, broadcast_if_small, salted_join, union_all, write_table
from graphloom.tables import norm_id, pack_id, packed_edges, packed_nodes, superseded, unpack_id

KEY = ["project_id", "version", "ref"]


def delivered(edges: DataFrame) -> DataFrame:
    """project_id, version, edge, src, tgt, loaded_at, delta of every delivery.

    delta is +1 for the delivery that counts; for a replaced one the +1 and the -1 are already summed to 0.
    """
    return packed_edges(edges).withColumn("delta", F.when(superseded(["project_id", "version", "edge"]), 0).otherwise(1))


def reference_deltas(e: DataFrame) -> DataFrame:
    """project_id, version, edge, endpoint, ref, loaded_at, delta: one row per delivery (of ``delivered``) and end."""
    ends = F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), F.col("src").alias("ref")), F.struct(F.lit("target").alias("endpoint"), F.col("tgt").alias("ref"))))
    e = e.select("project_id", "version", "edge", "loaded_at", "delta", ends.alias("end"))
    return e.select("project_id", "version", "edge", "loaded_at", "delta", "end.endpoint", "end.ref").filter(F.col("ref").isNotNull())


def existence_deltas(nodes: DataFrame) -> DataFrame:
    return packed_nodes(nodes).select("project_id", "version", F.col("node").alias("ref"), "loaded_at")


def merge_counts(*states: DataFrame) -> DataFrame:
    """Sum states or deltas per key. Sums and minima of fixed width: combined on the map side, hot keys do no harm."""
    return union_all(list(states)).groupBy(*KEY).agg(
        F.sum("refs").alias("refs"), F.sum("exists").alias("exists"), F.min("first_loaded").alias("first_loaded"), F.min("first_ref").alias("first_ref")
    )


def reference_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The state per key: refs, exists, first_loaded (of the node), first_ref (of the earliest counting reference)."""
    return counts_of(delivered(edges), nodes)


def counts_of(deliveries: DataFrame, nodes: DataFrame) -> DataFrame:
    """reference_counts of edges whose deltas are known."""
    never = F.lit(None).cast("timestamp")
    refs = reference_deltas(deliveries).select(*KEY, F.col("delta").cast("long").alias("refs"), F.lit(0).cast("long").alias("exists"), never.alias("first_loaded"), F.when(F.col("delta") > 0, F.col("loaded_at")).alias("first_ref"))
    there = existence_deltas(nodes).select(*KEY, F.lit(0).cast("long").alias("refs"), F.lit(1).cast("long").alias("exists"), F.col("loaded_at").alias("first_loaded"), never.alias("first_ref"))
    return merge_counts(refs, there)


def orphan_keys(counts: DataFrame, nodes: DataFrame, shared_nodes: DataFrame) -> DataFrame:
    """Keys with references that are missing or came before their node: KEY, refs, reason (null: only late), first_loaded."""
    hit = counts.filter((F.col("refs") > 0) & ((F.col("exists") == 0) | (F.col("first_ref") < F.col("first_loaded"))))
    shared = shared_nodes.select(pack_id(norm_id(F.col("id"))).alias("ref"), F.lit(True).alias("is_shared")).filter(F.col("ref").isNotNull()).dropDuplicates()
    hit = hit.join(broadcast_if_small(shared), "ref", "left").filter((F.col("exists") > 0) | F.col("is_shared").isNull())
    span = existence_deltas(nodes).groupBy("project_id", "ref").agg(F.min("version").alias("lowest"), F.max("version").alias("highest"))
    hit = hit.join(span, ["project_id", "ref"], "left")
    reason = F.when(F.col("exists") > 0, None).when(F.col("lowest") < F.col("version"), "deleted").when(F.col("highest") > F.col("version"), "late").otherwise("missing")
    return hit.select(*KEY, "refs", reason.alias("absent"), F.when(F.col("exists") > 0, F.col("first_loaded")).alias("first_loaded"))


def orphan_references(edges: DataFrame, nodes: DataFrame, shared_nodes: DataFrame) -> DataFrame:
    """project_id, version, edge_id, endpoint, reason, loaded_at of every orphan or late reference."""
    deliveries = write_table(delivered(edges).filter(F.col("src").isNotNull() | F.col("tgt").isNotNull()), "deliveries")  # read for the counts and for the references
    keys = write_table(orphan_keys(counts_of(deliveries, nodes), nodes, shared_nodes), "orphan-keys")
    live = reference_deltas(deliveries.filter(F.col("delta") > 0)).drop("delta")
    total = keys.agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0]
    least = max(HOT_ROWS, HOT_SHARE * total)  # at most 1/HOT_SHARE keys reach the driver
    hot = [r[0] for r in keys.filter(F.col("refs") >= least).select(F.xxhash64(*KEY)).collect()]
    found = salted_join(live, keys.drop("refs"), KEY, "inner", F.col("edge"), hot)
    found = found.filter(F.col("absent").isNotNull() | (F.col("first_loaded") > F.col("loaded_at")))
    return found.select("project_id", "version", unpack_id(F.col("edge")).alias("edge_id"), "endpoint", F.coalesce("absent", F.lit("late")).alias("reason"), "loaded_at")


def orphan_rates(found: DataFrame) -> DataFrame:
    """Orphan references per table and month of the referring row: table_name, month, endpoint, reason, n."""
    month = F.date_format("loaded_at", "yyyy-MM")
    return found.groupBy(F.lit("edges").alias("table_name"), month.alias("month"), "endpoint", "reason").agg(F.count(F.lit(1)).alias("n"))
