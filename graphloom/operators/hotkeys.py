"""Per-key results when a few keys hold most rows.

Degrees of the ids at both ends of edges: each edge adds one fixed-width state per end, the hash tables of the map side
merge the states of a key before anything is shuffled, so a key with a third of all rows sends one row per map task.

Defined results: null or blank ends are left out; repeated and replaced deliveries count once; an id that is no node
still has its degrees; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.tables import latest, packed_edges, unpack_id


def degrees(edges: DataFrame, kind: str = "depends") -> DataFrame:
    """id (packed), n_in, n_out over the counting rows of ``kind`` of all projects and versions."""
    e = packed_edges(edges, (F.col("kind") == kind).alias("of_kind"))
    # Deliveries of other kinds are only needed to tell which delivery counts, so their ends stay behind.
    e = e.withColumns({end: F.when(F.col("of_kind"), F.col(end)) for end in ("src", "tgt")})
    e = latest(e, ["project_id", "version", "edge"]).filter("of_kind")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    states = F.explode(F.array(F.struct(F.col("tgt").alias("id"), one.alias("i"), none.alias("o")), F.struct(F.col("src").alias("id"), none.alias("i"), one.alias("o"))))
    e = e.select(states.alias("s")).select("s.id", "s.i", "s.o").filter(F.col("id").isNotNull())
    return e.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def depends_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges, "depends")
    return d.select(unpack_id(F.col("id")).alias("node_id"), F.col("n_in").alias("depends_in"), F.col("n_out").alias("depends_out"))


def heavy_targets(edges: DataFrame, ratio: int = 3) -> DataFrame:
    """node_id with depends_in >= ratio * (depends_out + 1)."""
    return depends_degrees(edges).filter(F.col("depends_in") >= ratio * (F.col("depends_out") + 1)).select("node_id")
