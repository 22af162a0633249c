"""Continuous ingest: pushed rows into the store, and orphan counts kept current from change deltas.

Both are Structured Streaming queries over a folder of files; every micro-batch is one idempotent write, so a batch that
is run again after a failure leaves the same state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.orphans import merge_counts, reference_counts
from graphloom.sources.store import SCHEMAS, Store
from graphloom.tables import unpack_id

EDGE_DELIVERIES = "id string, source string, target string, kind string, provenance string, metadata string, project_id string, version long, loaded_at timestamp"
NODE_DELIVERIES = "id string, canonical_path string, kind string, project_id string, version long, loaded_at timestamp"


def stream_into_store(store: Store, table: str, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert JSON rows of a table that arrive in a folder, per project and version."""
    rows = store.spark.readStream.schema(SCHEMAS[table]).json(folder)

    def put(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for r in batch.select("project_id", "version").distinct().collect():  # the snapshots of one batch
            mine = batch.filter((F.col("project_id") == r["project_id"]) & (F.col("version") == r["version"]))
            store.put(table, r["project_id"], r["version"], mine.drop("project_id", "version"))
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


@dataclass
class OrphanCounts:
    """Signed reference and existence counts per key, in a table that each batch of deltas moves on by one step.

    Batches hold whole edges: a corrected delivery must come in the same batch as the one it replaces, or be preceded by
    the replaced row with a negative count (``retract``).
    """

    spark: SparkSession
    root: str

    def _at(self, step: int) -> str:
        return f"{self.root}/counts-{step}"

    def current(self, step: int) -> DataFrame:
        return self.spark.read.parquet(self._at(step))

    def advance(self, step: int, edges: DataFrame, nodes: DataFrame, retract: DataFrame | None = None) -> DataFrame:
        """Write the state of ``step`` from that of the step before; run again, it writes the same."""
        parts = [reference_counts(edges, nodes)]
        if retract is not None:
            gone = reference_counts(retract, nodes.limit(0))
            parts.append(gone.withColumns({"refs": -F.col("refs"), "first_ref": F.lit(None).cast("timestamp")}))
        if step:
            parts.append(self.current(step - 1))
        merge_counts(*parts).write.mode("overwrite").parquet(self._at(step))
        return self.current(step)

    def orphans(self, step: int) -> DataFrame:
        """project_id, version, id, refs of the keys with references and no existence."""
        hit = self.current(step).filter((F.col("refs") > 0) & (F.col("exists") == 0))
        return hit.select("project_id", "version", unpack_id(F.col("ref")).alias("id"), "refs")


def stream_orphans(counts: OrphanCounts, edge_folder: str, checkpoint: str, nodes: DataFrame, available_now: bool = True, node_folder: str | None = None) -> StreamingQuery:
    """Advance the counts with each batch of deliveries. ``nodes`` enter with the first; those that arrive in ``node_folder`` later
    clear the orphans that waited for them."""
    spark = counts.spark
    arrived = spark.readStream.schema(EDGE_DELIVERIES).json(edge_folder).withColumn("_node", F.lit(False))
    if node_folder is not None:
        late = spark.readStream.schema(NODE_DELIVERIES).json(node_folder).withColumn("_node", F.lit(True))
        arrived = arrived.unionByName(late, allowMissingColumns=True)

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        new = batch.filter("_node").select("id", "project_id", "version", "loaded_at")
        if number == 0:
            new = new.unionByName(nodes.select("id", "project_id", "version", "loaded_at"))
        counts.advance(number, batch.filter("not _node"), new)
        batch.unpersist()

    writer = arrived.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
