"""What changed between consecutive full snapshots, by content-defined chunks.

The rows of all snapshots of a project are range-partitioned and sorted by key together. A key whose hash is 0 modulo
CHUNK_ROWS opens a new chunk, in every snapshot alike, so a change moves no other chunk's bounds. Each chunk of each
snapshot gets a digest (count and two xor-ed row hashes); chunks with equal digests in both snapshots of a pair are
dropped, and only rows of the others are brought together by key and compared field by field.

Nodes are keyed by canonical path. Edges are keyed by the 128-bit hashes of both ends' paths and the kind; the paths
are joined again to the changed edges only.

Defined results: a node with a null path takes part in nothing; two nodes of a snapshot with one path count as the one
whose compared fields sort first; a null edge kind counts as ''; edges with an end that is neither a node of the
snapshot nor shared are left out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from graphloom.runtime import HOT_SHARE, broadcast_if_small, hot_hashes, salted_join, union_all, write_table
from graphloom.tables import latest, norm_id, norm_path, pack_id, packed_edges, packed_nodes

#: Mean number of keys in a chunk.
CHUNK_ROWS = 64
COMPARED = ["kind", "sub_kind", "language", "provenance", "source_ref"]


def snapshot_pairs(nodes: DataFrame) -> DataFrame:
    """project_id, from_version, to_version: neighbours in version order among the snapshots that hold nodes."""
    have = nodes.filter(F.col("project_id").isNotNull() & F.col("version").isNotNull()).select("project_id", "version").distinct()
    nxt = F.lead("version").over(Window.partitionBy("project_id").orderBy("version"))
    return have.select("project_id", F.col("version").alias("from_version"), nxt.alias("to_version")).filter(F.col("to_version").isNotNull())


def _number_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``chunk``; a partition arrives sorted by key, key_hash tells keys apart and opens the chunks."""
    number, last = TaskContext.get().partitionId() << 40, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(batch.schema.get_field_index("key_hash")).to_numpy(zero_copy_only=False)
        before = np.concatenate([[h[0] if last is None else last], h[:-1]])
        opens = (h != before) & (h % CHUNK_ROWS == 0)
        chunk = number + np.cumsum(opens)
        number, last = int(chunk[-1]), h[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int64())], names=[*batch.schema.names, "chunk"])


def chunked(rows: DataFrame, key: list[str], fields: list[str], name: str) -> DataFrame:
    """One row per (project_id, version, key) with its chunk and two row hashes, as a written table sorted by key."""
    ranged = rows.repartitionByRange("project_id", *key)
    group = ["project_id", *key, "version"]
    if fields:
        one = ranged.groupBy(*group).agg(F.min(F.struct(*fields)).alias("f")).select(*group, *[F.col(f"f.{c}").alias(c) for c in fields])
    else:
        one = ranged.groupBy(*group).agg(F.lit(1).alias("_")).drop("_")  # set semantics; the ranges already bring equal rows together
    one = one.withColumn("key_hash", F.xxhash64("project_id", *key)).sortWithinPartitions(*group)
    out = one.mapInArrow(_number_chunks, StructType([*one.schema.fields, StructField("chunk", LongType(), False)]))
    return write_table(out, name)


def changed_chunks(rows: DataFrame, pairs: DataFrame, fields: list[str]) -> DataFrame:
    """project_id, chunk, from_version, to_version of the chunks whose digests differ."""
    told = [x for c in fields for x in (F.coalesce(c, F.lit("")), F.col(c).isNull())]
    r = rows.select("project_id", "version", "chunk", F.xxhash64("key_hash", *told).alias("a"), F.xxhash64(F.lit(7), "key_hash", *told).alias("b"))
    digests = r.groupBy("project_id", "version", "chunk").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    digest = F.struct("n", "a", "b")
    old = digests.join(pairs.withColumnRenamed("from_version", "version"), ["project_id", "version"]).select("project_id", "chunk", F.col("version").alias("from_version"), "to_version", digest.alias("old"), F.lit(None).cast(digest_type).alias("new"))
    new = digests.join(pairs.withColumnRenamed("to_version", "version"), ["project_id", "version"]).select("project_id", "chunk", "from_version", F.col("version").alias("to_version"), F.lit(None).cast(digest_type).alias("old"), digest.alias("new"))
    both = old.unionByName(new).groupBy("project_id", "chunk", "from_version", "to_version").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).drop("old", "new")


digest_type = "struct<n:bigint,a:bigint,b:bigint>"


def _sides(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of changed chunks, once per pair and side."""
    sides = F.explode(F.array(F.struct(F.col("from_version").alias("version"), F.lit(False).alias("is_new")), F.struct(F.col("to_version").alias("version"), F.lit(True).alias("is_new"))))
    wanted = chunks.withColumn("side", sides).select("project_id", "chunk", "from_version", "to_version", "side.version", "side.is_new")
    return rows.join(wanted, ["project_id", "chunk", "version"])


def node_rows(nodes: DataFrame) -> DataFrame:
    n = packed_nodes(nodes, norm_path(F.col("canonical_path")).alias("path"), *COMPARED)
    return latest(n, ["project_id", "version", "node"]).filter(F.col("path").isNotNull() & F.col("project_id").isNotNull())


def node_changes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """project_id, from_version, to_version, path, change, and the compared fields of both sides."""
    rows = chunked(node_rows(nodes).select("project_id", "version", "path", *COMPARED), ["path"], COMPARED, "node-rows")
    sides = _sides(rows, changed_chunks(rows, pairs, COMPARED))
    f = F.struct(*COMPARED)
    both = sides.groupBy("project_id", "from_version", "to_version", "path").agg(F.max(F.when(~F.col("is_new"), f)).alias("old"), F.max(F.when(F.col("is_new"), f)).alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).filter(F.col("change").isNotNull())


def path_key(path) -> F.Column:
    return F.unhex(F.md5(path))


def resolved_edges(edges: DataFrame, nodes: DataFrame, shared_nodes: DataFrame) -> DataFrame:
    """project_id, version, s, t (path hashes), kind of the counting edges whose ends both resolve, as a set."""
    at = latest(packed_nodes(nodes, path_key(norm_path(F.col("canonical_path"))).alias("at")), ["project_id", "version", "node"]).select("project_id", "version", "node", "at").filter(F.col("at").isNotNull())
    shared = shared_nodes.select(pack_id(norm_id(F.col("id"))).alias("node"), path_key(norm_path(F.col("canonical_path"))).alias("shared_at")).filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("shared_at").alias("shared_at"))
    shared = broadcast_if_small(shared)
    e = packed_edges(edges, F.coalesce("kind", F.lit("")).alias("kind"))
    # Hot ends of either side, told from all deliveries in one pass; one hot on one side only is salted on both.
    ends = e.select("project_id", "version", F.explode(F.array("src", "tgt")).alias("node")).filter("node is not null")
    hot = hot_hashes(ends, ["project_id", "version", "node"], HOT_SHARE / 2)
    e = latest(e, ["project_id", "version", "edge"]).filter(F.col("src").isNotNull() & F.col("tgt").isNotNull()).drop("loaded_at", "edge")
    for end, name, spread, h in (("src", "s", "tgt", hot), ("tgt", "t", "s", hot)):
        e = salted_join(e.withColumnRenamed(end, "node"), at, ["project_id", "version", "node"], "left", F.col(spread), h)
        e = e.join(shared, "node", "left").withColumn(name, F.coalesce("at", "shared_at")).drop("node", "at", "shared_at").filter(F.col(name).isNotNull())
    return e.select("project_id", "version", "s", "t", "kind").distinct()  # a set before it is ranged: ends joined by very many edges are one row


def edge_changes(edges: DataFrame, nodes: DataFrame, shared_nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """project_id, from_version, to_version, source_path, target_path, edge_kind, change."""
    key = ["s", "t", "kind"]
    rows = chunked(resolved_edges(edges, nodes, shared_nodes).filter(F.col("project_id").isNotNull()), key, [], "edge-rows")
    sides = _sides(rows, changed_chunks(rows, pairs, []))
    both = sides.groupBy("project_id", "from_version", "to_version", *key).agg(F.max("is_new").alias("in_new"), F.min("is_new").alias("only_new"))
    both = both.filter(F.col("in_new") == F.col("only_new")).withColumn("change", F.when(F.col("in_new"), "added").otherwise("removed"))
    both = write_table(both.drop("in_new", "only_new"), "edge-changes")  # read for hot keys and for both joins
    paths = union_all([nodes.select(norm_path(F.col("canonical_path")).alias("path")), shared_nodes.select(norm_path(F.col("canonical_path")).alias("path"))]).filter("path is not null").distinct().withColumn("at", path_key(F.col("path")))
    for end, name in (("s", "source_path"), ("t", "target_path")):
        both = both.withColumnRenamed(end, "at")
        both = salted_join(both, paths, ["at"], "inner", F.xxhash64(*[c for c in both.columns if c != "at"])).withColumnRenamed("path", name).drop("at")
    return both.select("project_id", "from_version", "to_version", "source_path", "target_path", F.col("kind").alias("edge_kind"), "change")


def snapshot_changes(nodes: DataFrame, edges: DataFrame, shared_nodes: DataFrame) -> DataFrame:
    """project_id, from_version, to_version, item, source_path, target_path, edge_kind, change."""
    pairs = write_table(snapshot_pairs(nodes), "pairs")
    empty = F.lit("")
    n = node_changes(nodes, pairs).select("project_id", "from_version", "to_version", F.lit("node").alias("item"), F.col("path").alias("source_path"), empty.alias("target_path"), empty.alias("edge_kind"), "change")
    e = edge_changes(edges, nodes, shared_nodes, pairs).select("project_id", "from_version", "to_version", F.lit("edge").alias("item"), "source_path", "target_path", "edge_kind", "change")
    return n.unionByName(e)
