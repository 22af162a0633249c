"""Reading the tables, and the meaning shared by all operators: normal ids and paths, the delivery that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
_UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_id(c: Column) -> Column:
    """Trimmed and lower-cased; a blank id is null."""
    t = F.lower(F.trim(c, F.lit(BLANKS)))
    return F.when(t != "", t)


def norm_path(c: Column) -> Column:
    """Trimmed, lower-cased, without trailing slashes."""
    return F.rtrim(F.lower(F.trim(c, F.lit(BLANKS))), F.lit("/"))


def pack_id(c: Column) -> Column:
    """A normal id as binary: 16 bytes for a UUID, otherwise its text closed by 0xFF (never 16 bytes). One to one."""
    raw = F.encode(c, "utf-8")
    closed = F.concat(raw, F.unhex(F.lit("FF")))
    return F.when(c.rlike(_UUID), F.unhex(F.translate(c, "-", ""))).otherwise(
        F.when(F.length(raw) == 15, F.concat(closed, F.unhex(F.lit("FF")))).otherwise(closed)
    )


def unpack_id(c: Column) -> Column:
    """The inverse of pack_id."""
    h = F.lower(F.hex(c))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    text = F.decode(F.unhex(F.regexp_replace(h, "(ff)+$", "")), "utf-8")
    return F.when(F.length(c) == 16, uuid).otherwise(text)


def superseded(keys: list[str], *ties: str) -> Column:
    """True where a later delivery of the same key exists (of equal ones all but one, the largest in ``ties``)."""
    return F.lead(F.lit(True), 1, False).over(Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in ("loaded_at", *ties)]))


def latest(df: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """The delivery that counts of each key. One shuffle on the key; no map-side sort."""
    return df.withColumn("_old", superseded(keys, *ties)).filter(~F.col("_old")).drop("_old")


_KEYED = "project_id is not null and version is not null"


def packed_edges(edges: DataFrame, *extra: Column) -> DataFrame:
    """All deliveries of edges with packed ids; rows without project, version or id are no edges."""
    return edges.select(
        "project_id",
        "version",
        pack_id(norm_id(F.col("id"))).alias("edge"),
        pack_id(norm_id(F.col("source"))).alias("src"),
        pack_id(norm_id(F.col("target"))).alias("tgt"),
        "loaded_at",
        *extra,
    ).filter(F.col("edge").isNotNull()).filter(_KEYED)


def packed_nodes(nodes: DataFrame, *extra: Column) -> DataFrame:
    """All deliveries of nodes with packed ids; rows without project, version or id are no nodes."""
    return nodes.select("project_id", "version", pack_id(norm_id(F.col("id"))).alias("node"), "loaded_at", *extra).filter(F.col("node").isNotNull()).filter(_KEYED)
