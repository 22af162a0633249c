"""Session helpers: shared scratch folder, written tables, skew-safe lookups, size-checked broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least this share of the probing rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 500
#: Fewest rows that make a key hot.
HOT_ROWS = 50_000
#: Pieces into which the rows of a hot key are split.
SALTS = 16
#: Largest row count of a table that is broadcast on purpose.
BROADCAST_ROWS = 10_000

_local_dir: str | None = None
_shipped: set[str] = set()
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one in local mode when that is unset."""
    global _local_dir
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="graphloom-")
    return _local_dir


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone; the folder's owner cleans up
            return


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only once the table is counted and found to be at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot_hashes(df: DataFrame, keys: list[str], share: float = HOT_SHARE, at_least: int = HOT_ROWS) -> list[int]:
    """Hashes of the key combinations with at least ``share`` of the rows and ``at_least`` rows.

    Counts combine on the map side; at most 1/share values reach the driver. A hash met by a second key only
    salts that key too.
    """
    counts = df.groupBy(F.xxhash64(*keys).alias("h")).count()
    counts = counts.filter(F.col("count") >= at_least)
    found = counts.orderBy(F.desc("count")).limit(int(1 / share) + 1).collect()
    if not found:
        return []
    total = df.count()
    return [r["h"] for r in found if r["count"] >= share * total]


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, spread: Column, hot: list[int] | None = None) -> DataFrame:
    """Join ``left`` to the lookup ``right`` on ``keys``; rows of hot keys are spread over SALTS pieces by ``spread``.

    The lookup's rows of hot keys are repeated SALTS times, all others stay single. ``how`` is inner, left,
    left_semi or left_anti. Without hot keys this is the plain join.
    """
    if hot is None:
        hot = hot_hashes(left, keys)
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    every = F.array(*[F.lit(i) for i in range(SALTS)])
    spread_right = right.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return salted.join(spread_right, [*keys, "_salt"], how).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per session, so that they need no installation of it.

    The archive goes out through Spark's own file server; nothing is read from the driver's disk elsewhere.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    if not here.is_dir():
        return  # it already came as an archive
    archive = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path("graphloom") / f.relative_to(here))
    spark.sparkContext.addPyFile(str(archive))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when a small table is read as fewer splits than there are cores; a large one is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
