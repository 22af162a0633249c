"""A versioned, typed property graph as DataFrames keyed by (project_id, version)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.tables import latest, norm_id, norm_path, table

SNAP = ["project_id", "version"]
NODE_COLUMNS = ["id", "canonical_path", "qualified_name", "kind", "sub_kind", "name", "language", "provenance", "source_ref", "metadata"]
EDGE_COLUMNS = ["id", "source", "target", "kind", "provenance", "metadata"]


@dataclass
class Graph:
    """Counting rows only: ids and paths in normal form, one row per key (the latest delivery; of equal times the one with the largest metadata)."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def nodes(self) -> DataFrame:
        n = self.raw("nodes")
        n = n.select(*SNAP, norm_id(n.id).alias("id"), norm_path(n.canonical_path).alias("canonical_path"), *NODE_COLUMNS[2:], "loaded_at")
        return latest(n.filter("id is not null"), [*SNAP, "id"], "metadata").drop("loaded_at")

    @cached_property
    def edges(self) -> DataFrame:
        e = self.raw("edges")
        e = e.select(*SNAP, norm_id(e.id).alias("id"), norm_id(e.source).alias("source"), norm_id(e.target).alias("target"), "kind", "provenance", "metadata", "loaded_at")
        return latest(e.filter("id is not null"), [*SNAP, "id"], "metadata").drop("loaded_at")

    @cached_property
    def snapshots(self) -> DataFrame:
        """One row per (project_id, version)."""
        return self.raw("snapshots").groupBy(*SNAP).agg(*[F.min(c).alias(c) for c in ("kind", "commit_ref", "created_at")])

    @cached_property
    def manifest(self) -> DataFrame:
        """One row per (project_id, version, path)."""
        m = self.raw("file_manifest")
        return m.filter("path is not null").groupBy(*SNAP, "path").agg(F.max("hash").alias("hash"), F.max("unit_name").alias("unit_name"), F.max("language").alias("language"))

    @cached_property
    def shared_nodes(self) -> DataFrame:
        s = self.raw("shared_nodes")
        return s.select(norm_id(s.id).alias("id"), norm_path(s.canonical_path).alias("canonical_path"), "kind", "sub_kind", "name", "language").filter("id is not null").dropDuplicates(["id"])


def of_kind(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.filter(F.col("kind").isin(*kinds))
