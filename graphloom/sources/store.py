"""A versioned graph store on Parquet: tables partitioned by (project_id, version), upserts by key, copies, compaction.

Writes replace whole partitions (dynamic partition overwrite), so a failed write leaves the old partitions in place and
readers never see half a snapshot. Readers prune partitions by project and version.
"""

from __future__ import annotations

import json
import re
import shutil
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
KEYS = {"nodes": ["id"], "edges": ["id"], "constraints": ["id"], "file_manifest": ["path"]}
SCHEMAS = {
    "nodes": "id string, canonical_path string, qualified_name string, kind string, sub_kind string, name string, language string, provenance string, source_ref string, metadata string, project_id string, version long",
    "edges": "id string, source string, target string, kind string, provenance string, metadata string, project_id string, version long",
    "constraints": "id string, kind string, name string, scope string, target string, params string, message string, severity string, project_id string, version long",
    "file_manifest": "path string, hash string, unit_name string, language string, project_id string, version long",
    "snapshots": "kind string, commit_ref string, created_at string, metadata string, project_id string, version long",
    "projects": "id string, name string, created_at string, description string, metadata string",
}


class StoreError(ValueError):
    """A request that the store refuses."""


@dataclass
class Store:
    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self._check_schema()

    # -- layout

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _exists(self, table: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._path(table)))

    def _check_schema(self) -> None:
        """Refuse a store written by a newer schema; note the schema of a new one."""
        fs, path = self._fs()
        mark = path(f"{self.root}/_schema")
        if fs.exists(mark):
            found = self.spark.read.text(f"{self.root}/_schema").first()
            if found and int(json.loads(found[0])["schema"]) > SCHEMA_VERSION:
                raise StoreError(f"the store has schema {json.loads(found[0])['schema']}, this library knows {SCHEMA_VERSION}")
        else:
            self.spark.createDataFrame([(json.dumps({"schema": SCHEMA_VERSION}),)], "value string").coalesce(1).write.text(f"{self.root}/_schema")

    def schema_version(self) -> int:
        return int(json.loads(self.spark.read.text(f"{self.root}/_schema").first()[0])["schema"])

    def read(self, table: str, project: str | None = None, version: int | None = None) -> DataFrame:
        if not self._exists(table):
            df = self.spark.createDataFrame([], SCHEMAS[table])
        else:
            df = self.spark.read.schema(SCHEMAS[table]).parquet(self._path(table))
        if project is not None:
            df = df.filter(F.col("id" if table == "projects" else "project_id") == project)
        return df if version is None else df.filter(F.col("version") == version)

    def _replace(self, table: str, df: DataFrame) -> None:
        """Overwrite the partitions that df has rows in."""
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        out = df.select(*columns)
        if table == "projects":
            out.write.mode("append").parquet(self._path(table))
        else:
            out.repartition("project_id", "version").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "version").parquet(self._path(table))

    # -- projects and snapshots

    def create_project(self, project: str, name: str, description: str | None = None) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_-]{0,127}", project):
            raise StoreError(f"invalid project id {project!r}")
        if self.read("projects", project).limit(1).count():
            raise StoreError(f"project {project!r} exists")
        self._replace("projects", self.spark.createDataFrame([(project, name, _now(), description, None)], SCHEMAS["projects"]))

    def create_snapshot(self, project: str, kind: str, commit_ref: str | None = None) -> int:
        """The next version of the project."""
        last = self.read("snapshots", project).agg(F.max("version")).first()[0] or 0
        self._replace("snapshots", self.spark.createDataFrame([(kind, commit_ref, _now(), None, project, last + 1)], SCHEMAS["snapshots"]))
        return last + 1

    def latest_version(self, project: str, kind: str | None = None) -> int | None:
        s = self.read("snapshots", project)
        return (s if kind is None else s.filter(F.col("kind") == kind)).agg(F.max("version")).first()[0]

    # -- rows

    def put(self, table: str, project: str, version: int, rows: DataFrame) -> int:
        """Upsert rows by key; of several with one key the last (by ``seq`` if there is such a column) stays. Returns the rows now there."""
        old = self.read(table, project, version)
        merged = upsert(old, rows.withColumns({"project_id": F.lit(project), "version": F.lit(version).cast("long")}), KEYS[table])
        if merged.limit(1).count():
            # What is read is overwritten: the merge is written aside first.
            aside = f"{self.root}/_aside/{table}-{datetime.now(UTC).timestamp()}"
            merged.write.parquet(aside)
            merged = self.spark.read.schema(merged.schema).parquet(aside)
            self._replace(table, merged)
            n = merged.count()
            fs, path = self._fs()
            fs.delete(path(aside), True)
            return n
        return 0

    def copy(self, table: str, project: str, from_version: int, to_version: int) -> int:
        rows = self.read(table, project, from_version)
        n = rows.count()
        if n:
            self.put(table, project, to_version, rows.drop("project_id", "version"))
        return n

    def compact(self, project: str, keep: list[int] | None = None) -> list[int]:
        """Drop the versions of a project that are not kept (default: its latest design and analysis). Returns the dropped ones."""
        if keep is None:
            keep = [v for k in ("design", "analysis") if (v := self.latest_version(project, k)) is not None]
        gone = sorted(r[0] for r in self.read("snapshots", project).select("version").distinct().collect() if r[0] not in keep)
        fs, path = self._fs()
        for table in [*KEYS, "snapshots"]:  # the snapshots themselves last
            for v in gone:
                fs.delete(path(f"{self._path(table)}/project_id={project}/version={v}"), True)
        return gone

    def reset(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)
        self._check_schema()

    def push(self, project: str, kind: str, nodes: DataFrame, edges: DataFrame, constraints: DataFrame | None = None, commit_ref: str | None = None) -> dict:
        """Write a whole snapshot, creating the project if need be; returns its version and counts."""
        if not self.read("projects", project).limit(1).count():
            self.create_project(project, project)
        v = self.create_snapshot(project, kind, commit_ref)
        out = {"version": v, "nodes": self.put("nodes", project, v, nodes), "edges": self.put("edges", project, v, edges)}
        if constraints is not None:
            out["constraints"] = self.put("constraints", project, v, constraints)
        return out

    def push_to(self, project: str, version: int, target: str) -> None:
        """Write a snapshot's rows to another place, as Parquet."""
        for table in ("nodes", "edges", "constraints"):
            self.read(table, project, version).write.mode("overwrite").parquet(f"{target}/{table}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and the last of the new rows per key."""
    by = ["project_id", "version", *keys]
    order = F.col("seq") if "seq" in new.columns else F.monotonically_increasing_id()
    last = new.withColumn("_o", order).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_o")))).filter("_n = 1")
    missing = [c for c in old.columns if c not in new.columns]
    last = last.withColumns({c: F.lit(None).cast(old.schema[c].dataType) for c in missing}).select(*old.columns)
    return old.join(last.select(*by), by, "left_anti").unionByName(last)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def remove(root: str) -> None:
    """Delete a local store."""
    if Path(root).exists():
        shutil.rmtree(root)
