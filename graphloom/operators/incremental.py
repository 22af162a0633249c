"""Analysis of a new version: units without a changed file keep their rows, the others are parsed again.

Rows of removed units and of symbols no longer there do not stay behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import SNAP
from graphloom.operators.relations import changed_units, manifest_changes
from graphloom.sources.items import parse_files


def units_to_parse(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """project_id, version, unit_name of the units to parse in each version: all of a first version, else the changed ones."""
    first = manifest.select(*SNAP, "unit_name").distinct().join(pairs.select("project_id", F.col("to_version").alias("version")), SNAP, "left_anti")
    changed = changed_units(manifest_changes(manifest, pairs)).select("project_id", F.col("to_version").alias("version"), "unit_name")
    there = manifest.select(*SNAP, "unit_name").distinct()
    return first.unionByName(changed.join(there, [*SNAP, "unit_name"], "left_semi"))


def analyse(manifest: DataFrame, files: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items of all versions: SNAP, path, unit_name, qualified_name, kind, sub_kind, name, parent, copied; and the units parsed.

    Rows of units without a changed file are taken over from the version before, the others parsed again; chains of takeovers end at the
    version that last parsed the unit, so each unit's files are parsed once per change. files: path, content.
    """
    parsed = units_to_parse(manifest, pairs).distinct()
    held = manifest.select(*SNAP, "unit_name", "path").distinct()
    # The version whose rows a unit has: the last one up to this that parsed it.
    w = Window.partitionBy("project_id", "unit_name").orderBy("version")
    at = held.select(*SNAP, "unit_name").distinct().join(parsed.withColumn("own", F.col("version")), [*SNAP, "unit_name"], "left")
    at = at.withColumn("from_version", F.last("own", ignorenulls=True).over(w)).drop("own")
    wanted = held.join(parsed, [*SNAP, "unit_name"], "left_semi").select("path").distinct()
    items, _ = parse_files(files.join(wanted, "path", "left_semi"))
    fresh = held.join(parsed, [*SNAP, "unit_name"], "left_semi").withColumnRenamed("version", "from_version").join(items, "path")
    fresh = fresh.select("project_id", "from_version", "unit_name", "path", "qualified_name", "kind", "sub_kind", "name", "parent")
    out = at.join(fresh, ["project_id", "from_version", "unit_name"]).withColumn("copied", F.col("from_version") != F.col("version"))
    return out.select(*SNAP, "path", "unit_name", "qualified_name", "kind", "sub_kind", "name", "parent", "copied"), parsed


def removed(manifest: DataFrame, pairs: DataFrame, what: str = "unit_name") -> DataFrame:
    """project_id, version, ``what`` that the version before still had: copying old rows forward would keep them as ghosts."""
    u = manifest.select(*SNAP, what).distinct()
    old = u.join(pairs.withColumnRenamed("from_version", "version"), SNAP).select("project_id", F.col("to_version").alias("version"), what)
    return old.join(u, [*SNAP, what], "left_anti")
