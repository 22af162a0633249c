"""Joins between nodes and edges, and the integrity and diff joins built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import ancestor_paths, path_depth
from graphloom.graph import SNAP, of_kind


def linked(edges: DataFrame, nodes: DataFrame, kind: str, reverse: bool = False) -> DataFrame:
    """SNAP, id, other_id, other_path: distinct nodes one edge of a kind away."""
    a, b = ("target", "source") if reverse else ("source", "target")
    n = nodes.select(*SNAP, F.col("id").alias("other_id"), F.col("canonical_path").alias("other_path"))
    e = of_kind(edges, kind).select(*SNAP, F.col(a).alias("id"), F.col(b).alias("other_id")).filter("id is not null").distinct()
    return e.join(n, [*SNAP, "other_id"]).select(*SNAP, "id", "other_id", "other_path")


def snapshots_of(projects: DataFrame, snapshots: DataFrame) -> DataFrame:
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    return snapshots.join(p, "project_id").select("project_id", "project", "version", "kind").orderBy("project_id", "version")


def missing_ends(edges: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """SNAP, edge_id, endpoint, ref: one row per end that is no node of the snapshot and not shared."""
    end = F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), F.col("source").alias("ref")), F.struct(F.lit("target").alias("endpoint"), F.col("target").alias("ref"))))
    e = edges.select(*SNAP, F.col("id").alias("edge_id"), end.alias("x")).select(*SNAP, "edge_id", "x.endpoint", "x.ref").filter("ref is not null")
    e = e.join(nodes.select(*SNAP, F.col("id").alias("ref")), [*SNAP, "ref"], "left_anti")
    return e.join(shared.select(F.col("id").alias("ref")), "ref", "left_anti").select(*SNAP, "edge_id", "endpoint", "ref")


def from_level(edges: DataFrame, nodes: DataFrame, kind: str, level: str) -> DataFrame:
    """SNAP, target, n: edges of a kind whose source is of a node kind, counted per target."""
    src = nodes.filter(F.col("kind") == level).select(*SNAP, F.col("id").alias("source"))
    return of_kind(edges, kind).join(src, [*SNAP, "source"], "left_semi").filter("target is not null").groupBy(*SNAP, "target").agg(F.count(F.lit(1)).alias("n"))


def path_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNAP, edge_id, source_path, target_path, kind; edges with an unresolved end are left out."""
    n = nodes.select(*SNAP, "id", "canonical_path")
    a = n.select(*SNAP, F.col("id").alias("source"), F.col("canonical_path").alias("source_path"))
    b = n.select(*SNAP, F.col("id").alias("target"), F.col("canonical_path").alias("target_path"))
    return edges.join(a, [*SNAP, "source"]).join(b, [*SNAP, "target"]).select(*SNAP, F.col("id").alias("edge_id"), "source_path", "target_path", "kind")


def phantom_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNAP, id, kind, sub_kind, label, canonical_path of parents that no node is, derived from their smallest child path."""
    n = nodes.select(*SNAP, F.col("id").alias("target"), F.col("canonical_path").alias("child_path"))
    e = of_kind(edges, "contains").filter("source is not null").select(*SNAP, "source", "target").distinct()
    lost = e.join(nodes.select(*SNAP, F.col("id").alias("source")), [*SNAP, "source"], "left_anti").join(n, [*SNAP, "target"], "left")
    path = F.regexp_replace(F.min("child_path"), "/[^/]*$", "")
    p = lost.groupBy(*SNAP, F.col("source").alias("id")).agg(path.alias("canonical_path"))
    return p.select(*SNAP, "id", F.lit("component").alias("kind"), F.lit("phantom").alias("sub_kind"), F.coalesce(F.nullif(F.substring_index("canonical_path", "/", -1), F.lit("")), "id").alias("label"), F.coalesce("canonical_path", F.lit("")).alias("canonical_path"))


def unimplemented(design: DataFrame, analysis: DataFrame, by: list[str]) -> DataFrame:
    """by, canonical_path of design paths that no analysis path equals or lies below.

    Each analysis path is spread into its prefixes, so the prefix condition becomes an equi anti join.
    """
    below = analysis.select(*by, F.explode(F.array_append(ancestor_paths(F.col("canonical_path")), F.col("canonical_path"))).alias("canonical_path")).distinct()
    return design.select(*by, "canonical_path").distinct().join(below, [*by, "canonical_path"], "left_anti")


def undocumented(design: DataFrame, analysis: DataFrame, by: list[str]) -> DataFrame:
    """by, canonical_path of analysis paths that the design lacks, down to the design's depth."""
    deepest = design.groupBy(*by).agg(F.max(path_depth(F.col("canonical_path"))).alias("deepest"))
    a = analysis.select(*by, "canonical_path").distinct().join(deepest, by)
    a = a.filter(path_depth(F.col("canonical_path")) <= F.col("deepest"))
    return a.join(design.select(*by, "canonical_path").distinct(), [*by, "canonical_path"], "left_anti").select(*by, "canonical_path")


def manifest_changes(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """project_id, from_version, to_version, path, unit_name, change (added, removed, modified) between the versions of pairs."""
    m = manifest.select(*SNAP, "path", "hash", "unit_name")
    old = m.join(pairs.withColumnRenamed("from_version", "version"), SNAP).select("project_id", F.col("version").alias("from_version"), "to_version", "path", F.struct("hash", "unit_name").alias("old"))
    new = m.join(pairs.withColumnRenamed("to_version", "version"), SNAP).select("project_id", "from_version", F.col("version").alias("to_version"), "path", F.struct("hash", "unit_name").alias("new"))
    both = old.join(new, ["project_id", "from_version", "to_version", "path"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old.hash").eqNullSafe(F.col("new.hash")), "modified")
    return both.select("project_id", "from_version", "to_version", "path", F.coalesce("new.unit_name", "old.unit_name").alias("unit_name"), change.alias("change")).filter("change is not null")


def changed_units(changes: DataFrame) -> DataFrame:
    return changes.select("project_id", "from_version", "to_version", "unit_name").distinct()


def workspace_dependencies(units: DataFrame) -> DataFrame:
    """project_id, name, dependency: declared dependencies that name another unit of the project ('-' and '_' alike)."""
    def key(c):
        return F.lower(F.replace(c, F.lit("_"), F.lit("-")))

    u = units.select("project_id", "name", "module_path", "workspace_dependencies").filter("name is not null")
    known = u.select("project_id", F.explode(F.array_compact(F.array(key(F.col("name")), F.lower("module_path")))).alias("key"), F.col("name").alias("dependency")).distinct()
    want = u.select("project_id", "name", F.explode("workspace_dependencies").alias("declared")).filter("declared is not null")
    want = want.select("project_id", "name", F.explode(F.array_distinct(F.array(key(F.col("declared")), F.lower("declared")))).alias("key"))
    return want.join(known, ["project_id", "key"]).filter(F.col("name") != F.col("dependency")).select("project_id", "name", "dependency").distinct()


def nearest_lines(items: DataFrame, measures: DataFrame, value: str) -> DataFrame:
    """file, line, ``value``: the measure at the item's line, else the line before, else the line after."""
    spread = measures.select("file", F.explode(F.array(F.struct(F.col("line").alias("line"), F.lit(0).alias("p")), F.struct((F.col("line") + 1).alias("line"), F.lit(1).alias("p")), F.struct((F.col("line") - 1).alias("line"), F.lit(2).alias("p")))).alias("x"), value)
    best = spread.select("file", "x.line", "x.p", value).groupBy("file", "line").agg(F.min_by(value, "p").alias(value))
    return items.join(best, ["file", "line"], "left")
