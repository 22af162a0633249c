"""Point lookups, filters and projections on a graph's frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import glob_match
from graphloom.graph import SNAP
from graphloom.operators.trees import above, below


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def node_by_path(nodes: DataFrame, path: str) -> DataFrame:
    """One node per snapshot; of several with the path the one with the smallest id."""
    hit = nodes.filter(F.col("canonical_path") == path)
    return hit.groupBy(*SNAP).agg(F.min_by(F.struct(*[c for c in hit.columns if c not in SNAP]), "id").alias("n")).select(*SNAP, "n.*")


def edges_of(edges: DataFrame, node_id: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """Edges at a node: out, in or both (a self loop once)."""
    out, into = F.col("source") == node_id, F.col("target") == node_id
    hit = edges.filter({"out": out, "in": into, "both": out | into}[direction])
    return hit.filter(F.col("kind") == kind) if kind else hit


def filter_nodes(nodes: DataFrame, kind: str | None = None, sub_kind: str | None = None, language: str | None = None) -> DataFrame:
    """All given values must match; a null never does."""
    for c, v in (("kind", kind), ("sub_kind", sub_kind), ("language", language)):
        if v is not None:
            nodes = nodes.filter(F.col(c) == v)
    return nodes


def search(nodes: DataFrame, pattern: str) -> DataFrame:
    if not pattern:
        raise ValueError("the pattern is empty")
    return nodes.filter(glob_match(F.col("canonical_path"), pattern))


def distinct_values(nodes: DataFrame, column: str) -> DataFrame:
    return nodes.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("value")).distinct().orderBy("value")


def is_test(metadata: Column) -> Column:
    """The metadata's tags hold 'test'."""
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(metadata, "$.tags"), "array<string>"), "test"), F.lit(False))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes of their snapshot."""
    keys = nodes.select(*SNAP, "id")
    return edges.join(keys.withColumnRenamed("id", "source"), [*SNAP, "source"], "left_semi").join(keys.withColumnRenamed("id", "target"), [*SNAP, "target"], "left_semi")


def view_filter(nodes: DataFrame, edges: DataFrame, links: DataFrame, keep: Column, edge_kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, with all their ancestors, and the edges between them of the allowed kinds (containment always)."""
    kept = nodes.join(above(links, nodes.filter(keep).select(*SNAP, "id")), [*SNAP, "id"], "left_semi")
    e = within(edges, kept)
    return kept, e if edge_kinds is None else e.filter(F.col("kind").isin("contains", *edge_kinds))


def subtree(nodes: DataFrame, edges: DataFrame, links: DataFrame, root_path: str) -> tuple[DataFrame, DataFrame]:
    """The node at a path with all below it, and the edges inside."""
    kept = nodes.join(below(links, node_by_path(nodes, root_path).select(*SNAP, "id")), [*SNAP, "id"], "left_semi")
    return kept, within(edges, kept)


def view_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNAP, id, label, kind, sub_kind, canonical_path, language, parent (of several the largest id)."""
    parent = edges.filter(F.col("kind") == "contains").groupBy(*SNAP, F.col("target").alias("id")).agg(F.max("source").alias("parent"))
    return nodes.select(*SNAP, "id", F.col("name").alias("label"), "kind", "sub_kind", "canonical_path", "language").join(parent, [*SNAP, "id"], "left")
