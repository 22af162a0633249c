"""One snapshot behind methods that give rows: what a server or a notebook asks for."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import SNAP, of_kind
from graphloom.operators import aggregates as ag
from graphloom.operators import lookups as lk
from graphloom.operators import relations as rl
from graphloom.operators import traversal as tv
from graphloom.operators import trees as tr
from graphloom.runtime import write_table


@dataclass
class SnapshotView:
    """nodes and edges of one (project, version)."""

    nodes: DataFrame
    edges: DataFrame

    @cached_property
    def links(self) -> DataFrame:
        return tr.parent_table(self.nodes, self.edges)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """View nodes with parents (phantom parents added), and all edges but containment."""
        n = lk.view_nodes(self.nodes, self.edges)
        p = rl.phantom_parents(self.edges, self.nodes)
        p = p.select(*SNAP, "id", "label", "kind", "sub_kind", "canonical_path", F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("parent"))
        return n.unionByName(p), self.edges.filter("kind <> 'contains'")

    def node(self, node_id: str) -> DataFrame:
        return lk.node_by_id(self.nodes, node_id)

    def node_by_path(self, path: str) -> DataFrame:
        return lk.node_by_path(self.nodes, path)

    def children(self, node_id: str) -> DataFrame:
        return rl.linked(self.edges, self.nodes, "contains").filter(F.col("id") == node_id)

    def parent(self, node_id: str) -> DataFrame:
        return rl.linked(self.edges, self.nodes, "contains", reverse=True).filter(F.col("id") == node_id)

    def ancestors(self, node_id: str) -> DataFrame:
        return tr.ancestors(self.links, self.nodes.filter(F.col("id") == node_id).select(*SNAP, "id"))

    def descendants(self, node_id: str, **kinds: str) -> DataFrame:
        below = tr.below(self.links, self.nodes.filter(F.col("id") == node_id).select(*SNAP, "id")).filter("dist > 0")
        return lk.filter_nodes(self.nodes, **kinds).join(below, [*SNAP, "id"])

    def dependencies(self, node_id: str, transitive: bool = False) -> DataFrame:
        return self._depend(node_id, transitive, False)

    def dependents(self, node_id: str, transitive: bool = False) -> DataFrame:
        return self._depend(node_id, transitive, True)

    def _depend(self, node_id: str, transitive: bool, reverse: bool) -> DataFrame:
        if not transitive:
            return lk.edges_of(self.edges, node_id, "in" if reverse else "out", "depends")
        return tv.reachable(self.edges, self.nodes.filter(F.col("id") == node_id).select(*SNAP, "id"), reverse=reverse)

    def search(self, pattern: str) -> DataFrame:
        return lk.search(self.nodes, pattern)

    def roots(self) -> DataFrame:
        return ag.roots(self.nodes, self.edges)

    def edges_by_kind(self, kind: str | None = None) -> DataFrame:
        return of_kind(self.edges, kind) if kind else self.edges

    def view(self, focus: str | None, expanded: DataFrame, keep=None, edge_kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The order of a view: the subtree of a path, then what is hidden merged, then the filters if any are active."""
        n, e, links = self.nodes, self.edges, self.links
        if focus:
            n, e = lk.subtree(n, e, links, focus)
            inside = n.select(*SNAP, F.col("id").alias("node"))
            links = links.join(inside, [*SNAP, "node"], "left_semi")
            kept = links.join(inside.withColumnRenamed("node", "parent"), [*SNAP, "parent"], "left_semi")
            cut = links.join(kept, [*SNAP, "node"], "left_anti").withColumn("parent", F.lit(None).cast("string"))  # the focus is a root here
            links = write_table(kept.unionByName(cut), "focus")
        shown = tr.visible(links, expanded)
        meta = ag.meta_edges(e, shown)
        seen = n.join(shown.select(*SNAP, F.col("shown").alias("id")).distinct(), [*SNAP, "id"], "left_semi")
        if keep is not None:
            seen = seen.filter(keep)
        if edge_kinds is not None:
            meta = meta.filter(F.col("kind").isin(*edge_kinds))
        ends = seen.select(*SNAP, "id")
        meta = meta.join(ends.withColumnRenamed("id", "src"), [*SNAP, "src"], "left_semi").join(ends.withColumnRenamed("id", "tgt"), [*SNAP, "tgt"], "left_semi")
        return seen, meta


def toggled(values: set, value) -> set:
    """The set with the value in if it was out, and out if it was in."""
    return values ^ {value}


def filters_active(chosen: dict[str, set], offered: dict[str, set]) -> bool:
    """Whether any dimension offers more than is chosen."""
    return any(offered[k] - chosen.get(k, set()) for k in offered)


def with_single_root(nodes: DataFrame) -> DataFrame:
    """View nodes with one root per snapshot: where there are several, '__root__' above them."""
    tops = nodes.filter("parent is null").groupBy(*SNAP).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*SNAP, F.lit(True).alias("many"))
    n = nodes.join(tops, SNAP, "left").withColumn("parent", F.when(F.col("parent").isNull() & F.col("many"), F.lit("__root__")).otherwise(F.col("parent"))).drop("many")
    root = tops.select(*SNAP, F.lit("__root__").alias("id"))
    for c in nodes.columns:
        if c not in root.columns:
            root = root.withColumn(c, F.lit("root" if c == "label" else None).cast(nodes.schema[c].dataType))
    return n.unionByName(root)
