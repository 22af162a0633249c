"""Diagrams as DataFrames of ordered lines, nested without recursion.

A line's place in a nested diagram is an array: the paths of all ancestors, then the own path, and for a closing line a last
element above all others. Sorting by that array is the pre-order walk, so a diagram of any size is one distributed sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import export_id, web_id
from graphloom.graph import SNAP
from graphloom.operators.trees import acyclic, climb
from graphloom.runtime import write_table

_LAST = "\U0010ffff"


def placed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """SNAP, id, canonical_path, name, kind, place (array), level, is_parent of all nodes not on or below a cycle. links: SNAP, node, parent.

    Only nodes with children climb, and lists only those in trees: round a cycle a list would double until the climb gives up.
    """
    key = F.concat(F.coalesce("canonical_path", F.lit("")), F.lit("\0"), "node")
    known = nodes.select(*SNAP, F.col("id").alias("node"), "canonical_path", "name", "kind", F.lit(True).alias("known"))
    parents = links.filter("parent is not null").select(*SNAP, F.col("parent").alias("node"), F.lit(True).alias("is_parent")).distinct()
    own = links.select(*SNAP, "node", "parent").join(known, [*SNAP, "node"], "left").join(parents, [*SNAP, "node"], "left")
    own = write_table(own.withColumns({"is_parent": F.coalesce("is_parent", F.lit(False)), "key": key}), "placing")
    inner = acyclic(own.filter("is_parent").select(*SNAP, "node", "parent", "key"))
    lines = climb(inner, {"line": F.array("key")}, lambda a, b: {"line": F.concat(a["line"], b["line"])})
    above = lines.select(*SNAP, F.col("node").alias("parent"), F.reverse("line").alias("above"))
    n = own.filter("known").join(above, [*SNAP, "parent"], "left").filter("parent is null or above is not null")
    place = F.concat(F.coalesce("above", F.array().cast("array<string>")), F.array("key"))
    return n.select(*SNAP, F.col("node").alias("id"), "canonical_path", "name", "kind", place.alias("place"), (F.size(place) - 1).alias("level"), "is_parent")


def _nested(n: DataFrame, opens: Column, leaf: Column, closes: str, indent: int, inside: Column | None = None) -> DataFrame:
    """SNAP, part, place, line of the nested part, all lines of a node at once; opens, leaf and inside (a line after opens) are texts without indent."""
    def line(more: str | None, text: Column, level: int = 1) -> Column:
        place = F.col("place") if more is None else F.array_append("place", F.lit(more))
        return F.struct(place.alias("place"), F.concat(F.repeat(F.lit(" " * indent), F.col("level") + level), text).alias("line"))

    held = [line(None, opens), *([line("", inside, 2)] if inside is not None else []), line(_LAST, F.lit(closes))]
    each = F.explode(F.when(F.col("is_parent"), F.array(*held)).otherwise(F.array(line(None, leaf)))).alias("x")
    return n.select(*SNAP, each).select(*SNAP, F.lit(1).alias("part"), "x.place", "x.line")


def _fixed(snaps: DataFrame, part: int, lines: list[str]) -> DataFrame:
    each = F.posexplode(F.array(*map(F.lit, lines))).alias("k", "line")
    return snaps.select(*SNAP, F.lit(part).alias("part"), each).select(*SNAP, "part", F.array(F.format_string("%05d", "k")).alias("place"), "line")


def _edge_lines(edges: DataFrame, line: Column) -> DataFrame:
    return edges.select(*SNAP, F.lit(2).alias("part"), F.array("source_path", "target_path", "kind", "edge_id").alias("place"), line.alias("line"))


def ordered(lines: DataFrame) -> DataFrame:
    """SNAP, part, place, line in the order of each diagram."""
    return lines.orderBy(*SNAP, "part", "place")


def text_of(lines: DataFrame, project: str, version: int) -> str:
    """One snapshot's diagram as text, for the driver."""
    rows = lines.filter((F.col("project_id") == project) & (F.col("version") == version)).orderBy("part", "place").select("line").toLocalIterator()
    return "\n".join(r[0] for r in rows) + "\n"


def dot_edges(edges: DataFrame) -> DataFrame:
    """The edge lines alone: they need no hierarchy. edges: SNAP, edge_id, source_path, target_path, kind without containment."""
    return _edge_lines(edges, F.concat(F.lit("    "), export_id(F.col("source_path")), F.lit(" -> "), export_id(F.col("target_path")), F.lit(' [label="'), "kind", F.lit('"];')))


def dot_lines(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """edges as for dot_edges."""
    n = placed(nodes, links)
    snaps = nodes.select(*SNAP).distinct()
    sid, label = export_id(F.col("canonical_path")), F.replace(F.col("canonical_path"), F.lit('"'), F.lit('\\"'))
    opens = F.concat(F.lit("subgraph cluster_"), sid, F.lit(" {"))
    body = _nested(n, opens, F.concat(sid, F.lit(' [label="'), label, F.lit('"];')), "}", 4, F.concat(F.lit('label="'), label, F.lit('";')))
    head = _fixed(snaps, 0, ["digraph architecture {", "    rankdir=TB;", "    node [shape=box, style=filled, fillcolor=lightblue];"])
    return head.unionByName(body).unionByName(dot_edges(edges)).unionByName(_fixed(snaps, 3, ["}"]))


def mermaid_edges(edges: DataFrame) -> DataFrame:
    """As dot_edges."""
    return _edge_lines(edges, F.concat(F.lit("    "), export_id(F.col("source_path")), F.lit(" -->|"), "kind", F.lit("| "), export_id(F.col("target_path"))))


def mermaid_lines(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    n = placed(nodes, links)
    sid, label = export_id(F.col("canonical_path")), F.replace(F.col("canonical_path"), F.lit('"'), F.lit("#quot;"))
    box = F.concat(sid, F.lit('["'), label, F.lit('"]'))
    return _fixed(nodes.select(*SNAP).distinct(), 0, ["flowchart TD"]).unionByName(_nested(n, F.concat(F.lit("subgraph "), box), box, "end", 4)).unionByName(mermaid_edges(edges))


def c4_relations(edges: DataFrame, parents: DataFrame) -> DataFrame:
    """The relation lines alone, only between leaves: a boundary cannot end one. parents: SNAP, parent of each containment."""
    held = parents.select(*SNAP, F.col("parent").alias("x")).distinct()
    e = edges.join(held.withColumnRenamed("x", "source"), [*SNAP, "source"], "left_anti").join(held.withColumnRenamed("x", "target"), [*SNAP, "target"], "left_anti")
    line = F.concat(F.lit("    Rel("), web_id(F.col("source")), F.lit(", "), web_id(F.col("target")), F.lit(', "'), "kind", F.lit('")'))
    return e.select(*SNAP, F.lit(2).alias("part"), F.array("source", "target", "kind", "id").alias("place"), line.alias("line"))


def c4_lines(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    n = placed(nodes, links)
    k, sid = F.col("kind"), web_id(F.col("id"))
    args = F.concat(F.lit("("), sid, F.lit(', "'), F.coalesce("name", "id"), F.lit('")'))
    opens = F.concat(F.when(k == "system", "System_Boundary").when(k == "service", "Container_Boundary").otherwise("Boundary"), args, F.lit(" {"))
    leaf = F.concat(F.when(k == "system", "System").when(k == "service", "Container").otherwise("Component"), args)
    rel = c4_relations(edges, links.filter("parent is not null"))
    return _fixed(nodes.select(*SNAP).distinct(), 0, ["C4Component"]).unionByName(_nested(n, opens, leaf, "}", 4)).unionByName(rel)


def sequence_participants(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """SNAP, id, label, rank of the ends of calls by first appearance (edges in the order of their ids)."""
    ends = edges.filter("kind = 'calls'").select(*SNAP, F.posexplode(F.array("source", "target")).alias("end", "node"), F.col("id").alias("edge"))
    first = ends.filter("node is not null").groupBy(*SNAP, F.col("node").alias("id")).agg(F.min(F.struct("edge", "end")).alias("at"))
    first = first.join(nodes.select(*SNAP, "id", F.col("name").alias("label")), [*SNAP, "id"], "left")
    return first.select(*SNAP, "id", F.coalesce("label", "id").alias("label"), F.row_number().over(Window.partitionBy(*SNAP).orderBy("at")).alias("rank"))


def sequence_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    p = sequence_participants(edges, nodes)
    who = p.select(*SNAP, F.lit(1).alias("part"), F.array(F.format_string("%09d", "rank")).alias("place"), F.concat(F.lit("    participant "), web_id(F.col("id")), F.lit(" as "), "label").alias("line"))
    a, b = web_id(F.col("source")), web_id(F.col("target"))
    lines = F.posexplode(F.array(F.concat(F.lit("    "), a, F.lit("->>+"), b, F.lit(": calls")), F.concat(F.lit("    "), b, F.lit("-->>-"), a, F.lit(": return")))).alias("k", "line")
    said = edges.filter("kind = 'calls' and source is not null and target is not null").select(*SNAP, "id", lines).select(*SNAP, F.lit(2).alias("part"), F.array(F.col("id"), F.col("k").cast("string")).alias("place"), "line")
    snaps = nodes.select(*SNAP).distinct()
    none = snaps.join(said.select(*SNAP).distinct(), SNAP, "left_anti")
    return _fixed(snaps, 0, ["sequenceDiagram"]).unionByName(who).unionByName(said).unionByName(_fixed(none, 2, ["    Note over A: No call edges found"]))


def markdown_report(results: DataFrame, summary: DataFrame) -> DataFrame:
    """SNAP, part, place, line of a conformance report in Markdown."""
    s = summary.select(*SNAP, F.lit(1).alias("part"), F.array(F.lit("")).alias("place"), F.concat(F.lit("Passed "), F.col("passed"), F.lit(", failed "), F.col("failed"), F.lit(", warned "), F.col("warned"), F.lit(", not evaluable "), F.col("not_evaluable")).alias("line"))
    r = results.select(*SNAP, F.lit(2).alias("part"), F.array("constraint").alias("place"), F.concat(F.lit("- **"), F.col("constraint"), F.lit("** "), F.col("status"), F.lit(" ("), F.col("severity"), F.lit("): "), F.col("message")).alias("line"))
    return _fixed(summary.select(*SNAP), 0, ["# Conformance report", ""]).unionByName(s).unionByName(r)


def svg(dot: str, kind: str = "svg") -> bytes:
    """The diagram drawn by Graphviz, if that is installed."""
    import shutil
    import subprocess

    if shutil.which("dot") is None:
        raise RuntimeError("Graphviz is not installed")
    return subprocess.run(["dot", f"-T{kind}"], input=dot.encode(), capture_output=True, check=True).stdout
