"""Design documents (YAML or JSON) to rows and back. A document is small; the rows are DataFrames."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import path_error
from graphloom.graph import SNAP

FORMAT = "graph/v1"
_DOCUMENT = {"format", "kind", "version", "metadata", "nodes", "edges", "constraints"}
_NODE = {"canonical_path", "kind", "name", "sub_kind", "qualified_name", "language", "provenance", "source_ref", "metadata", "children"}
_EDGE = {"source", "target", "kind", "metadata"}
_CONSTRAINT = {"name", "kind", "scope", "target", "params", "message", "severity"}
KINDS = ("system", "service", "component", "unit")
NODE_SCHEMA = "pos int, canonical_path string, kind string, name string, sub_kind string, qualified_name string, language string, provenance string, source_ref string, metadata string"
EDGE_SCHEMA = "pos int, source string, target string, kind string, metadata string"
CONSTRAINT_SCHEMA = "pos int, name string, kind string, scope string, target string, params string, message string, severity string"


class DocumentError(ValueError):
    """A document that cannot be loaded."""


def _known(what: dict, allowed: set[str], at: str) -> None:
    if not isinstance(what, dict):
        raise DocumentError(f"{at} is no mapping")
    if extra := set(what) - allowed:
        raise DocumentError(f"unknown fields in {at}: {', '.join(sorted(map(str, extra)))}")


def _checked(doc: object, nested: bool) -> dict:
    _known(doc, _DOCUMENT, "document")
    if not re.fullmatch(r"[a-z]+/v1", str(doc.get("format", ""))):
        raise DocumentError(f"unknown format {doc.get('format')!r}")
    if doc.get("kind") not in ("design", "analysis", "import"):
        raise DocumentError(f"unknown kind {doc.get('kind')!r}")
    nodes, edges = flatten(doc.get("nodes") or [], nested)
    for e in doc.get("edges") or []:
        _known(e, _EDGE, "edge")
    for c in doc.get("constraints") or []:
        _known(c, _CONSTRAINT, "constraint")
    return {**doc, "nodes": nodes, "edges": edges + list(doc.get("edges") or []), "constraints": list(doc.get("constraints") or [])}


def flatten(nodes: list[dict], nested: bool = True) -> tuple[list[dict], list[dict]]:
    """Nodes in pre-order without children, and a contains edge for each child."""
    flat, edges = [], []
    todo = [(n, None) for n in reversed(nodes)]
    while todo:
        n, parent = todo.pop()
        _known(n, _NODE, "node")
        flat.append({k: v for k, v in n.items() if k != "children"})
        if parent is not None:
            edges.append({"source": parent, "target": n["canonical_path"], "kind": "contains"})
        if n.get("children"):
            if not nested:
                raise DocumentError(f"{n.get('canonical_path')}: nested children are not allowed here")
            todo += [(c, n["canonical_path"]) for c in reversed(n["children"])]
    return flat, edges


def parse_yaml(text: str) -> dict:
    import yaml

    try:
        return _checked(yaml.safe_load(text), nested=True)
    except yaml.YAMLError as e:
        raise DocumentError(str(e)) from e


def parse_json(text: str) -> dict:
    try:
        return _checked(json.loads(text), nested=False)
    except json.JSONDecodeError as e:
        raise DocumentError(str(e)) from e


def merge(docs: list[dict]) -> dict:
    """One document of the kind of the first, with the rows of all."""
    return {**docs[0], **{k: [x for d in docs for x in d[k]] for k in ("nodes", "edges", "constraints")}}


def to_frames(spark: SparkSession, doc: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    def js(v):
        return None if v is None else json.dumps(v, sort_keys=True)

    n = [(i, x["canonical_path"], x["kind"], x.get("name"), x.get("sub_kind"), x.get("qualified_name"), x.get("language"), x.get("provenance"), x.get("source_ref"), js(x.get("metadata"))) for i, x in enumerate(doc["nodes"])]
    e = [(i, x["source"], x["target"], x["kind"], js(x.get("metadata"))) for i, x in enumerate(doc["edges"])]
    c = [(i, x["name"], x["kind"], x["scope"], x.get("target"), js(x.get("params")), x["message"], x.get("severity") or "error") for i, x in enumerate(doc["constraints"])]
    return spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA), spark.createDataFrame(c, CONSTRAINT_SCHEMA)


def check_rows(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """by, path, problem, is_error: invalid and repeated paths are errors, edge ends without a node warnings."""
    p = F.col("canonical_path")
    invalid = nodes.select(*by, p.alias("path"), path_error(p).alias("problem")).filter("problem is not null").distinct().withColumn("is_error", F.lit(True))
    twice = nodes.groupBy(*by, p.alias("path")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by, "path", F.lit("duplicate_path").alias("problem"), F.lit(True).alias("is_error"))
    known = nodes.select(*by, p.alias("path")).distinct()
    out = invalid.unionByName(twice)
    for end in ("source", "target"):
        lost = edges.select(*by, F.col(end).alias("path")).filter("path is not null").distinct().join(known, [*by, "path"], "left_anti")
        out = out.unionByName(lost.select(*by, "path", F.lit(f"unknown_{end}").alias("problem"), F.lit(False).alias("is_error")))
    return out


def load_rows(nodes: DataFrame, edges: DataFrame, doc_kind: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows with ids and defaults: the name is the last segment, the sub_kind the kind, the provenance from the document."""
    provenance = {"design": "design", "analysis": "analysis", "import": "import"}[doc_kind]
    n = nodes.select(
        F.expr("uuid()").alias("id"), "canonical_path", "qualified_name", "kind", F.coalesce("sub_kind", "kind").alias("sub_kind"),
        F.coalesce("name", F.substring_index("canonical_path", "/", -1)).alias("name"), "language", F.coalesce("provenance", F.lit(provenance)).alias("provenance"), "source_ref", "metadata",
    )
    return n, edges


def resolve_ends(nodes: DataFrame, edges: DataFrame, provenance: str) -> DataFrame:
    """Edges with paths replaced by the ids of the given (materialised) nodes; an unknown path raises."""
    a = nodes.select(F.col("canonical_path").alias("source"), F.col("id").alias("source_id"))
    b = nodes.select(F.col("canonical_path").alias("target"), F.col("id").alias("target_id"))
    e = edges.join(a, "source", "left").join(b, "target", "left")
    lost = e.filter("source_id is null or target_id is null").select("source", "target").limit(1).collect()
    if lost:
        raise DocumentError(f"edge {lost[0][0]} -> {lost[0][1]} has an unknown end")
    return e.select(F.expr("uuid()").alias("id"), F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind", F.lit(provenance).alias("provenance"), "metadata")


def load(store, project: str, doc: dict) -> int:
    """Write a document as a new snapshot of the store; returns the version."""
    nodes, edges, constraints = to_frames(store.spark, doc)
    errors = check_rows(nodes, edges, []).filter("is_error").limit(1).collect()
    if errors:
        raise DocumentError(f"{errors[0]['path']}: {errors[0]['problem']}")
    n, e = load_rows(nodes, edges, doc["kind"])
    known = {r["canonical_path"] for r in nodes.select("canonical_path").collect()}  # a document fits on the driver: it came from there
    for r in edges.select("source", "target").collect():
        if not {r["source"], r["target"]} <= known:
            raise DocumentError(f"edge {r['source']} -> {r['target']} has an unknown end")
    v = store.create_snapshot(project, doc["kind"])
    store.put("nodes", project, v, n)
    there = store.read("nodes", project, v)
    store.put("edges", project, v, resolve_ends(there, e, doc["kind"]))
    store.put("constraints", project, v, constraints.withColumn("id", F.expr("uuid()")).drop("pos"))
    return v


def documents(nodes: DataFrame, edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """SNAP, document (JSON) of each snapshot, flat, rows sorted; edges with an unresolved end are left out.

    A document holds a whole snapshot as one value; ``rows`` below writes the same line by line for snapshots of any size.
    """
    n = nodes.groupBy(*SNAP).agg(F.array_sort(F.collect_list(F.struct("canonical_path", "kind", "sub_kind", "name", "qualified_name", "language", "provenance", "source_ref", "metadata"))).alias("nodes"))
    e = edges.groupBy(*SNAP).agg(F.array_sort(F.collect_list(F.struct("source_path", "target_path", "kind"))).alias("edges"))
    edge = F.transform(F.coalesce("edges", F.array().cast("array<struct<source_path:string,target_path:string,kind:string>>")), lambda x: F.struct(x.source_path.alias("source"), x.target_path.alias("target"), x.kind.alias("kind")))
    d = kinds.join(n, SNAP).join(e, SNAP, "left")
    return d.select(*SNAP, F.to_json(F.struct(F.lit(FORMAT).alias("format"), "kind", "version", "nodes", edge.alias("edges"))).alias("document"))


def to_yaml(document: str) -> str:
    import yaml

    return yaml.safe_dump(json.loads(document), sort_keys=False, allow_unicode=True)


def new_id() -> str:
    return str(uuid.uuid4())
