"""Commands over a store: python -m graphloom COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.graph import SNAP
from graphloom.operators import conformance as cf
from graphloom.operators import relations as rl
from graphloom.operators import trees as tr
from graphloom.operators.aggregates import roots
from graphloom.operators.relations import path_edges
from graphloom.operators.typeflow import map_to_graph
from graphloom.sources import export, interchange, items, manifests
from graphloom.sources.registry import Registry
from graphloom.sources.store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--store", default=".graphloom/store")
    p.add_argument("--project", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="create the project")
    c = sub.add_parser("import", help="load design documents as one snapshot")
    c.add_argument("files", nargs="+")
    c = sub.add_parser("analyze", help="parse a source tree into a snapshot")
    c.add_argument("root")
    c = sub.add_parser("check", help="evaluate the constraints of the latest design")
    c.add_argument("--fail-on", default="error", choices=cf.SEVERITIES)
    c.add_argument("--analysis", action="store_true", help="on the latest analysis instead of the design itself")
    c = sub.add_parser("export", help="print a diagram or document")
    c.add_argument("--format", default="mermaid", choices=["dot", "mermaid", "c4", "json", "yaml"])
    c.add_argument("--version", type=int)
    c = sub.add_parser("diff", help="changes between two versions")
    c.add_argument("from_version", type=int)
    c.add_argument("to_version", type=int)
    c = sub.add_parser("roots", help="classes of roots of a version")
    c.add_argument("--version", type=int)
    c = sub.add_parser("info", help="versions of the project")
    c = sub.add_parser("compact", help="drop all but the latest design and analysis")
    c.add_argument("--keep", type=int, nargs="*")
    c = sub.add_parser("push", help="write a snapshot elsewhere")
    c.add_argument("target")
    c.add_argument("--version", type=int)
    c = sub.add_parser("reset", help="delete the store")
    c.add_argument("--force", action="store_true")
    sub.add_parser("plugins", help="list the installed plugins")
    return p


def _constraints(store: Store, project: str, version: int) -> list[cf.Constraint]:
    import json

    return [cf.Constraint(r["name"], r["kind"], r["scope"], r["target"], json.loads(r["params"] or "{}"), r["message"] or "", r["severity"]) for r in store.read("constraints", project, version).orderBy("name").collect()]


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    store = Store(spark, a.store)
    latest = lambda kind=None: store.latest_version(a.project, kind)
    if a.command == "init":
        store.create_project(a.project, a.project)
    elif a.command == "import":
        docs = [(interchange.parse_json if f.endswith(".json") else interchange.parse_yaml)(Path(f).read_text()) for f in a.files]
        print("version", interchange.load(store, a.project, interchange.merge(docs)))
    elif a.command == "analyze":
        files = manifests.read_tree(spark, a.root)
        found, relations = items.parse_files(files)
        shaped = found.withColumn("metadata", F.to_json(F.struct("tags"))).drop("path", "tags")
        nodes, edges, warnings = map_to_graph(shaped.withColumn("parent", F.when(F.col("parent") != "", F.col("parent"))), relations.drop("path"))
        at = nodes.select(F.col("id").alias("sid"), F.col("canonical_path").alias("source_path")).distinct(), nodes.select(F.col("id").alias("tid"), F.col("canonical_path").alias("target_path")).distinct()
        edges = edges.join(at[0], "source_path").join(at[1], "target_path").select("id", F.col("sid").alias("source"), F.col("tid").alias("target"), "kind", F.lit("analysis").alias("provenance"))
        nodes = nodes.withColumn("provenance", F.lit("analysis")).withColumn("metadata", F.to_json(F.struct("fan_in", "fan_out"))).drop("fan_in", "fan_out")
        got = store.push(a.project, "analysis", nodes, edges)
        print(got, "unresolved relations:", warnings.count())
    elif a.command == "check":
        design = latest("design")
        version = latest("analysis") if a.analysis else design
        if design is None or version is None:
            print("nothing to check", file=sys.stderr)
            return 2
        n, e = store.read("nodes", a.project, version), store.read("edges", a.project, version)
        lost = rl.missing_ends(e, n, spark.createDataFrame([], "id string"))
        res = cf.evaluate(n, e, n.select(*SNAP).distinct(), _constraints(store, a.project, design), (tr.cycle_members(tr.parent_table(n, e)), lost))
        for r in res.orderBy("constraint").collect():
            print(f"{r['status']:14} {r['severity']:8} {r['constraint']}: {r['message']} ({r['n_violations']})")
        if a.analysis:
            d = store.read("nodes", a.project, design)
            for name, rows in (("unimplemented", rl.unimplemented(d, n, ["project_id"])), ("undocumented", rl.undocumented(d, n, ["project_id"]))):
                print(f"{name}: {rows.count()}")
        return cf.exit_code(res, a.fail_on).agg(F.max("exit_code")).first()[0] or 0
    elif a.command == "export":
        v = a.version or latest()
        n, e = store.read("nodes", a.project, v), store.read("edges", a.project, v)
        if a.format in ("json", "yaml"):
            kind = store.read("snapshots", a.project, v).select(*SNAP, "kind")
            doc = interchange.documents(n, path_edges(e, n), kind).first()["document"]
            print(doc if a.format == "json" else interchange.to_yaml(doc))
        else:
            plain = e.filter("kind <> 'contains'")
            lines = Registry().exporters[a.format](n, plain if a.format == "c4" else path_edges(plain, n), tr.parent_table(n, e))
            print(export.text_of(lines, a.project, v), end="")
    elif a.command == "diff":
        f = [F.col(c) for c in ("kind", "sub_kind", "language", "provenance", "source_ref")]
        old, new = (store.read("nodes", a.project, v).select("canonical_path", F.struct(*f).alias(x)) for v, x in ((a.from_version, "old"), (a.to_version, "new")))
        both = old.join(new, "canonical_path", "full_outer").withColumn("change", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")).filter("change is not null")
        for r in both.select("change", "canonical_path").orderBy("canonical_path").toLocalIterator():
            print(r["change"], r["canonical_path"])
    elif a.command == "roots":
        v = a.version or latest()
        for r in roots(store.read("nodes", a.project, v), store.read("edges", a.project, v)).orderBy("category", "node_id").toLocalIterator():
            print(r["category"], r["canonical_path"])
    elif a.command == "info":
        for r in store.read("snapshots", a.project).orderBy("version").collect():
            print(r["version"], r["kind"], r["created_at"], store.read("nodes", a.project, r["version"]).count(), store.read("edges", a.project, r["version"]).count())
    elif a.command == "compact":
        print("dropped", store.compact(a.project, a.keep))
    elif a.command == "push":
        store.push_to(a.project, a.version or latest(), a.target)
    elif a.command == "reset":
        if not a.force:
            print("add --force to delete the store", file=sys.stderr)
            return 2
        store.reset()
    elif a.command == "plugins":
        r = Registry()
        r.discover()
        for name, what in r.info():
            print(name, what)
    return 0


if __name__ == "__main__":
    sys.exit(main())
