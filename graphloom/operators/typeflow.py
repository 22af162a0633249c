"""Inference of transforms and data-flow edges from items, signatures and calls.

items: qualified_name, kind, sub_kind, name, parent, metadata (JSON with param_types, return_type, trait, impl_for);
relations: source, target, kind (qualified names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import is_getter, parent_module, project_local, qualified_to_path, uuid5

_PARAMS = "array<struct<name:string,type:string>>"


def signatures(items: DataFrame) -> DataFrame:
    """qualified_name, module, name, params (array of type names), returns of functions and methods that have either."""
    meta = F.col("metadata")
    p = F.transform(F.coalesce(F.from_json(F.get_json_object(meta, "$.param_types"), _PARAMS), F.array().cast(_PARAMS)), lambda x: x.type)
    s = items.filter(F.col("sub_kind").isin("function", "method")).select("qualified_name", F.coalesce("parent", parent_module(F.col("qualified_name")), "qualified_name").alias("module"), "name", p.alias("params"), F.get_json_object(meta, "$.return_type").alias("returns"))
    return s.filter((F.size("params") > 0) | F.col("returns").isNotNull())


def from_transforms(items: DataFrame) -> DataFrame:
    """source, target of conversions: the owner of an impl of From or TryFrom, and the type it is for."""
    trait, made = F.get_json_object("metadata", "$.trait"), F.get_json_object("metadata", "$.impl_for")
    return items.filter(trait.isin("From", "TryFrom") & made.isNotNull() & F.col("parent").isNotNull()).select(F.col("parent").alias("source"), made.alias("target")).distinct()


def signature_transforms(sigs: DataFrame) -> DataFrame:
    """source, target: a parameter's type to the return type where both are the project's own and differ, but for getters."""
    s = sigs.filter(F.col("returns").isNotNull() & ~is_getter(F.col("name"), F.size("params"))).select(F.explode("params").alias("source"), F.col("returns").alias("target"))
    return s.filter(project_local(F.col("source")) & project_local(F.col("target")) & (F.col("source") != F.col("target"))).distinct()


def called_signatures(relations: DataFrame, sigs: DataFrame) -> DataFrame:
    """source, target, m1, p1, r1, m2, p2, r2: calls with module, parameters and returned type at both ends."""
    calls = relations.filter(F.col("kind") == "calls").select("source", "target").distinct()
    a = sigs.select(F.col("qualified_name").alias("source"), F.col("module").alias("m1"), F.col("params").alias("p1"), F.col("returns").alias("r1"))
    b = sigs.select(F.col("qualified_name").alias("target"), F.col("module").alias("m2"), F.col("params").alias("p2"), F.col("returns").alias("r2"))
    return calls.join(a, "source").join(b, "target")


def cross_module_flows(relations: DataFrame, sigs: DataFrame) -> DataFrame:
    """source, target (modules), type: values handed over calls between modules, in the direction they go."""
    c = called_signatures(relations, sigs).filter(F.col("m1") != F.col("m2"))
    push = c.filter(F.array_contains("p2", F.col("r1"))).select(F.col("m1").alias("source"), F.col("m2").alias("target"), F.col("r1").alias("type"))
    pull = c.filter(F.array_contains("p1", F.col("r2"))).select(F.col("m2").alias("source"), F.col("m1").alias("target"), F.col("r2").alias("type"))
    return push.union(pull).distinct()


def map_to_graph(items: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and warnings: names become paths and stable ids, containment comes from parents, unresolved relations are warned of."""
    n = items.withColumn("canonical_path", qualified_to_path(F.col("qualified_name")))
    known = n.select("qualified_name", "canonical_path").distinct()
    held = items.filter("parent is not null").select(F.col("parent").alias("source"), F.col("qualified_name").alias("target"), F.lit("contains").alias("kind"))
    rel = relations.select("source", "target", "kind")
    a = known.select(F.col("qualified_name").alias("source"), F.col("canonical_path").alias("source_path"))
    b = known.select(F.col("qualified_name").alias("target"), F.col("canonical_path").alias("target_path"))
    both = held.unionByName(rel).join(a, "source", "left").join(b, "target", "left")
    lost = F.when(F.col("source_path").isNull(), F.col("source")).when(F.col("target_path").isNull(), F.col("target"))
    warnings = both.filter(lost.isNotNull() & (F.col("kind") != "contains")).select("source", "target", "kind", lost.alias("unresolved"))
    good = both.filter(lost.isNull())
    camel = F.replace(F.initcap(F.replace("kind", F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    edges = good.withColumn("id", uuid5(F.concat("source_path", F.lit("->"), "target_path", F.lit(":"), camel)))
    fan = good.filter(F.col("kind") != "contains").select(F.explode(F.array(F.struct(F.col("target_path").alias("p"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_path").alias("p"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    fan = fan.groupBy(F.col("p").alias("canonical_path")).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    nodes = n.groupBy("canonical_path").agg(*[F.max(c).alias(c) for c in ("qualified_name", "kind", "sub_kind", "name")]).join(fan, "canonical_path", "left").fillna(0, ["fan_in", "fan_out"])
    nodes = nodes.select(uuid5(F.col("canonical_path")).alias("id"), "canonical_path", "qualified_name", "kind", "sub_kind", "name", "fan_in", "fan_out")
    edges = edges.groupBy("id").agg(*[F.max(c).alias(c) for c in ("source_path", "target_path", "kind")])
    return nodes, edges, warnings


def reparent(items: DataFrame, dependencies: DataFrame) -> DataFrame:
    """qualified_name, parent, new_parent of items whose parent is unknown: the type of the parent's short name that is the only one
    in the item's crate; else the only one anywhere; of several the only one in a crate that this one depends on; else the
    only one with the longest equal end of its path, of two names at least.

    items: crate, qualified_name, sub_kind, parent; dependencies: crate, dependency (qualified names of crates).
    """
    known = items.select(F.col("qualified_name").alias("parent")).distinct()
    lost = items.filter(F.col("parent").isNotNull() & (F.col("parent") != F.col("crate"))).select("crate", "qualified_name", "parent").distinct().join(known, "parent", "left_anti")
    types = items.filter(F.col("sub_kind").isin("struct", "enum", "trait", "type_alias", "type-alias")).select(F.substring_index("qualified_name", "::", -1).alias("short"), F.col("qualified_name").alias("type"), F.col("crate").alias("holder")).distinct()
    parents = lost.select("crate", "parent").distinct().withColumn("short", F.substring_index("parent", "::", -1))
    c = parents.join(types, "short").join(dependencies.select("crate", F.col("dependency").alias("holder"), F.lit(True).alias("dep")).distinct(), ["crate", "holder"], "left")
    own, theirs = F.reverse(F.split("parent", "::")), F.reverse(F.split("type", "::"))
    same = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size(own) - 1, F.size(theirs))), lambda k: (F.slice(own, F.lit(1), k) == F.slice(theirs, F.lit(1), k))), lambda x: x))
    c = c.select("crate", "parent", "type", ((F.col("holder") == F.col("crate")) & F.startswith("parent", F.concat("crate", F.lit("::")))).alias("here"), F.coalesce("dep", F.lit(False)).alias("dep"), same.alias("same"))
    ends = c.groupBy("crate", "parent", "same").agg(F.count(F.lit(1)).alias("n"), F.min("type").alias("type")).groupBy("crate", "parent").agg(F.max(F.struct("same", "n", "type")).alias("end"))
    per = c.groupBy("crate", "parent").agg(
        F.count(F.lit(1)).alias("n"), F.min("type").alias("only"), F.count_if("here").alias("n_here"), F.min(F.when(F.col("here"), F.col("type"))).alias("at_home"), F.count_if("dep").alias("n_dep"), F.min(F.when(F.col("dep"), F.col("type"))).alias("of_dep")
    )
    found = F.when(F.col("n_here") == 1, F.col("at_home")).when(F.col("n") == 1, F.col("only")).when(F.col("n_dep") == 1, F.col("of_dep")).when((F.col("end.same") >= 2) & (F.col("end.n") == 1), F.col("end.type"))
    new = per.join(ends, ["crate", "parent"]).select("crate", "parent", found.alias("new_parent")).filter("new_parent is not null")
    return lost.join(new, ["crate", "parent"]).select("qualified_name", "parent", "new_parent")
