"""Constraints over the graph: one frame of violations, one of results, one summary row per snapshot.

Evaluators are kept in a registry by kind; each gets the nodes, the edges and one constraint and returns frames keyed by
snapshot. A constraint of an unknown kind is not evaluable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import SEVERITIES, glob_match
from graphloom.graph import SNAP, of_kind
from graphloom.operators.lookups import node_by_path
from graphloom.operators.relations import undocumented, unimplemented
from graphloom.runtime import union_all


@dataclass(frozen=True)
class Constraint:
    name: str
    kind: str
    scope: str
    target: str | None = None
    params: dict = field(default_factory=dict)
    message: str = ""
    severity: str = "error"


def _paths(nodes: DataFrame, end: str) -> DataFrame:
    return nodes.select(*SNAP, F.col("id").alias(end), F.col("canonical_path").alias(f"{end}_path"))


def _violations(e: DataFrame, c: Constraint) -> DataFrame:
    return e.select(*SNAP, F.lit(c.name).alias("constraint"), F.col("source_path").alias("source_path"), F.col("target_path").alias("target_path"), F.col("id").alias("edge_id"), F.col("kind").alias("edge_kind"))


def must_not_depend(nodes: DataFrame, edges: DataFrame, c: Constraint) -> DataFrame:
    """Depends edges from the scope to the target; no target never matches."""
    a = _paths(nodes, "source").filter(glob_match(F.col("source_path"), c.scope))
    b = _paths(nodes, "target").filter(glob_match(F.col("target_path"), c.target) if c.target else F.lit(False))
    return _violations(of_kind(edges, "depends").join(a, [*SNAP, "source"]).join(b, [*SNAP, "target"]), c)


def boundary(nodes: DataFrame, edges: DataFrame, c: Constraint) -> DataFrame:
    """Depends edges from a node outside the scope to one inside."""
    a = _paths(nodes, "source").filter(~glob_match(F.col("source_path"), c.scope))
    b = _paths(nodes, "target").filter(glob_match(F.col("target_path"), c.scope))
    return _violations(of_kind(edges, "depends").join(a, [*SNAP, "source"]).join(b, [*SNAP, "target"]), c)


def must_only_depend(nodes: DataFrame, edges: DataFrame, c: Constraint) -> DataFrame:
    """Depends edges out of the scope whose target matches none of params.targets (or target)."""
    allowed = F.lit(False)
    for p in c.params.get("targets") or ([c.target] if c.target else []):
        allowed = allowed | glob_match(F.col("target_path"), p)
    a = _paths(nodes, "source").filter(glob_match(F.col("source_path"), c.scope))
    b = _paths(nodes, "target").filter(~allowed)
    return _violations(of_kind(edges, "depends").join(a, [*SNAP, "source"]).join(b, [*SNAP, "target"]), c)


def layer_order(nodes: DataFrame, edges: DataFrame, c: Constraint) -> DataFrame:
    """Depends edges from a later layer to an earlier one, and over a layer unless params.allow_skip. Layers by node name."""
    layers = F.create_map(*[x for i, n in enumerate(c.params.get("layers", [])) for x in (F.lit(n), F.lit(i))])
    n = nodes.select(*SNAP, "id", "canonical_path", F.element_at(layers, F.col("name")).alias("layer")).filter("layer is not null")
    a = n.select(*SNAP, F.col("id").alias("source"), F.col("canonical_path").alias("source_path"), F.col("layer").alias("from_layer"))
    b = n.select(*SNAP, F.col("id").alias("target"), F.col("canonical_path").alias("target_path"), F.col("layer").alias("to_layer"))
    e = of_kind(edges, "depends").join(a, [*SNAP, "source"]).join(b, [*SNAP, "target"])
    bad = F.col("from_layer") > F.col("to_layer")
    if not c.params.get("allow_skip", True):
        bad = bad | (F.col("to_layer") - F.col("from_layer") > 1)
    return _violations(e.filter(bad), c)


EDGE_CHECKS: dict[str, Callable[[DataFrame, DataFrame, Constraint], DataFrame]] = {"must_not_depend": must_not_depend, "boundary": boundary}
EXTENSIONS = {"must_only_depend": must_only_depend, "layer_order": layer_order}


def _verdict(snaps: DataFrame, c: Constraint, status, message=None) -> DataFrame:
    message = F.lit(c.message) if message is None else message
    return snaps.select(*SNAP, F.lit(c.name).alias("constraint"), F.lit(c.severity).alias("severity"), status.alias("status"), message.alias("message"))


def _of_scope(snaps: DataFrame, nodes: DataFrame, c: Constraint) -> DataFrame:
    """The snapshots with the id of the node at the scope, null if there is none."""
    return snaps.join(node_by_path(nodes, c.scope).select(*SNAP, F.col("id").alias("scope_id")), SNAP, "left")


def must_contain(nodes: DataFrame, edges: DataFrame, snaps: DataFrame, c: Constraint) -> DataFrame:
    """Passes if the node at the scope has a child of the name (and kind, if one is given)."""
    child = nodes.filter(F.col("name") == c.params.get("child_pattern", ""))
    if c.params.get("child_kind") in ("system", "service", "component", "unit"):
        child = child.filter(F.col("kind") == c.params["child_kind"])
    at = _of_scope(snaps, nodes, c)
    held = of_kind(edges, "contains").join(child.select(*SNAP, F.col("id").alias("target")), [*SNAP, "target"], "left_semi").select(*SNAP, F.col("source").alias("scope_id"), F.lit(True).alias("held")).distinct()
    at = at.join(held, [*SNAP, "scope_id"], "left")
    lost = F.col("scope_id").isNull()
    return _verdict(at, c, F.when(lost, "not_evaluable").when(F.col("held"), "pass").otherwise("fail"), F.when(lost, F.lit(f"Scope node '{c.scope}' not found")).otherwise(F.lit(c.message)))


def _fan(nodes: DataFrame, edges: DataFrame, snaps: DataFrame, c: Constraint, incoming: bool) -> DataFrame:
    kind = c.params.get("edge_kind", "depends")
    known = ("contains", "depends", "calls", "implements", "extends", "data_flow", "exports", "transforms")
    e = of_kind(edges, kind) if kind in known else edges
    near, far = ("target", "source") if incoming else ("source", "target")
    if c.params.get("level"):
        e = e.join(nodes.filter(F.col("kind") == c.params["level"]).select(*SNAP, F.col("id").alias(far)), [*SNAP, far], "left_semi")
    n = e.groupBy(*SNAP, F.col(near).alias("scope_id")).agg(F.count(F.lit(1)).alias("fan"))
    at = _of_scope(snaps, nodes, c).join(n, [*SNAP, "scope_id"], "left").withColumn("fan", F.coalesce("fan", F.lit(0)))
    lost, limit = F.col("scope_id").isNull(), c.params.get("limit")
    over = F.col("fan") > limit if limit is not None else F.lit(False)
    word = "fan-in" if incoming else "fan-out"
    message = F.when(lost, F.lit(f"Scope node '{c.scope}' not found")).when(over, F.concat(F.lit(f"{c.message} ({word}: "), F.col("fan").cast("string"), F.lit(f", limit: {limit})"))).otherwise(F.lit(c.message))
    return _verdict(at, c, F.when(lost, "not_evaluable").when(over, "fail").otherwise("pass"), message)


def max_fan_in(nodes, edges, snaps, c):
    return _fan(nodes, edges, snaps, c, True)


def max_fan_out(nodes, edges, snaps, c):
    return _fan(nodes, edges, snaps, c, False)


NODE_CHECKS = {"must_contain": must_contain, "max_fan_in": max_fan_in}
NODE_EXTENSIONS = {"max_fan_out": max_fan_out}


def violations(nodes: DataFrame, edges: DataFrame, constraints: list[Constraint], extended: bool = False) -> DataFrame | None:
    checks = EDGE_CHECKS | (EXTENSIONS if extended else {})
    found = [checks[c.kind](nodes, edges, c) for c in constraints if c.kind in checks]
    return union_all(found) if found else None


def evaluate(nodes: DataFrame, edges: DataFrame, snaps: DataFrame, constraints: list[Constraint], structural: tuple[DataFrame, DataFrame] | None = None, extended: bool = False) -> DataFrame:
    """SNAP, constraint, severity, status, message, n_violations.

    structural: the nodes on containment cycles and the unresolved ends (SNAP in both); they give the two results that
    come first in every report.
    """
    edge_checks, node_checks = EDGE_CHECKS | (EXTENSIONS if extended else {}), NODE_CHECKS | (NODE_EXTENSIONS if extended else {})
    out = []
    counted: list[tuple[Constraint, DataFrame]] = []
    if structural is not None:
        for name, message, rows in (("containment-acyclic", "containment has no cycles", structural[0]), ("referential-integrity", "edge ends exist", structural[1])):
            counted.append((Constraint(name, "structural", "", message=message), rows))
    counted += [(c, edge_checks[c.kind](nodes, edges, c)) for c in constraints if c.kind in edge_checks]
    for c, rows in counted:
        n = rows.groupBy(*SNAP).agg(F.count(F.lit(1)).alias("n_violations"))
        at = snaps.select(*SNAP).join(n, SNAP, "left").fillna(0, ["n_violations"])
        out.append(at.select(*SNAP, F.lit(c.name).alias("constraint"), F.lit(c.severity).alias("severity"), F.when(F.col("n_violations") > 0, "fail").otherwise("pass").alias("status"), F.lit(c.message).alias("message"), "n_violations"))
    for c in constraints:
        if c.kind in node_checks:
            r = node_checks[c.kind](nodes, edges, snaps.select(*SNAP), c)
            out.append(r.withColumn("n_violations", F.when(F.col("status") == "fail", 1).otherwise(0).cast("long")))
        elif c.kind not in edge_checks:
            out.append(_verdict(snaps, c, F.lit("not_evaluable"), F.lit(f"{c.kind} not evaluable")).withColumn("n_violations", F.lit(0).cast("long")))
    return union_all(out)


def scoped(nodes: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """SNAP, constraint, role, id: the nodes that a constraint's scope or target pattern takes in, one pass for all patterns."""
    roles = [(c.name, role, p) for c in constraints for role, p in (("scope", c.scope), ("target", c.target)) if p]
    hits = F.array_compact(F.array(*[F.when(glob_match(F.col("canonical_path"), p), F.struct(F.lit(n).alias("constraint"), F.lit(role).alias("role"))) for n, role, p in roles]))
    return nodes.filter("canonical_path is not null").select(*SNAP, "id", F.explode(hits).alias("h")).select(*SNAP, "h.constraint", "h.role", "id")


def evaluate_pairs(design: DataFrame, analysis: DataFrame, results: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, constraint, severity, status, message, n_violations of designs against analyses.

    design, analysis: by, canonical_path of the nodes of both. results: SNAP and the results of the design's constraints on every
    analysis (structural ones first). pairs: by, version of the analysis. Unimplemented and undocumented nodes come as two
    rows more, 'listed' with their numbers.
    """
    out = [results.join(pairs, SNAP).select(*by, "constraint", "severity", "status", "message", "n_violations")]
    for name, rows in (("unimplemented", unimplemented(design, analysis, by)), ("undocumented", undocumented(design, analysis, by))):
        n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        listed = pairs.select(*by).join(n, by, "left")
        out.append(listed.select(*by, F.lit(name).alias("constraint"), F.lit("info").alias("severity"), F.lit("listed").alias("status"), F.lit("").alias("message"), F.coalesce("n", F.lit(0)).alias("n_violations")))
    return union_all(out)


def scores(mapping: DataFrame, violations: DataFrame) -> DataFrame:
    """SNAP, component, n_mapped, n_violations, score: 1 - violations / mapped nodes of a design component, 0 if none are mapped.

    mapping: SNAP, component, path (null: a component without nodes); violations: SNAP, source_path.
    """
    v = violations.groupBy(*SNAP, F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("v"))
    m = mapping.join(v, [*SNAP, "path"], "left").groupBy(*SNAP, "component").agg(F.count("path").alias("n_mapped"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_violations"))
    return m.withColumn("score", F.when(F.col("n_mapped") == 0, 0.0).otherwise(F.round(1.0 - F.col("n_violations") / F.col("n_mapped"), 9)))


def summary(results: DataFrame) -> DataFrame:
    """SNAP, passed, failed (errors), warned (warnings), not_evaluable; a failed info is in none."""
    s, v = F.col("status"), F.col("severity")
    return results.groupBy(*SNAP).agg(
        F.count_if(s == "pass").alias("passed"), F.count_if((s == "fail") & (v == "error")).alias("failed"), F.count_if((s == "fail") & (v == "warning")).alias("warned"), F.count_if(s == "not_evaluable").alias("not_evaluable")
    )


def exit_code(results: DataFrame, fail_on: str = "error") -> DataFrame:
    """SNAP, exit_code: 1 if a result of at least the severity failed."""
    if fail_on not in SEVERITIES:
        raise ValueError(f"unknown severity {fail_on}")
    over = F.col("severity").isin(*SEVERITIES[SEVERITIES.index(fail_on) :]) & (F.col("status") == "fail")
    return results.groupBy(*SNAP).agg(F.max(over.cast("int")).alias("exit_code"))
