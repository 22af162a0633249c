"""Queries over the graph tables: scans, lookups, joins, traversals, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fx
from graphloom.graph import SNAP, Graph, of_kind
from graphloom.operators import aggregates as ag
from graphloom.operators import lookups as lk
from graphloom.operators import relations as rl
from graphloom.operators import snapshot_changes as sc
from graphloom.operators import traversal as tv
from graphloom.operators import trees as tr
from graphloom.plans.sql import BASE, CLOSURE, DEGREES, ENDS, PAIRS, SHOWN, TOP
from graphloom.runtime import write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register f(graph) under its name, with the SQL to compare with."""

    def put(f):
        key = name or f.__name__
        QUERIES[key] = lambda s, d: f(Graph(s, d))
        if sql is not None:
            ORACLES[key] = sql
        return f

    return put


# --- scans ---------------------------------------------------------------------------------------------------------------


@query(BASE + "select project_id, version, id, canonical_path, qualified_name, kind, sub_kind, name, language, provenance, source_ref, metadata from n")
def src_nodes_scan(g):
    return g.nodes


@query(BASE + "select * from e")
def src_edges_scan(g):
    return g.edges


@query(BASE + "select project_id, version, id, source, target from e where kind = 'calls'")
def src_edges_scan_kind(g):
    return of_kind(g.edges, "calls").select(*SNAP, "id", "source", "target")


@query(BASE + "select * from m")
def src_manifest_scan(g):
    return g.manifest


@query(
    r"""select distinct u.project_id, u.name, k.name dependency from (select project_id, name, unnest(workspace_dependencies) d from units where name is not null) u
join (select distinct project_id, name, unnest([lower(replace(name, '_', '-')), lower(module_path)]) k from units where name is not null) k on k.project_id = u.project_id and k.k in (lower(replace(u.d, '_', '-')), lower(u.d)) where u.name <> k.name"""
)
def src_workspace_deps(g):
    return rl.workspace_dependencies(g.raw("units"))


@query(
    r"""with p as (select distinct project_id, path, string_split(path, '/') parts from source_files where path is not null)
select distinct project_id, array_to_string(parts[1:k], '::') as module, k::int as depth from (select *, unnest(range(1, len(parts))) k from p)"""
)
def src_module_items(g):
    parts = F.split("path", "/")
    p = g.raw("source_files").filter("path is not null").select("project_id", parts.alias("parts")).distinct()
    p = p.filter(F.size("parts") > 1).select("project_id", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("depth"))
    return p.select("project_id", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "::").alias("module"), "depth").distinct()


# --- lookups, filters, projections -------------------------------------------------------------------------------------------


def _first_path(g: Graph) -> str:
    return g.nodes.agg(F.min("canonical_path")).first()[0] or ""


def _busiest(g: Graph, end: str = "target") -> str:
    """The id that most edges lead to, or come from."""
    hit = g.edges.filter(f"{end} is not null").groupBy(end).count().orderBy(F.desc("count"), end).first()
    return hit[0] if hit else ""


def _root_service_path(g: Graph) -> str:
    return g.nodes.filter("kind = 'service'").agg(F.min("canonical_path")).first()[0] or ""


FIRST_PATH = "(select min(canonical_path) from n)"
BUSIEST_SOURCE = "(select source from e where source is not null group by 1 order by count(*) desc, source limit 1)"
BUSIEST = "(select target from e where target is not null group by 1 order by count(*) desc, target limit 1)"
ROOT_PATH = "(select min(canonical_path) from n where kind = 'service')"


@query(BASE + "select project_id, version, id, canonical_path, kind from n where id = (select max(id) from n)")
def flt_node_by_id(g):
    top = g.nodes.agg(F.max("id")).first()[0] or ""
    return lk.node_by_id(g.nodes, top).select(*SNAP, "id", "canonical_path", "kind")


@query(BASE + f"select project_id, version, min(id) id, arg_min(kind, id) kind, arg_min(name, id) as name from n where canonical_path = {FIRST_PATH} group by all")
def flt_node_by_path(g):
    return lk.node_by_path(g.nodes, _first_path(g)).select(*SNAP, "id", "kind", "name")


@query("select id, name, created_at, description, metadata from projects where id = (select min(id) from projects)")
def flt_project_get(g):
    p = g.raw("projects")
    return p.filter(F.col("id") == p.agg(F.min("id")).first()[0]).select("id", "name", "created_at", "description", "metadata")


@query("select id, name from projects order by id")
def flt_project_list(g):
    return g.raw("projects").select("id", "name").orderBy("id")


@query("select count(*) > 0 as found from projects where id = 'ledgerflow'")
def flt_project_exists(g):
    return g.raw("projects").filter("id = 'ledgerflow'").agg((F.count(F.lit(1)) > 0).alias("found"))


for _way, _cond in (("out", f"source = {BUSIEST_SOURCE}"), ("in", f"target = {BUSIEST}"), ("both", f"(source = {BUSIEST} or target = {BUSIEST})")):

    @query(BASE + "select project_id, version, id, source, target, kind from e where " + _cond, name=f"flt_edges_{_way}")
    def _edges_way(g, way=_way):
        return lk.edges_of(g.edges, _busiest(g, "source" if way == "out" else "target"), way).select(*SNAP, "id", "source", "target", "kind")


@query(BASE + f"select project_id, version, id, source, target, 'in' as direction from e where target = {BUSIEST} and kind = 'depends' union all select project_id, version, id, source, target, 'out' from e where source = {BUSIEST_SOURCE} and kind = 'depends'")
def flt_deps_edges_api(g):
    """Direct dependents of the busiest target, and direct dependencies of the busiest source."""
    into = lk.edges_of(g.edges, _busiest(g), "in", "depends").withColumn("direction", F.lit("in"))
    out = lk.edges_of(g.edges, _busiest(g, "source"), "out", "depends").withColumn("direction", F.lit("out"))
    return into.unionByName(out).select(*SNAP, "id", "source", "target", "direction")


@query(BASE + "select project_id, version, id from n where kind = 'component' and sub_kind = 'struct' and language = 'go'")
def flt_node_filter(g):
    return lk.filter_nodes(g.nodes, "component", "struct", "go").select(*SNAP, "id")


@query(BASE + "select project_id, version, id, canonical_path from n where regexp_matches(canonical_path, '^/[^/]*/(?:[^/]+/)*[^/]*-engine$')")
def flt_glob_search(g):
    return lk.search(g.nodes, "/*/**/*-engine").select(*SNAP, "id", "canonical_path")


@query(BASE + "select distinct sub_kind as value from n where sub_kind is not null and sub_kind <> '' order by 1")
def flt_distinct_subkinds(g):
    return lk.distinct_values(g.nodes, "sub_kind")


@query(BASE + "select distinct language as value from n where language is not null and language <> '' order by 1")
def flt_distinct_languages(g):
    return lk.distinct_values(g.nodes, "language")


@query(BASE + "select project_id, version, id from n where coalesce(list_contains(json_extract(metadata, '$.tags')::varchar[], 'test'), false)")
def flt_test_nodes(g):
    return g.nodes.filter(lk.is_test(F.col("metadata"))).select(*SNAP, "id")


@query(BASE + "select project_id, version, id, source, target, kind from e where kind <> 'contains'")
def flt_noncontains_edges(g):
    return g.edges.filter("kind <> 'contains'").select(*SNAP, "id", "source", "target", "kind")


_VIEW = CLOSURE + """, hit as (select project_id, version, id from n where kind in ('unit', 'component') and coalesce(language, 'go') = 'go'),
ids as (select * from hit union select c.project_id, c.version, c.ancestor from cl c join hit h on h.project_id = c.project_id and h.version = c.version and h.id = c.node)
"""


def _view(g):
    keep = F.col("kind").isin("unit", "component") & (F.coalesce("language", F.lit("go")) == "go")
    return lk.view_filter(g.nodes, g.edges, _links(g), keep, ["depends", "calls"])


@query(_VIEW + "select * from ids")
def flt_view_filter(g):
    return _view(g)[0].select(*SNAP, "id")


@query(_VIEW + "select e.project_id, e.version, e.id from e semi join ids a on a.project_id = e.project_id and a.version = e.version and a.id = e.source semi join ids b on b.project_id = e.project_id and b.version = e.version and b.id = e.target where e.kind in ('contains', 'depends', 'calls')")
def flt_view_filter_edges(g):
    return _view(g)[1].select(*SNAP, "id")


_SUB = CLOSURE + f", root as (select project_id, version, min(id) id from n where canonical_path = {ROOT_PATH} group by all), ids as (select * from root union select c.project_id, c.version, c.node from cl c join root r on r.project_id = c.project_id and r.version = c.version and r.id = c.ancestor)\n"


@query(_SUB + "select * from ids")
def flt_subtree_scope(g):
    return lk.subtree(g.nodes, g.edges, _links(g), _root_service_path(g))[0].select(*SNAP, "id")


@query(_SUB + "select e.project_id, e.version, e.id from e semi join ids a on a.project_id = e.project_id and a.version = e.version and a.id = e.source semi join ids b on b.project_id = e.project_id and b.version = e.version and b.id = e.target")
def flt_subtree_scope_edges(g):
    return lk.subtree(g.nodes, g.edges, _links(g), _root_service_path(g))[1].select(*SNAP, "id")


_PHANTOM = BASE + """, lost as (select distinct e.project_id, e.version, e.source, e.target from e anti join n on n.project_id = e.project_id and n.version = e.version and n.id = e.source where e.kind = 'contains' and e.source is not null),
ph as (select l.project_id, l.version, l.source id, regexp_replace(min(n.canonical_path), '/[^/]*$', '') p from lost l left join n on n.project_id = l.project_id and n.version = l.version and n.id = l.target group by all)
select project_id, version, id, 'component' kind, 'phantom' sub_kind, coalesce(nullif(regexp_extract(p, '[^/]*$'), ''), id) as label, coalesce(p, '') canonical_path from ph"""


@query(_PHANTOM)
def join_phantom_parents(g):
    return rl.phantom_parents(g.edges, g.nodes)


@query(_PHANTOM.replace("select project_id, version, id, 'component' kind, 'phantom' sub_kind, coalesce(nullif(regexp_extract(p, '[^/]*$'), ''), id) as label, coalesce(p, '') canonical_path from ph", "select project_id, version, id from ph"))
def flt_phantom_ids(g):
    return rl.phantom_parents(g.edges, g.nodes).filter("sub_kind = 'phantom'").select(*SNAP, "id")


@query(BASE + "select project_id, version, canonical_path, max(id) id, arg_max(name, id) as label from n where canonical_path is not null group by all")
def prj_id_path_maps(g):
    return g.nodes.filter("canonical_path is not null").groupBy(*SNAP, "canonical_path").agg(F.max("id").alias("id"), F.max_by("name", "id").alias("label"))


@query(BASE + ", p as (select project_id, version, target id, max(source) parent from e where kind = 'contains' group by all) select n.project_id, n.version, n.id, n.name as label, n.kind, n.sub_kind, n.canonical_path, n.language, p.parent from n left join p using (project_id, version, id)")
def prj_view_nodes(g):
    return lk.view_nodes(g.nodes, g.edges)


# --- joins -----------------------------------------------------------------------------------------------------------------


def _linked_sql(kind: str, a: str, b: str) -> str:
    return BASE + f"select distinct e.project_id, e.version, e.{a} id, n.id other_id, n.canonical_path other_path from e join n on n.project_id = e.project_id and n.version = e.version and n.id = e.{b} where e.kind = '{kind}' and e.{a} is not null"


for _key, _kind, _rev in (("join_children", "contains", False), ("join_parent", "contains", True), ("join_direct_deps", "depends", False), ("join_direct_dependents", "depends", True)):

    @query(_linked_sql(_kind, *(("target", "source") if _rev else ("source", "target"))), name=_key)
    def _linked(g, kind=_kind, rev=_rev):
        return rl.linked(g.edges, g.nodes, kind, rev)


@query(BASE + "select s.project_id, p.name project, s.version, s.kind from s join projects p on p.id = s.project_id")
def join_snapshots_project(g):
    return rl.snapshots_of(g.raw("projects"), g.snapshots)


@query(
    BASE
    + ", nn as (select project_id, version, count(*) c from n group by all), ne as (select project_id, version, count(*) c from e group by all), ps as (select project_id, count(*) c from s group by all) select s.project_id, s.version, s.kind, coalesce(nn.c, 0) n_nodes, coalesce(ne.c, 0) n_edges, ps.c n_snapshots from s left join nn using (project_id, version) left join ne using (project_id, version) join ps using (project_id)"
)
def join_store_info(g):
    return ag.store_info(g.snapshots, g.nodes, g.edges)


@query(BASE + "select s.project_id, count(*) n_snapshots, max(s.version) latest, count(distinct s.kind) n_kinds, (select count(*) from n where n.project_id = s.project_id) n_nodes, (select count(*) from e where e.project_id = s.project_id) n_edges from s group by all")
def agg_store_info(g):
    """Per project: what the store holds."""
    counted = [d.groupBy("project_id").agg(F.count(F.lit(1)).alias(c)) for d, c in ((g.nodes, "n_nodes"), (g.edges, "n_edges"))]
    per = g.snapshots.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_snapshots"), F.max("version").alias("latest"), F.countDistinct("kind").alias("n_kinds"))
    return per.join(counted[0], "project_id", "left").join(counted[1], "project_id", "left").fillna(0, ["n_nodes", "n_edges"])


@query(BASE + "select e.project_id, e.version, e.target, count(*) n from e semi join n on n.project_id = e.project_id and n.version = e.version and n.id = e.source and n.kind = 'component' where e.kind = 'depends' and e.target is not null group by all")
def join_semi_level(g):
    return rl.from_level(g.edges, g.nodes, "depends", "component")


_LOST = BASE + ", refs as (select project_id, version, id edge_id, 'source' endpoint, source as ref from e where source is not null union all select project_id, version, id, 'target', target from e where target is not null)\n"


@query(_LOST + "select r.* from refs r anti join n on n.project_id = r.project_id and n.version = r.version and n.id = r.ref anti join sh on sh.id = r.ref")
def join_anti_integrity(g):
    return rl.missing_ends(g.edges, g.nodes, g.shared_nodes)


_DESIGN = PAIRS + """, d as (select distinct p.project_id, p.from_version, p.to_version, n.canonical_path from pairs p join n on n.project_id = p.project_id and n.version = p.from_version where n.canonical_path is not null),
a as (select distinct p.project_id, p.from_version, p.to_version, n.canonical_path from pairs p join n on n.project_id = p.project_id and n.version = p.to_version where n.canonical_path is not null)
"""


def _design(g):
    """Each snapshot as the design of the next one."""
    pairs = sc.snapshot_pairs(g.nodes)
    n = g.nodes.filter("canonical_path is not null")
    d = n.join(pairs.withColumnRenamed("from_version", "version"), SNAP).select("project_id", F.col("version").alias("from_version"), "to_version", "canonical_path")
    a = n.join(pairs.withColumnRenamed("to_version", "version"), SNAP).select("project_id", "from_version", F.col("version").alias("to_version"), "canonical_path")
    return d, a, ["project_id", "from_version", "to_version"]


@query(_DESIGN + "select d.* from d where not exists (select 1 from a where a.project_id = d.project_id and a.from_version = d.from_version and (a.canonical_path = d.canonical_path or starts_with(a.canonical_path, d.canonical_path || '/')))")
def join_anti_unimplemented(g):
    d, a, by = _design(g)
    return rl.unimplemented(d, a, by)


_UNDOC = _DESIGN + ", deep as (select project_id, from_version, max(length(canonical_path) - length(replace(canonical_path, '/', ''))) k from d group by all) select a.* from a join deep using (project_id, from_version) anti join d on d.project_id = a.project_id and d.from_version = a.from_version and d.canonical_path = a.canonical_path where length(a.canonical_path) - length(replace(a.canonical_path, '/', '')) <= k"


@query(_UNDOC)
def join_anti_undocumented(g):
    d, a, by = _design(g)
    return rl.undocumented(d, a, by)


@query(_DESIGN + "select project_id, from_version, max(length(canonical_path) - length(replace(canonical_path, '/', ''))) max_depth from d group by all")
def agg_max_depth(g):
    d, _, _ = _design(g)
    return d.groupBy("project_id", "from_version").agg(F.max(fx.path_depth(F.col("canonical_path"))).cast("long").alias("max_depth"))


_KEEP = BASE + ", keep as (select project_id, max(version) version from s group by all)\n"


@query(_KEEP + "select n.project_id, n.version, n.id from n anti join keep using (project_id, version)")
def join_anti_compact(g):
    keep = g.snapshots.groupBy("project_id").agg(F.max("version").alias("version"))
    return g.nodes.join(keep, SNAP, "left_anti").select(*SNAP, "id")


@query(
    PAIRS
    + """, a as (select p.*, n.canonical_path, n.kind, n.sub_kind, n.language, n.provenance, n.source_ref from pairs p join n on n.project_id = p.project_id and n.version = p.from_version where canonical_path is not null),
b as (select p.*, n.canonical_path, n.kind, n.sub_kind, n.language, n.provenance, n.source_ref from pairs p join n on n.project_id = p.project_id and n.version = p.to_version where canonical_path is not null)
select * from (select project_id, from_version, to_version, canonical_path, case when a.kind is null then 'added' when b.kind is null then 'removed' when a.kind is distinct from b.kind or a.sub_kind is distinct from b.sub_kind or a.language is distinct from b.language or a.provenance is distinct from b.provenance or a.source_ref is distinct from b.source_ref then 'changed' end change
from a full join b using (project_id, from_version, to_version, canonical_path)) where change is not null"""
)
def join_full_outer_diff(g):
    pairs = sc.snapshot_pairs(g.nodes)
    f = F.struct(*sc.COMPARED)
    n = g.nodes.filter("canonical_path is not null")
    by = ["project_id", "from_version", "to_version", "canonical_path"]
    a = n.join(pairs.withColumnRenamed("from_version", "version"), SNAP).select("project_id", F.col("version").alias("from_version"), "to_version", "canonical_path", f.alias("a"))
    b = n.join(pairs.withColumnRenamed("to_version", "version"), SNAP).select("project_id", "from_version", F.col("version").alias("to_version"), "canonical_path", f.alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, by, "full_outer").select(*by, change.alias("change")).filter("change is not null")


@query(BASE + f"select e.project_id, e.version, e.id edge_id, a.canonical_path source_path, b.canonical_path target_path, e.kind from e {ENDS}")
def join_id_to_path(g):
    return rl.path_edges(g.edges, g.nodes)


_MANIFEST = BASE + """, mp as (select * from (select project_id, version from_version, lead(version) over (partition by project_id order by version) to_version from (select distinct project_id, version from m)) where to_version is not null),
mc as (select * from (select project_id, from_version, to_version, path, coalesce(b.unit_name, a.unit_name) unit_name, case when a.hash is null then 'added' when b.hash is null then 'removed' when a.hash <> b.hash then 'modified' end change
  from (select mp.*, m.path, m.hash, m.unit_name from mp join m on m.project_id = mp.project_id and m.version = mp.from_version) a full join (select mp.*, m.path, m.hash, m.unit_name from mp join m on m.project_id = mp.project_id and m.version = mp.to_version) b using (project_id, from_version, to_version, path)) where change is not null)
"""


@query(_MANIFEST + "select * from mc")
def join_manifest_diff(g):
    return rl.manifest_changes(g.manifest, sc.snapshot_pairs(g.manifest))


@query(_MANIFEST + "select distinct project_id, from_version, to_version, unit_name from mc")
def inc_changed_units(g):
    return rl.changed_units(rl.manifest_changes(g.manifest, sc.snapshot_pairs(g.manifest)))


_LINES = BASE + r""", items as (select distinct regexp_extract(source_ref, '^(.+):(\d+)$', 1) file, nullif(regexp_extract(source_ref, '^(.+):(\d+)$', 2), '')::bigint line from n where source_ref is not null and regexp_matches(source_ref, '^(.+):(\d+)$')),
meas as (select file, line, sum(loc) loc from (select regexp_extract(source_ref, '^(.+):(\d+)$', 1) file, nullif(regexp_extract(source_ref, '^(.+):(\d+)$', 2), '')::bigint + version % 2 line, coalesce(try_cast(json_extract_string(metadata, '$.loc') as bigint), 0) loc from n where source_ref is not null and regexp_matches(source_ref, '^(.+):(\d+)$')) group by all)
select items.file, items.line, coalesce(a.loc, b.loc, c.loc)::bigint loc from items left join meas a on a.file = items.file and a.line = items.line left join meas b on b.file = items.file and b.line = items.line - 1 left join meas c on c.file = items.file and c.line = items.line + 1"""


@query(_LINES)
def join_metrics_nearest(g):
    ref = F.col("source_ref")
    n = g.nodes.select(fx.source_ref_file(ref).alias("file"), fx.source_ref_line(ref).alias("line"), "version", F.coalesce(F.get_json_object("metadata", "$.loc").try_cast("long"), F.lit(0)).alias("loc")).filter("file is not null")
    measures = n.select("file", (F.col("line") + F.col("version") % 2).alias("line"), "loc").groupBy("file", "line").agg(F.sum("loc").alias("loc"))
    return rl.nearest_lines(n.select("file", "line").distinct(), measures, "loc")


# --- traversal -----------------------------------------------------------------------------------------------------------------


def _links(g: Graph) -> DataFrame:
    return tr.parent_table(g.nodes, g.edges)


@query(CLOSURE + "select * from cl")
def rec_ancestor_closure(g):
    return tv.closure(tv.parent_edges(g.edges, g.nodes))


_DEEPEST = ", deep as (select max(canonical_path) p from n)\n"


@query(CLOSURE + _DEEPEST + "select c.project_id, c.version, n.canonical_path, a.canonical_path ancestor_path, c.dist from cl c join n on n.project_id = c.project_id and n.version = c.version and n.id = c.node join n a on a.project_id = c.project_id and a.version = c.version and a.id = c.ancestor, deep where n.canonical_path = deep.p")
def rec_ancestors(g):
    last = g.nodes.agg(F.max("canonical_path")).first()[0] or ""
    n = g.nodes.select(*SNAP, F.col("id").alias("node"), "canonical_path").filter(F.col("canonical_path") == last)
    a = g.nodes.select(*SNAP, F.col("id").alias("ancestor"), F.col("canonical_path").alias("ancestor_path"))
    up = tr.ancestors(_links(g), n.select(*SNAP, F.col("node").alias("id")))
    return up.join(n, [*SNAP, "node"]).join(a, [*SNAP, "ancestor"]).select(*SNAP, "canonical_path", "ancestor_path", "dist")


@query(CLOSURE + f"select c.project_id, c.version, n.id, c.dist from cl c join n on n.project_id = c.project_id and n.version = c.version and n.id = c.node join n a on a.project_id = c.project_id and a.version = c.version and a.id = c.ancestor where a.canonical_path = {ROOT_PATH} and n.kind = 'unit'")
def rec_descendants(g):
    top = g.nodes.filter(F.col("canonical_path") == _root_service_path(g)).select(*SNAP, "id")
    return tr.below(_links(g), top).filter("dist > 0").drop("above").join(lk.filter_nodes(g.nodes, "unit").select(*SNAP, "id"), [*SNAP, "id"], "left_semi")


_STARTS = BASE + ", st as (select project_id, version, arg_min(source, canonical_path) id from (select e.project_id, e.version, e.source, n.canonical_path from e join n on n.project_id = e.project_id and n.version = e.version and n.id = e.source where e.kind = 'depends' and e.target is not null) group by all)"


def _starts(g, end="source"):
    e = of_kind(g.edges, "depends").filter("source is not null and target is not null").select(*SNAP, F.col(end).alias("id")).distinct()
    return e.join(g.nodes.select(*SNAP, "id", "canonical_path"), [*SNAP, "id"]).groupBy(*SNAP).agg(F.min_by("id", "canonical_path").alias("id"))


@query(_STARTS + ", r as (select st.project_id, st.version, st.id start, e.target node from st join e on e.project_id = st.project_id and e.version = st.version and e.source = st.id and e.kind = 'depends' and e.target is not null union select r.project_id, r.version, r.start, e.target from r join e on e.project_id = r.project_id and e.version = r.version and e.source = r.node and e.kind = 'depends' and e.target is not null) select * from r")
def rec_dependencies(g):
    return tv.reachable(g.edges, _starts(g)).drop("dist")


@query(
    BASE
    + ", st as (select project_id, version, arg_min(target, canonical_path) id from (select e.project_id, e.version, e.target, n.canonical_path from e join n on n.project_id = e.project_id and n.version = e.version and n.id = e.target where e.kind = 'depends' and e.source is not null) group by all), r as (select st.project_id, st.version, st.id start, e.source node from st join e on e.project_id = st.project_id and e.version = st.version and e.target = st.id and e.kind = 'depends' and e.source is not null union select r.project_id, r.version, r.start, e.source from r join e on e.project_id = r.project_id and e.version = r.version and e.target = r.node and e.kind = 'depends' and e.source is not null) select * from r"
)
def rec_dependents(g):
    return tv.reachable(g.edges, _starts(g, "target"), reverse=True).drop("dist")


@query(CLOSURE + "select * from cyc")
def rec_cycles(g):
    return tr.cycle_members(_links(g))


_CORE = BASE + ", d as (select distinct project_id, version, source, target from e where kind = 'depends' and source is not null and target is not null), r as (select project_id, version, source a, target b from d union select r.project_id, r.version, r.a, d.target from r join d on d.project_id = r.project_id and d.version = r.version and d.source = r.b)"


@query(_CORE + "select distinct project_id, version, a id from r where a = b")
def rec_cycles_kind(g):
    return tv.nodes_on_cycles(g.edges, "depends")


@query(CLOSURE + "select project_id, version, node, string_agg(ancestor, '/' order by dist desc) as chain from tp group by all")
def rec_ancestor_chain(g):
    return tr.chains(_links(g)).filter("size(line) > 1").select(*SNAP, "node", F.array_join(F.slice("line", F.lit(1), F.size("line") - 1), "/").alias("chain"))


@query(CLOSURE + "select n.project_id, n.version, n.id, coalesce(max(tp.dist), 0)::bigint as depth from n left join tp on tp.project_id = n.project_id and tp.version = n.version and tp.node = n.id where not exists (select 1 from cl c join cyc on cyc.project_id = c.project_id and cyc.version = c.version and cyc.id = c.ancestor where c.project_id = n.project_id and c.version = n.version and c.node = n.id) group by all")
def rec_depth(g):
    return tr.depths(_links(g)).withColumnRenamed("node", "id")


_EXPAND = TOP + ", par as (select distinct project_id, version, parent id from pe), lvl as (select n.project_id, n.version, n.id, coalesce(dep.depth, 0)::bigint d from n left join dep on dep.project_id = n.project_id and dep.version = n.version and dep.node = n.id where not exists (select 1 from cl where cl.project_id = n.project_id and cl.version = n.version and cl.node = n.id and dep.node is null))"


@query(_EXPAND + " select l.project_id, l.version, l.id from lvl l semi join par p on p.project_id = l.project_id and p.version = l.version and p.id = l.id where l.d < 2")
def rec_default_expansion(g):
    links = _links(g)
    par = links.filter("parent is not null").select(*SNAP, F.col("parent").alias("id")).distinct()
    return tr.depths(links).filter("depth < 2").withColumnRenamed("node", "id").join(par, [*SNAP, "id"], "left_semi").select(*SNAP, "id")


@query(_SUB + ", par as (select distinct project_id, version, parent id from pe) select r.project_id, r.version, r.id from (select project_id, version, id from root union select c.project_id, c.version, c.node from cl c join root r on r.project_id = c.project_id and r.version = c.version and r.id = c.ancestor where c.dist < 2) r semi join par p on p.project_id = r.project_id and p.version = r.version and p.id = r.id")
def rec_expansion_from(g):
    held = _links(g).filter("parent is not null")
    root = lk.node_by_path(g.nodes, _root_service_path(g)).select(*SNAP, "id")
    near = held.join(root.withColumnRenamed("id", "parent"), [*SNAP, "parent"], "left_semi").select(*SNAP, F.col("node").alias("id"))
    par = held.select(*SNAP, F.col("parent").alias("id")).distinct()
    return root.union(near).distinct().join(par, [*SNAP, "id"], "left_semi")


@query(TOP + "select * from top")
def rec_top_module(g):
    return tr.top_modules(_links(g))


_LCA = CLOSURE + """, en as (select project_id, version, min(source) a, max(target) b from (select e.project_id, e.version, e.source, e.target from e join n x on x.project_id = e.project_id and x.version = e.version and x.id = e.source join n y on y.project_id = e.project_id and y.version = e.version and y.id = e.target where e.kind = 'calls') group by all having min(source) <> max(target)),
t0 as (select * from tp union all select project_id, version, id, id, 0 from n),
l as (select en.*, arg_min({'x': ta.ancestor, 'u': ta.dist, 'd': tb.dist}, ta.dist + tb.dist) z from en join t0 ta on ta.project_id = en.project_id and ta.version = en.version and ta.node = en.a join t0 tb on tb.project_id = en.project_id and tb.version = en.version and tb.node = en.b and tb.ancestor = ta.ancestor group by all)
select l.project_id, l.version, l.a, l.b, (select string_agg(t.ancestor, '/' order by t.dist) from t0 t where t.project_id = l.project_id and t.version = l.version and t.node = l.a and t.dist <= l.z.u) || coalesce('/' || (select string_agg(t.ancestor, '/' order by t.dist desc) from t0 t where t.project_id = l.project_id and t.version = l.version and t.node = l.b and t.dist < l.z.d), '') as path from l"""


@query(_LCA)
def rec_lca_path(g):
    e = of_kind(lk.within(g.edges, g.nodes), "calls")
    ends = e.groupBy(*SNAP).agg(F.min("source").alias("a"), F.max("target").alias("b")).filter("a <> b")
    return tr.tree_paths(_links(g), ends)


@query(BASE + f", h as (select * from e where source = {BUSIEST} or target = {BUSIEST}) select project_id, version, source id from h where source is not null union select project_id, version, target from h where target is not null")
def rec_neighborhood(g):
    return ag.neighbourhood(g.edges, _busiest(g))


@query(_SUB + "select e.project_id, e.version, e.id from e where exists (select 1 from ids where ids.project_id = e.project_id and ids.version = e.version and ids.id in (e.source, e.target))")
def rec_subtree_incident(g):
    ids = flt_subtree_scope(g)
    a = g.edges.join(ids.withColumnRenamed("id", "source"), [*SNAP, "source"], "left_semi").select(*SNAP, "id")
    b = g.edges.join(ids.withColumnRenamed("id", "target"), [*SNAP, "target"], "left_semi").select(*SNAP, "id")
    return a.union(b).distinct()


@query(CLOSURE + "select n.project_id, n.version, n.id, n.name as label from n anti join pe on pe.project_id = n.project_id and pe.version = n.version and pe.node = n.id")
def rec_hierarchy_roots(g):
    p = tv.parent_edges(g.edges, g.nodes).select(*SNAP, F.col("node").alias("id")).distinct()
    return g.nodes.join(p, [*SNAP, "id"], "left_anti").select(*SNAP, "id", F.col("name").alias("label")).orderBy(*SNAP, F.lower("name"), "name", "id")


_SERVICE = CLOSURE + ", h as (select project_id, version, node, arg_min(holder, dist) holder from (select tp.project_id, tp.version, tp.node, tp.ancestor holder, tp.dist from tp join n on n.project_id = tp.project_id and n.version = tp.version and n.id = tp.ancestor and n.kind = '{k}' union all select project_id, version, id, id, 0 from n where kind = '{k}') group by all)\n"


@query(_SERVICE.format(k="service") + "select * from h")
def rec_service_of(g):
    return ag.ancestor_of_kind(g.nodes, _links(g), "service")


@query(BASE + f", r as (select project_id, version, min(id) id from n where canonical_path = {ROOT_PATH} group by all), x as (select project_id, version, id, 0 d from r union select x.project_id, x.version, e.target, x.d + 1 from x join e on e.project_id = x.project_id and e.version = x.version and e.source = x.id and e.kind = 'contains' and e.target is not null where x.d < 2) select project_id, version, id, min(d)::bigint as depth from x group by all")
def rec_subgraph(g):
    root = lk.node_by_path(g.nodes, _root_service_path(g)).select(*SNAP, "id")
    r = tv.reachable(g.edges, root, "contains", most=2).select(*SNAP, F.col("node").alias("id"), F.col("dist").alias("depth"))
    return root.withColumn("depth", F.lit(0).cast("long")).unionByName(r).groupBy(*SNAP, "id").agg(F.min("depth").alias("depth"))


@query(
    _STARTS
    + ", p as (select st.project_id, st.version, st.id start, st.id node, [st.id] ids, 0 steps from st union all select p.project_id, p.version, p.start, d.target, list_append(p.ids, d.target), p.steps + 1 from p join (select distinct project_id, version, source, target from e where kind = 'depends' and source is not null and target is not null) d on d.project_id = p.project_id and d.version = p.version and d.source = p.node where not list_contains(p.ids, d.target) and p.steps < 3) select project_id, version, start, node, array_to_string(ids, '/') as path, steps from p where steps > 0 and node in (select max(node) from p q where q.steps > 0 and q.project_id = p.project_id and q.version = p.version)"
)
def rec_paths(g):
    """Simple paths from a start to an end, here the largest id that is reached."""
    starts = _starts(g)
    ends = tv.reachable(g.edges, starts, most=3).filter("node <> start").groupBy(*SNAP).agg(F.max("node").alias("id"))
    return tv.simple_paths(g.edges, starts, 3, ends=ends)


# --- aggregations ----------------------------------------------------------------------------------------------------------------


@query(BASE + "select project_id, version, count(*) n from n group by all")
def agg_count_nodes(g):
    return ag.count_rows(g.nodes)


@query(BASE + "select project_id, version, count(*) n from e group by all")
def agg_count_edges(g):
    return ag.count_rows(g.edges)


@query(DEGREES + "select project_id, version, id, calls_in, calls_out, depends_in, depends_out, is_contained, has_in, has_out from deg")
def agg_degree_stats(g):
    return ag.degree_stats(g.nodes, g.edges)


for _i, _c in enumerate(ag.ROOT_CATEGORIES):

    @query(DEGREES + f"select project_id, version, node_id, canonical_path, name from roots where category = '{_c}'", name=["agg_roots_call_tree", "agg_roots_dep_sources", "agg_roots_dep_sinks", "agg_roots_containment", "agg_roots_leaf_sinks"][_i])
    def _root_class(g, c=_c):
        return ag.roots(g.nodes, g.edges).filter(F.col("category") == c).drop("category")


@query(DEGREES + "select project_id, version, category, node_id from roots where category in ('call_tree_roots', 'containment_roots')")
def agg_client_roots(g):
    return ag.roots(g.nodes, g.edges).filter(F.col("category").isin("call_tree_roots", "containment_roots")).select(*SNAP, "category", "node_id")


@query(DEGREES + "select project_id, version, node_id, arg_max(category, list_position(['call_tree_roots', 'dependency_sources', 'dependency_sinks', 'containment_roots', 'leaf_sinks'], category)) category from roots group by all")
def agg_root_category_last(g):
    return ag.last_category(ag.roots(g.nodes, g.edges))


@query(BASE + ", f as (select project_id, version, target id, 1 i, 0 o from e where kind <> 'contains' union all select project_id, version, source, 0, 1 from e where kind <> 'contains') select n.project_id, n.version, n.id, coalesce(sum(i), 0)::bigint fan_in, coalesce(sum(o), 0)::bigint fan_out from n left join f using (project_id, version, id) group by all")
def agg_fan_in_out(g):
    return ag.fan_counts(g.nodes, g.edges)


@query(BASE + "select project_id, version, target, count(*) n from e where kind = 'depends' and target is not null group by all having count(*) > 2")
def agg_max_fan_in(g):
    return ag.over_limit(g.edges, "depends", "target", 2)


_CHANGES = ORACLES["join_full_outer_diff"]


@query("select project_id, from_version, to_version, count(*) filter (change = 'added') added, count(*) filter (change = 'removed') removed, count(*) filter (change = 'changed') changed from (" + _CHANGES + ") group by all")
def agg_diff_summary(g):
    c = F.col("change")
    return join_full_outer_diff(g).groupBy("project_id", "from_version", "to_version").agg(*[F.count_if(c == x).alias(x) for x in ("added", "removed", "changed")])


_MATRIX = TOP + ", cells as (select e.project_id, e.version, a.top src, b.top tgt, count(*) n from e join top a on a.project_id = e.project_id and a.version = e.version and a.node = e.source join top b on b.project_id = e.project_id and b.version = e.version and b.node = e.target where e.kind <> 'contains' and a.top <> b.top group by all)\n"


@query(_MATRIX + "select * from cells")
def agg_dependency_matrix(g):
    return ag.dependency_matrix(g.edges, _links(g))


@query(_MATRIX + "select project_id, version, max(n) max_n from cells group by all")
def agg_matrix_max(g):
    return ag.dependency_matrix(g.edges, _links(g)).groupBy(*SNAP).agg(F.max("n").alias("max_n"))


@query(_MATRIX + "select project_id, version, src, tgt, case when n >= 3 then n else 0 end n from cells")
def flt_threshold_matrix(g):
    return ag.dependency_matrix(g.edges, _links(g)).withColumn("n", F.when(F.col("n") >= 3, F.col("n")).otherwise(F.lit(0)))


_CELLS = "cells as (select project_id, version, src, tgt, count(*) n from me where src <> tgt group by all)"
_CELL_OUT = " select c.project_id, c.version, c.src, c.tgt, c.n, r.src is not null is_cyclic, max(c.n) over (partition by c.project_id, c.version) max_n, 2 * c.n > max(c.n) over (partition by c.project_id, c.version) is_dark from cells c left join cells r on r.project_id = c.project_id and r.version = c.version and r.src = c.tgt and r.tgt = c.src"


def _shown(g):
    """Roots are expanded, all else is closed."""
    links = _links(g)
    return tr.visible(links, links.filter("parent is null").select(*SNAP, F.col("node").alias("id")))


@query(SHOWN + ", " + _CELLS + _CELL_OUT)
def agg_hierarchical_matrix(g):
    return ag.hierarchical_matrix(g.edges, _shown(g))


@query(_MATRIX + _CELL_OUT)
def agg_matrix_cell(g):
    return ag.cyclic_matrix(ag.dependency_matrix(g.edges, _links(g)))


@query(SHOWN + "select project_id, version, src, tgt, kind, 1::bigint n, false is_meta from me where src = source and tgt = target union all select project_id, version, src, tgt, kind, count(*), true from me where (src <> source or tgt <> target) and src <> tgt group by all")
def agg_meta_edges(g):
    return ag.meta_edges(g.edges, _shown(g))


_FLOW_VIEW = CLOSURE + """, tot as (select project_id, version, count(*) c from n group by all), par as (select distinct project_id, version, parent id from pe),
shut as (select n.project_id, n.version, n.id from n join tot using (project_id, version) semi join par on par.project_id = n.project_id and par.version = n.version and par.id = n.id where c > 1000 or (c > 200 and n.kind in ('component', 'unit'))),
hid as (select distinct tp.project_id, tp.version, tp.node from tp join shut on shut.project_id = tp.project_id and shut.version = tp.version and shut.id = tp.ancestor),
full_ as (select tot.project_id, tot.version from tot left join (select project_id, version, count(*) h from hid group by all) x using (project_id, version) where c - coalesce(h, 0) > 200),
shut2 as (select * from shut union select par.* from par semi join full_ using (project_id, version)),
up as (select tp.project_id, tp.version, tp.node, arg_max(tp.ancestor, tp.dist) shown from tp join shut2 on shut2.project_id = tp.project_id and shut2.version = tp.version and shut2.id = tp.ancestor group by all),
shown as (select n.project_id, n.version, n.id node, coalesce(up.shown, n.id) shown from n left join up on up.project_id = n.project_id and up.version = n.version and up.node = n.id),
me as (select e.*, a.shown src, b.shown tgt from e join shown a on a.project_id = e.project_id and a.version = e.version and a.node = e.source join shown b on b.project_id = e.project_id and b.version = e.version and b.node = e.target where e.kind <> 'contains')
"""


@query(_FLOW_VIEW + "select project_id, version, src, tgt, kind, count(*) n from me where src <> tgt or kind in ('transforms', 'data_flow') group by all")
def agg_flow_edges(g):
    """Snapshots of more than 200 nodes are shown with containers closed, those of more than 1,000 with all of them."""
    return ag.flow_edges(g.edges, ag.flow_view(g.nodes, _links(g)))


@query(SHOWN + ", x as (select project_id, version, src, tgt, count(*) n from me where src <> tgt group by all) select project_id, version, id, sum(i)::bigint incoming, sum(o)::bigint outgoing from (select project_id, version, tgt id, n i, 0 o from x union all select project_id, version, src, 0, n from x) group by all")
def agg_node_edge_counts(g):
    x = ag.flow_edges(g.edges, _shown(g)).filter("src <> tgt")
    zero = F.lit(0).cast("long")
    s = x.select(*SNAP, F.explode(F.array(F.struct(F.col("tgt").alias("id"), F.col("n").alias("i"), zero.alias("o")), F.struct(F.col("src").alias("id"), zero.alias("i"), F.col("n").alias("o")))).alias("s")).select(*SNAP, "s.*")
    return s.groupBy(*SNAP, "id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


@query(CLOSURE + "select n.project_id, n.version, n.id, count(tp.node) n_descendants from n left join tp on tp.project_id = n.project_id and tp.version = n.version and tp.ancestor = n.id group by all")
def agg_count_descendants(g):
    return ag.count_descendants(_links(g))


_SUM = CLOSURE + ", leaf as (select n.project_id, n.version, n.id, case when coalesce(try_cast(json_extract_string(n.metadata, '$.loc') as double), 0) > 0 then try_cast(json_extract_string(n.metadata, '$.loc') as double) else 1.0 end v from n anti join pe on pe.project_id = n.project_id and pe.version = n.version and pe.parent = n.id), tot as (select project_id, version, id, sum(v) total from (select * from leaf union all select tp.project_id, tp.version, tp.ancestor, leaf.v from tp join leaf on leaf.project_id = tp.project_id and leaf.version = tp.version and leaf.id = tp.node) group by all)"


@query(_SUM + " select * from tot")
def agg_hierarchy_sum(g):
    return ag.hierarchy_sum(g.nodes, _links(g), fx.metric(F.col("metadata"), "loc"))


@query(_SUM + ", dep as (select project_id, version, node id, max(dist) depth from tp group by all) select tot.project_id, tot.version, tot.id, n.language, tot.total from tot join n using (project_id, version, id) left join dep using (project_id, version, id) where coalesce(dep.depth, 0) <= 2")
def agg_sunburst_ring(g):
    links = _links(g)
    depth = tr.depths(links).withColumnRenamed("node", "id")
    t = ag.hierarchy_sum(g.nodes, links, fx.metric(F.col("metadata"), "loc")).join(g.nodes.select(*SNAP, "id", "language"), [*SNAP, "id"]).join(depth, [*SNAP, "id"], "left")
    return t.filter(F.coalesce("depth", F.lit(0)) <= 2).select(*SNAP, "id", "language", "total")


@query(BASE + ", k as (select project_id, version, unnest(json_keys(metadata)) k, metadata from n where metadata is not null) select k as key, count(*) n, max(try_cast(json_extract_string(metadata, '$.' || k) as double)) top from k where try_cast(json_extract_string(metadata, '$.' || k) as double) is not null group by all")
def agg_metric_presets(g):
    kv = g.nodes.filter("metadata is not null").select(F.explode(F.from_json("metadata", "map<string,string>")).alias("key", "value"))
    kv = kv.withColumn("v", F.col("value").try_cast("double")).filter("v is not null")
    return kv.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


@query(BASE + "select project_id, version, kind, count(*) n from e group by all")
def agg_edge_kind_counts(g):
    return ag.edge_kind_counts(g.edges).orderBy(*SNAP, F.desc("n"), "kind")


@query("select project_id, unit_kind, count(distinct name) n from units group by all")
def agg_units_per_language(g):
    return g.raw("units").groupBy("project_id", "unit_kind").agg(F.countDistinct("name").alias("n"))


_WARNED = r"select source, text from documents where text is not null union all select 'warning', 'line ' || e.k || ': ' || e.n || ' method call(s): ' || (e.n // 3) || ' resolved, ' || (e.n - e.n // 3) || ' could not be resolved without type information' from (select kind k, count(*) n from edges where kind is not null group by all) e"


@query(rf"with w as ({_WARNED}), c as (select regexp_extract(text, 'method call\(s\):.*?(\d+) resolved', 1) r, regexp_extract(text, ', (\d+) could not be resolved', 1) u from w where contains(text, 'method call(s):')) select count(*) warnings, sum(nullif(r, '')::bigint)::bigint resolved, sum(nullif(u, '')::bigint)::bigint unresolved from c")
def agg_method_call_stats(g):
    """Warnings in the documents, with one per kind of edge as an analysis of the calls would write it."""
    n = F.col("count")
    kinds = g.raw("edges").filter("kind is not null").groupBy("kind").count()
    own = kinds.select(F.concat(F.lit("line "), "kind", F.lit(": "), n, F.lit(" method call(s): "), F.floor(n / 3), F.lit(" resolved, "), n - F.floor(n / 3), F.lit(" could not be resolved without type information")).alias("text"))
    return ag.method_call_stats(g.raw("documents").select("text").union(own))


def _rollup_sql(kind: str) -> str:
    return _SERVICE.format(k=kind) + ", x as (select e.project_id, e.version, e.id, e.kind, a.holder src, b.holder tgt from e join h a on a.project_id = e.project_id and a.version = e.version and a.node = e.source join h b on b.project_id = e.project_id and b.version = e.version and b.node = e.target where e.kind in ('depends', 'calls', 'data_flow') and a.holder <> b.holder) select project_id, version, src, tgt, count(*) weight, string_agg(distinct kind, ',' order by kind) kinds, min(id) first_edge, max(id) last_edge from x group by all"


@query(_rollup_sql("component"))
def agg_rollup_component(g):
    return ag.rollup(g.edges, ag.ancestor_of_kind(g.nodes, _links(g), "component"), "holder")


@query(_rollup_sql("service"))
def agg_rollup_service(g):
    return ag.rollup(g.edges, ag.ancestor_of_kind(g.nodes, _links(g), "service"), "holder")


_CHILD = CLOSURE + """, root as (select pe.project_id, pe.version, pe.parent id from pe join n on n.project_id = pe.project_id and n.version = pe.version and n.id = pe.parent and n.kind = 'service' group by pe.project_id, pe.version, pe.parent qualify row_number() over (partition by pe.project_id, pe.version order by count(*) desc, pe.parent) = 1), ch as (select pe.project_id, pe.version, pe.node child from pe semi join root on root.project_id = pe.project_id and root.version = pe.version and root.id = pe.parent),
cm as (select project_id, version, child node, child from ch union all select tp.project_id, tp.version, tp.node, ch.child from tp join ch on ch.project_id = tp.project_id and ch.version = tp.version and ch.child = tp.ancestor),
x as (select e.project_id, e.version, e.id, e.kind, a.child src, b.child tgt from e join cm a on a.project_id = e.project_id and a.version = e.version and a.node = e.source join cm b on b.project_id = e.project_id and b.version = e.version and b.node = e.target where e.kind in ('depends', 'calls', 'data_flow') and a.child <> b.child)
"""
_ROLLED = "select project_id, version, src, tgt, count(*) weight, string_agg(distinct kind, ',' order by kind) kinds, min(id) first_edge, max(id) last_edge from x"


def _children(g):
    """The children of each snapshot's widest service, with all below them."""
    links = _links(g)
    held = links.join(g.nodes.filter("kind = 'service'").select(*SNAP, F.col("id").alias("parent")), [*SNAP, "parent"], "left_semi").groupBy(*SNAP, "parent").count()
    w = Window.partitionBy(*SNAP).orderBy(F.desc("count"), "parent")  # one row per service
    return ag.children_of(links, held.withColumn("k", F.row_number().over(w)).filter("k = 1").select(*SNAP, F.col("parent").alias("id")))


@query(_CHILD + _ROLLED + " group by all")
def agg_rollup_children(g):
    """Edges between the children of one parent, each child standing for all below it."""
    return ag.rollup(g.edges, _children(g), "child")


@query(_CHILD + ", most as (select * from (" + _ROLLED + " group by all) z qualify row_number() over (partition by project_id, version order by weight desc, src, tgt) = 1) select x.project_id, x.version, x.src, x.tgt, x.kind, count(*) n, min(x.id) sample from x semi join most using (project_id, version, src, tgt) group by all")
def agg_aggregated_edges(g):
    """The edges behind the heaviest pair of children: per kind their number and a sample."""
    children = write_table(_children(g), "children")
    w = Window.partitionBy(*SNAP).orderBy(F.desc("weight"), "src", "tgt")
    pair = ag.rollup(g.edges, children, "child").withColumn("k", F.row_number().over(w)).filter("k = 1").select(*SNAP, "src", "tgt")
    return ag.edges_between(g.edges, children, "child", pair)


@query(TOP + ", x as (select e.project_id, e.version, a.top src, b.top tgt from e join top a on a.project_id = e.project_id and a.version = e.version and a.node = e.source join top b on b.project_id = e.project_id and b.version = e.version and b.node = e.target where e.kind in ('depends', 'calls', 'data_flow') and a.top <> b.top) select project_id, version, src component, count(distinct tgt) n_targets, count(*) weight from x group by all")
def agg_component_deps(g):
    r = ag.rollup(g.edges, tr.top_modules(_links(g)), "top")
    return r.groupBy(*SNAP, F.col("src").alias("component")).agg(F.count(F.lit(1)).alias("n_targets"), F.sum("weight").alias("weight"))


# --- windows, sorts, set operations ---------------------------------------------------------------------------------------------------

_SIB = BASE + ", p as (select project_id, version, target id, max(source) parent from e where kind = 'contains' group by all), v as (select n.project_id, n.version, n.id, n.name as label, coalesce(p.parent, '') parent from n left join p using (project_id, version, id)), w as (select *, lead(id) over (partition by project_id, version, parent order by lower(label), label, id) nx, first_value(id) over (partition by project_id, version, parent order by lower(label), label, id) fst, count(*) over (partition by project_id, version, parent) c, row_number() over (partition by project_id, version, parent order by lower(label), label, id) k from v)"


def _siblings(g):
    v = lk.view_nodes(g.nodes, g.edges).withColumn("parent", F.coalesce("parent", F.lit("")))
    return v, Window.partitionBy(*SNAP, "parent").orderBy(F.lower("label"), "label", "id")


@query(_SIB + " select project_id, version, id, case when c > 1 then coalesce(nx, fst) end next_id from w")
def win_next_sibling(g):
    v, w = _siblings(g)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = v.withColumns({"nx": F.lead("id").over(w), "fst": F.first("id").over(whole), "c": F.count(F.lit(1)).over(whole)})
    return v.select(*SNAP, "id", F.when(F.col("c") > 1, F.coalesce("nx", "fst")).alias("next_id"))


@query(_SIB.replace("row_number() over (partition by project_id, version, parent", "last_value(id) over (partition by project_id, version, parent order by lower(label), label, id rows between unbounded preceding and unbounded following) as lst, lag(id) over (partition by project_id, version, parent order by lower(label), label, id) as pv, row_number() over (partition by project_id, version, parent") + " select project_id, version, id, case when c > 1 then coalesce(pv, lst) end prev_id from w")
def win_prev_sibling(g):
    v, w = _siblings(g)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v = v.withColumns({"pv": F.lag("id").over(w), "lst": F.last("id").over(whole), "c": F.count(F.lit(1)).over(whole)})
    return v.select(*SNAP, "id", F.when(F.col("c") > 1, F.coalesce("pv", "lst")).alias("prev_id"))


@query(_SIB + " select project_id, version, parent, id child from w where k = 1 and parent <> ''")
def win_first_child(g):
    v, _ = _siblings(g)
    key = F.struct(F.lower("label").alias("a"), F.col("label").alias("b"), F.col("id").alias("c"))
    return v.filter("parent <> ''").groupBy(*SNAP, "parent").agg(F.min(key).alias("k")).select(*SNAP, "parent", F.col("k.c").alias("child"))


@query(BASE + "select project_id, kind, max(version) version from s group by all")
def win_latest_version(g):
    return g.snapshots.groupBy("project_id", "kind").agg(F.max("version").alias("version"))


@query(BASE + ", c as (select s.project_id, s.version, (select count(*) from n where n.project_id = s.project_id and n.version = s.version) k from s) select project_id, version, k - lag(k) over (partition by project_id order by version) delta from c")
def win_snapshot_drift(g):
    c = g.snapshots.select(*SNAP).join(ag.count_rows(g.nodes, "k"), SNAP, "left").fillna(0, ["k"])
    return c.select(*SNAP, (F.col("k") - F.lag("k").over(Window.partitionBy("project_id").orderBy("version"))).alias("delta"))


@query("select project_id, version, lower(trim(id)) id, arg_max(name, loaded_at) as name, arg_max(kind, loaded_at) kind, arg_max(provenance, loaded_at) provenance from nodes where trim(id) <> '' group by all")
def win_last_wins(g):
    return g.nodes.select(*SNAP, "id", "name", "kind", "provenance")


@query("select id, name from projects order by id")
def ord_projects(g):
    return g.raw("projects").orderBy("id").select("id", "name")


@query(BASE + "select project_id, version, kind from s order by 1, 2")
def ord_snapshots(g):
    return g.snapshots.select(*SNAP, "kind").orderBy(*SNAP)


@query(BASE + "select project_id, version from s order by version desc, project_id limit 1")
def top1_max_version(g):
    return g.snapshots.select(*SNAP).orderBy(F.desc("version"), "project_id").limit(1)


@query(_CHANGES)
def ord_diff(g):
    return join_full_outer_diff(g).orderBy("project_id", "from_version", "canonical_path")


@query(DEGREES + "select * from roots")
def ord_roots(g):
    return ag.roots(g.nodes, g.edges).orderBy(*SNAP, "category", "node_id")


@query(BASE + f"select e.project_id, e.version, a.canonical_path source_path, b.canonical_path target_path, e.kind from e {ENDS}")
def ord_export(g):
    return rl.path_edges(g.edges, g.nodes).drop("edge_id").orderBy(*SNAP, "source_path", "target_path", "kind")


@query(_MATRIX + "select project_id, version, id, sum(n)::bigint total from (select project_id, version, src id, n from cells union all select project_id, version, tgt, n from cells) group by all")
def ord_matrix_dep_count(g):
    c = ag.dependency_matrix(g.edges, _links(g))
    both = c.select(*SNAP, F.col("src").alias("id"), "n").union(c.select(*SNAP, "tgt", "n"))
    return both.groupBy(*SNAP, "id").agg(F.sum("n").alias("total")).orderBy(*SNAP, F.desc("total"), "id")


@query(_SIB + " select project_id, version, parent, id, k::int as rank from w")
def ord_matrix_alpha(g):
    v, w = _siblings(g)
    return v.select(*SNAP, "parent", "id", F.row_number().over(w).alias("rank"))


@query("select doc_id, text from documents where source = 'analysis_warning' order by doc_id limit 20")
def top20_warnings(g):
    return g.raw("documents").filter("source = 'analysis_warning'").select("doc_id", "text").orderBy("doc_id").limit(20)


@query(BASE + "select project_id, version, source id from e where kind = 'depends' union select project_id, version, target from e where kind = 'depends'")
def set_union_rules(g):
    e = of_kind(g.edges, "depends")
    return e.select(*SNAP, F.col("source").alias("id")).union(e.select(*SNAP, F.col("target").alias("id"))).distinct()


_KEYS = PAIRS + f", r as (select distinct e.project_id, e.version, a.canonical_path sp, b.canonical_path tp, e.kind from e {ENDS})"


def _edge_sets(g):
    k = rl.path_edges(g.edges, g.nodes).select(*SNAP, "source_path", "target_path", "kind").distinct()
    pairs = sc.snapshot_pairs(g.nodes)
    old = k.join(pairs.withColumnRenamed("from_version", "version"), SNAP).select("project_id", F.col("version").alias("from_version"), "to_version", "source_path", "target_path", "kind")
    new = k.join(pairs.withColumnRenamed("to_version", "version"), SNAP).select("project_id", "from_version", F.col("version").alias("to_version"), "source_path", "target_path", "kind")
    return old, new


_SETS = _KEYS + ", o as (select p.*, r.sp source_path, r.tp target_path, r.kind from pairs p join r on r.project_id = p.project_id and r.version = p.from_version), w as (select p.*, r.sp source_path, r.tp target_path, r.kind from pairs p join r on r.project_id = p.project_id and r.version = p.to_version)"


@query(_SETS + " select * from o except select * from w")
def set_except_edges(g):
    old, new = _edge_sets(g)
    return old.subtract(new)


@query(_SETS + " select *, 'removed' change from (select * from o except select * from w) union all select *, 'added' from (select * from w except select * from o)")
def join_edge_key_diff(g):
    old, new = _edge_sets(g)
    by = old.columns
    return old.join(new, by, "left_anti").withColumn("change", F.lit("removed")).union(new.join(old, by, "left_anti").withColumn("change", F.lit("added")))


@query(_DESIGN + "select * from d intersect select * from a")
def set_intersect_nodes(g):
    d, a, by = _design(g)
    return d.select(*by, "canonical_path").intersect(a.select(*by, "canonical_path"))


_DRIFT = PAIRS + ", o as (select p.*, n.id from pairs p join n on n.project_id = p.project_id and n.version = p.from_version), w as (select p.*, n.id from pairs p join n on n.project_id = p.project_id and n.version = p.to_version)"


@query(_DRIFT + " select *, 'removed' change from (select * from o except select * from w) union all select *, 'added' from (select * from w except select * from o)")
def set_drift(g):
    pairs = sc.snapshot_pairs(g.nodes)
    n = g.nodes.select(*SNAP, "id")
    old = n.join(pairs.withColumnRenamed("from_version", "version"), SNAP).select("project_id", F.col("version").alias("from_version"), "to_version", "id")
    new = n.join(pairs.withColumnRenamed("to_version", "version"), SNAP).select("project_id", "from_version", F.col("version").alias("to_version"), "id")
    return old.join(new, old.columns, "left_anti").withColumn("change", F.lit("removed")).union(new.join(old, old.columns, "left_anti").withColumn("change", F.lit("added")))


@query(_DRIFT + " select * from o except select * from w")
def set_except_drift(g):
    return set_drift(g).filter("change = 'removed'").drop("change")


@query(_KEEP + "select n.project_id, n.version, n.id from n semi join keep using (project_id, version)")
def set_member_keep(g):
    keep = g.snapshots.groupBy("project_id").agg(F.max("version").alias("version"))
    return g.nodes.join(keep, SNAP, "left_semi").select(*SNAP, "id")
