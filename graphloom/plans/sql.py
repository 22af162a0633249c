"""Pieces of the comparison SQL: common table expressions over the raw tables, in DuckDB's dialect."""

BLANKS = r"e' \t\r\n'"
BASE = rf"""with recursive n as (select project_id, version, nullif(lower(trim(id, {BLANKS})), '') id, rtrim(lower(trim(canonical_path, {BLANKS})), '/') canonical_path, * exclude (project_id, version, id, canonical_path)
  from nodes qualify nullif(lower(trim(nodes.id, {BLANKS})), '') is not null and row_number() over (partition by project_id, version, nullif(lower(trim(nodes.id, {BLANKS})), '') order by loaded_at desc, metadata desc nulls last) = 1),
e as (select project_id, version, nullif(lower(trim(id, {BLANKS})), '') id, nullif(lower(trim(source, {BLANKS})), '') source, nullif(lower(trim(target, {BLANKS})), '') target, kind, provenance, metadata
  from edges qualify nullif(lower(trim(edges.id, {BLANKS})), '') is not null and row_number() over (partition by project_id, version, nullif(lower(trim(edges.id, {BLANKS})), '') order by loaded_at desc, metadata desc nulls last) = 1),
s as (select project_id, version, min(kind) kind, min(commit_ref) commit_ref, min(created_at) created_at from snapshots group by all),
m as (select project_id, version, path, max(hash) hash, max(unit_name) unit_name, max(language) as language from file_manifest where path is not null group by all),
sh as (select lower(trim(id, {BLANKS})) id, rtrim(lower(trim(canonical_path, {BLANKS})), '/') canonical_path from shared_nodes)
"""
#: Parents, the closure with fewest steps, and the closure of trees only.
CLOSURE = (
    BASE
    + """, pe as (select distinct e.project_id, e.version, e.target as node, e.source as parent from e join n a on a.project_id = e.project_id and a.version = e.version and a.id = e.source join n b on b.project_id = e.project_id and b.version = e.version and b.id = e.target where e.kind = 'contains'),
cl0 as (select project_id, version, node, parent ancestor, 1::bigint dist from pe union select c.project_id, c.version, c.node, p.parent, c.dist + 1 from cl0 c join pe p on p.project_id = c.project_id and p.version = c.version and p.node = c.ancestor where c.dist < 70),
cl as (select project_id, version, node, ancestor, min(dist) dist from cl0 group by all),
cyc as (select project_id, version, node id from cl where node = ancestor),
tp as (select * from cl where not exists (select 1 from cl c2 join cyc on cyc.project_id = c2.project_id and cyc.version = c2.version and cyc.id = c2.ancestor where c2.project_id = cl.project_id and c2.version = cl.version and c2.node = cl.node))
"""
)
#: Top modules of tree nodes.
TOP = (
    CLOSURE
    + """, dep as (select project_id, version, node, max(dist) depth from tp group by all),
top as (select tp.project_id, tp.version, tp.node, tp.ancestor as top from tp join dep using (project_id, version, node) where tp.dist = dep.depth - 1 union all select project_id, version, node, node from dep where depth = 1)
"""
)
#: Visible stand-ins with roots expanded, and edges mapped to them.
SHOWN = (
    CLOSURE
    + """, opened as (select n.project_id, n.version, n.id from n anti join pe on pe.project_id = n.project_id and pe.version = n.version and pe.node = n.id),
closed as (select tp.* from tp anti join opened o on o.project_id = tp.project_id and o.version = tp.version and o.id = tp.ancestor),
shown as (select n.project_id, n.version, n.id node, coalesce((select arg_max(c.ancestor, c.dist) from closed c where c.project_id = n.project_id and c.version = n.version and c.node = n.id), n.id) shown from n),
me as (select e.*, a.shown src, b.shown tgt from e join shown a on a.project_id = e.project_id and a.version = e.version and a.node = e.source join shown b on b.project_id = e.project_id and b.version = e.version and b.node = e.target where e.kind <> 'contains')
"""
)
DEGREES = (
    BASE
    + """, ends as (select project_id, version, target id, (kind = 'calls')::int ci, 0 co, (kind = 'depends')::int di, 0 d_o, (kind = 'contains')::int held, 1 ins, 0 outs from e union all select project_id, version, source, 0, (kind = 'calls')::int, 0, (kind = 'depends')::int, 0, 0, 1 from e),
deg0 as (select project_id, version, id, sum(ci) ci, sum(co) co, sum(di) di, sum(d_o) d_o, sum(held) held, sum(ins) ins, sum(outs) outs from ends where id is not null group by all),
deg as (select n.project_id, n.version, n.id, n.kind, n.canonical_path, n.name, coalesce(ci, 0)::bigint calls_in, coalesce(co, 0)::bigint calls_out, coalesce(di, 0)::bigint depends_in, coalesce(d_o, 0)::bigint depends_out, coalesce(held, 0) > 0 is_contained, coalesce(ins, 0) > 0 has_in, coalesce(outs, 0) > 0 has_out from n left join deg0 using (project_id, version, id)),
roots as (select project_id, version, 'call_tree_roots' category, id node_id, canonical_path, name from deg where calls_out > 0 and calls_in = 0
  union all select project_id, version, 'dependency_sources', id, canonical_path, name from deg where depends_in > 0 and depends_in >= 3 * (depends_out + 1)
  union all select project_id, version, 'dependency_sinks', id, canonical_path, name from deg where depends_out > 0 and depends_out >= 3 * (depends_in + 1)
  union all select project_id, version, 'containment_roots', id, canonical_path, name from deg where kind in ('system', 'service') and not is_contained
  union all select project_id, version, 'leaf_sinks', id, canonical_path, name from deg where has_in and not has_out)
"""
)
PAIRS = BASE + ", pairs as (select * from (select project_id, version from_version, lead(version) over (partition by project_id order by version) to_version from (select distinct project_id, version from n)) where to_version is not null)\n"
ENDS = "join n a on a.project_id = e.project_id and a.version = e.version and a.id = e.source join n b on b.project_id = e.project_id and b.version = e.version and b.id = e.target"
