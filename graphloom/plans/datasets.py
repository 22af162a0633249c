"""Queries pN_ of the general data problems and their SQL."""

from __future__ import annotations

from graphloom.operators import hierarchy, hotkeys, orphans, snapshot_changes
from graphloom.tables import table


def _t(*names):
    return lambda s, d: [table(s, d, n) for n in names]


def p2_found(s, d):
    return orphans.orphan_references(*_t("edges", "nodes", "shared_nodes")(s, d)).drop("loaded_at")


def p2_rates(s, d):
    return orphans.orphan_rates(orphans.orphan_references(*_t("edges", "nodes", "shared_nodes")(s, d)))


def p3_found(s, d):
    return snapshot_changes.snapshot_changes(*_t("nodes", "edges", "shared_nodes")(s, d))


def p4_found(s, d):
    return hotkeys.heavy_targets(table(s, d, "edges"))


def p4_degrees(s, d):
    return hotkeys.depends_degrees(table(s, d, "edges"))


def p6_found(s, d):
    return hierarchy.node_depths(*_t("nodes", "edges")(s, d))


def p6_paths(s, d):
    return hierarchy.node_paths(*_t("nodes", "edges")(s, d))


def p6_descendants(s, d):
    return hierarchy.descendants(*_t("nodes", "edges")(s, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p3_found, p4_found, p4_degrees, p6_found, p6_paths, p6_descendants)}

_BASE = r"""
with recursive nid as (select project_id, version, nullif(lower(trim(id, e' \t\r\n')), '') id, rtrim(lower(trim(canonical_path, e' \t\r\n')), '/') path, kind, sub_kind, language, provenance, source_ref, loaded_at from nodes),
nall as (select project_id, version, id, min(loaded_at) first_loaded from nid where id is not null group by all),
n as (select * from nid where id is not null qualify row_number() over (partition by project_id, version, id order by loaded_at desc) = 1),
e as (select project_id, version, nullif(lower(trim(id, e' \t\r\n')), '') edge_id, nullif(lower(trim(source, e' \t\r\n')), '') source, nullif(lower(trim(target, e' \t\r\n')), '') target, kind, loaded_at from edges
  qualify edge_id is not null and row_number() over (partition by project_id, version, edge_id order by loaded_at desc) = 1),
sh as (select lower(trim(id, e' \t\r\n')) id, rtrim(lower(trim(canonical_path, e' \t\r\n')), '/') path from shared_nodes)
"""
_ORPHANS = _BASE + r""",
refs as (select project_id, version, edge_id, 'source' endpoint, source ref, loaded_at from e where source is not null union all select project_id, version, edge_id, 'target', target, loaded_at from e where target is not null),
span as (select project_id, id, min(version) lo, max(version) hi from nall group by all),
found as (select r.project_id, r.version, r.edge_id, r.endpoint, r.loaded_at,
  case when a.id is not null then 'late' when s.lo < r.version then 'deleted' when s.hi > r.version then 'late' else 'missing' end reason
  from refs r left join nall a on a.project_id = r.project_id and a.version = r.version and a.id = r.ref left join span s on s.project_id = r.project_id and s.id = r.ref
  where (a.id is null and r.ref not in (select id from sh where id is not null)) or a.first_loaded > r.loaded_at)
"""
_DEGREES = _BASE + r""",
deg as (select id node_id, sum(i)::bigint depends_in, sum(o)::bigint depends_out from (select target id, 1 i, 0 o from e where kind = 'depends' union all select source, 0, 1 from e where kind = 'depends') where id is not null group by all)
"""
_TREE = _BASE + r""",
up as (select e.project_id, e.version, e.target id, min(e.source) parent from e join nall a on a.project_id = e.project_id and a.version = e.version and a.id = e.source join nall b on b.project_id = e.project_id and b.version = e.version and b.id = e.target where e.kind = 'contains' group by all),
tree as (select a.project_id, a.version, a.id, a.id root_id, 0::bigint as depth, a.id path, [a.id] line from nall a anti join up u on u.project_id = a.project_id and u.version = a.version and u.id = a.id
  union all select u.project_id, u.version, u.id, t.root_id, t.depth + 1, t.path || '/' || u.id, list_append(t.line, u.id) from tree t join up u on u.project_id = t.project_id and u.version = t.version and u.parent = t.id)
"""

ORACLES = {
    "p2_found": _ORPHANS + "select project_id, version, edge_id, endpoint, reason from found",
    "p2_rates": _ORPHANS + "select 'edges' table_name, strftime(loaded_at at time zone 'UTC', '%Y-%m') as month, endpoint, reason, count(*) n from found group by all",
    "p3_found": _BASE
    + r""",
pairs as (select * from (select project_id, version from_version, lead(version) over (partition by project_id order by version) to_version from (select distinct project_id, version from nall)) where to_version is not null),
np as (select * from n where path is not null),
nodech as (select p.project_id, p.from_version, p.to_version, coalesce(a.path, b.path) source_path,
  case when a.path is null then 'added' when b.path is null then 'removed' when a.kind is distinct from b.kind or a.sub_kind is distinct from b.sub_kind or a.language is distinct from b.language or a.provenance is distinct from b.provenance or a.source_ref is distinct from b.source_ref then 'changed' end change
  from (select p.*, n.* exclude (project_id) from pairs p join np n on n.project_id = p.project_id and n.version = p.from_version) a
  full join (select p.*, n.* exclude (project_id) from pairs p join np n on n.project_id = p.project_id and n.version = p.to_version) b using (project_id, from_version, to_version, path) join pairs p on p.project_id = project_id and p.from_version = from_version),
ends as (select project_id, version, id, path from n union all select p.project_id, p.version, sh.id, sh.path from (select distinct project_id, version from nall) p, sh anti join n on n.project_id = p.project_id and n.version = p.version and n.id = sh.id),
res as (select distinct e.project_id, e.version, a.path sp, b.path tp, coalesce(e.kind, '') kind from e join ends a on a.project_id = e.project_id and a.version = e.version and a.id = e.source join ends b on b.project_id = e.project_id and b.version = e.version and b.id = e.target),
edgech as (select p.project_id, p.from_version, p.to_version, r.sp, r.tp, r.kind, 'added' change from pairs p join res r on r.project_id = p.project_id and r.version = p.to_version anti join res o on o.project_id = p.project_id and o.version = p.from_version and o.sp = r.sp and o.tp = r.tp and o.kind = r.kind
  union all select p.project_id, p.from_version, p.to_version, r.sp, r.tp, r.kind, 'removed' from pairs p join res r on r.project_id = p.project_id and r.version = p.from_version anti join res o on o.project_id = p.project_id and o.version = p.to_version and o.sp = r.sp and o.tp = r.tp and o.kind = r.kind)
select project_id, from_version, to_version, 'node' item, source_path, '' target_path, '' edge_kind, change from nodech where change is not null union all select project_id, from_version, to_version, 'edge', sp, tp, kind, change from edgech""",
    "p4_found": _DEGREES + "select node_id from deg where depends_in >= 3 * (depends_out + 1)",
    "p4_degrees": _DEGREES + "select * from deg",
    "p6_found": _TREE + "select a.project_id, a.version, a.id node_id, coalesce(t.root_id, '') root_id, coalesce(t.depth, -1) as depth from nall a left join tree t on t.project_id = a.project_id and t.version = a.version and t.id = a.id",
    "p6_paths": _TREE + "select a.project_id, a.version, a.id node_id, coalesce(t.root_id, '') root_id, coalesce(t.depth, -1) as depth, coalesce(t.path, '') path from nall a left join tree t on t.project_id = a.project_id and t.version = a.version and t.id = a.id",
    "p6_descendants": _TREE + "select project_id, version, line[i] node_id, id descendant_id, depth - i + 1 distance from (select *, unnest(range(1, depth + 1)) i from tree)",
}
