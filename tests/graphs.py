"""Small tables in the shape of the raw ones, with dirty rows, and brute-force versions of the operators over them."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

NODES = "id string, canonical_path string, qualified_name string, kind string, sub_kind string, name string, language string, provenance string, source_ref string, metadata string, project_id string, version long, loaded_at timestamp"
EDGES = "id string, source string, target string, kind string, provenance string, metadata string, project_id string, version long, loaded_at timestamp"
SHARED = "id string, canonical_path string, qualified_name string, kind string, sub_kind string, name string, language string, provenance string, metadata string"
T0 = datetime(2024, 1, 1)


def at(minutes: int) -> datetime:
    return T0 + timedelta(minutes=minutes)


def node(i, path=None, version=1, project="p", minute=0, kind="unit", **more):
    d = {"id": i, "canonical_path": path if path is not None else f"/{i}", "qualified_name": None, "kind": kind, "sub_kind": "fn", "name": i, "language": "go", "provenance": "analysis", "source_ref": None, "metadata": None, "project_id": project, "version": version, "loaded_at": at(minute)} | more
    return tuple(d[c.split()[0]] for c in NODES.split(", "))


def edge(i, s, t, kind="contains", version=1, project="p", minute=10):
    return (i, s, t, kind, "analysis", None, project, version, at(minute))


def frames(spark, nodes, edges, shared=()):
    return spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(list(edges), EDGES), spark.createDataFrame([(s, f"/ext/{s}", None, "component", None, s, None, "analysis", None) for s in shared], SHARED)


def random_tables(seed: int, n: int = 30, versions: int = 4):
    """Nodes, edges and shared ids with late, repeated, corrected and missing rows and uneven spelling."""
    r = random.Random(seed)
    nodes, edges = [], []
    for project in ("p", "q"):
        for v in range(1, versions + 1):
            ids = [f"n{i}" for i in range(n) if r.random() < 0.8]
            for i in ids:
                path = f"/a/{i}" if r.random() < 0.8 else f" /A/{i.upper()}/ "
                for _ in range(r.choice([1, 1, 1, 2])):
                    nodes.append(node(i if r.random() < 0.9 else f" {i.upper()}", path, v, project, r.randint(0, 20), r.choice(["unit", "component"]), language=r.choice(["go", None, "ts"])))
            for k in range(2 * n):
                for _ in range(r.choice([1, 1, 2])):
                    s, t = (r.choice([f"n{r.randrange(n)}", f"n{r.randrange(n + 5)}", "n1", "s1", None, " ", "ghost"]) for _ in "st")
                    edges.append(edge(f"e{k}", s, t, r.choice(["contains", "depends", "depends", "calls"]), v, project, r.randint(0, 40)))
    # equal times of one key would leave the counting row open
    seen, out = {}, ([], [])
    for rows, res in ((nodes, out[0]), (edges, out[1])):
        for x in rows:
            key = (len(x), x[0].strip().lower(), x[-3], x[-2])
            minute = x[-1]
            while (key, minute) in seen:
                minute += timedelta(seconds=1)
            seen[(key, minute)] = 1
            res.append((*x[:-1], minute))
    return out[0], out[1], ["s1", "S2"]


def norm(x):
    x = x.strip().lower() if x is not None else None
    return x or None


def latest(rows):
    best = {}
    for x in rows:
        k = (x[-3], x[-2], norm(x[0]))
        if k[2] and (k not in best or x[-1] > best[k][-1]):
            best[k] = x
    return best


def orphans(nodes, edges, shared):
    first, spans = {}, {}
    for x in nodes:
        k = (x[-3], x[-2], norm(x[0]))
        first[k] = min(first.get(k, x[-1]), x[-1])
        spans.setdefault((k[0], k[2]), set()).add(k[1])
    sh, out = {norm(s) for s in shared}, set()
    for (p, v, e), x in latest(edges).items():
        for end, ref in (("source", norm(x[1])), ("target", norm(x[2]))):
            if ref is None:
                continue
            f = first.get((p, v, ref))
            if f is not None:
                if f > x[-1]:
                    out.add((p, v, e, end, "late"))
            elif ref not in sh:
                other = spans.get((p, ref), set())
                out.add((p, v, e, end, "deleted" if any(o < v for o in other) else "late" if any(o > v for o in other) else "missing"))
    return out


def hierarchy(nodes, edges):
    there = {k for k in latest(nodes)}
    up = {}
    for (p, v, _), x in latest(edges).items():
        s, t = (p, v, norm(x[1])), (p, v, norm(x[2]))
        if x[3] == "contains" and s in there and t in there:
            up[t] = min(up.get(t, s), s)
    out = set()
    for k in there:
        seen, at_ = [k], k
        while at_ in up and up[at_] not in seen:
            at_ = up[at_]
            seen.append(at_)
        out.add((*k, "", -1) if at_ in up else (*k, at_[2], len(seen) - 1))
    return out


def changes(nodes, edges, shared):
    n, e = latest(nodes), latest(edges)
    path = {k: x[1].strip().lower().rstrip("/") for k, x in n.items()}
    out, by = set(), {}
    for p, v, _ in n:
        by.setdefault(p, set()).add(v)
    sh = {norm(s): f"/ext/{s}".lower() for s in shared}

    def rows(p, v):
        a = {path[k]: (x[3], x[4], x[6], x[7], x[8]) for k, x in n.items() if k[:2] == (p, v)}
        b = set()
        for k, x in e.items():
            if k[:2] == (p, v):
                s, t = (path.get((p, v, norm(y))) or sh.get(norm(y)) for y in x[1:3])
                if s and t:
                    b.add((s, t, x[3]))
        return a, b

    for p, vs in by.items():
        vs = sorted(vs)
        for f, t in zip(vs, vs[1:]):
            (a, c), (b, d) = rows(p, f), rows(p, t)
            for k in a.keys() | b.keys():
                ch = "added" if k not in a else "removed" if k not in b else "changed" if a[k] != b[k] else None
                if ch:
                    out.add((p, f, t, "node", k, "", "", ch))
            out |= {(p, f, t, "edge", *k, "added") for k in d - c} | {(p, f, t, "edge", *k, "removed") for k in c - d}
    return out
