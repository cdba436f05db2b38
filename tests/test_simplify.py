"""Edge collapse and grouping by adjacency, against plain Python."""

import math
import random

import numpy as np
import pytest

from massif.operators import mesh, simplify
from massif.operators.components import connected_components


def terrain(n, seed, gone=()):
    rng = random.Random(seed)
    vertices = [(y * n + x, float(x), float(y), rng.random()) for x in range(n) for y in range(n)]
    quads = [(x, y) for x in range(n - 1) for y in range(n - 1) if (x, y) not in gone]
    return vertices, [t for x, y in quads for i in [y * n + x] for t in ((i, i + 1, i + n + 1), (i + n + 1, i + n, i))]


def tables(spark, vertices, rows):
    return spark.createDataFrame(vertices, "vid long, x double, y double, z double"), spark.createDataFrame(rows, "a long, b long, c long")


def plain_simplify(vertices, rows, ratio, max_error, locked=(), least=0.2):
    """The same rounds by loops: all candidates, those least around them, and what their collapse leaves."""
    at = {v: np.array(p) for v, *p in vertices}
    tri = [tuple(t) for t in rows]
    quad = {v: np.zeros((4, 4)) for v in at}
    weight = dict.fromkeys(at, 0.0)
    for t in tri:
        n = np.cross(at[t[1]] - at[t[0]], at[t[2]] - at[t[0]])
        size = np.linalg.norm(n)
        plane = np.append(n / size, -(n / size) @ at[t[0]])
        for v in t:
            quad[v] += np.outer(plane, plane) * size / 2
            weight[v] += size / 2
    error = dict.fromkeys(at, 0.0)

    def edges():
        out = {}
        for t in tri:
            for i in range(3):
                out.setdefault(tuple(sorted((t[i], t[(i + 1) % 3]))), []).append(t)
        return out

    fixed = {v for e, ts in edges().items() if len(ts) != 2 for v in e} | set(locked)
    target, barred = math.ceil(len(tri) * ratio), set()
    while len(tri) > target:
        found, near, ring = {}, {}, {}
        for t in tri:
            for v in t:
                near.setdefault(v, set()).update(set(t) - {v})
                ring.setdefault(v, []).append(t)
        for (u, v), ts in edges().items():
            if len(ts) != 2 or {u, v} <= fixed or len(near[u] & near[v]) != 2 or (u, v) in barred:
                continue
            q = quad[u] + quad[v]
            places = [at[u]] if u in fixed else [at[v]] if v in fixed else [at[u], at[v], (at[u] + at[v]) / 2]
            if not {u, v} & fixed and abs(np.linalg.det(q[:3, :3])) > np.trace(q[:3, :3]) ** 3 * 1e-6:
                places.append(np.linalg.solve(q[:3, :3], -q[:3, 3]))
            costs = [max(0.0, np.append(p, 1) @ q @ np.append(p, 1)) for p in places]
            k = int(np.argmin(costs))
            e = math.sqrt(costs[k] / (weight[u] + weight[v]))
            if e <= max_error:
                found[u, v] = (e, places[k], q)
        chosen = [
            (found[e][0], *e) for e in found
            if all((found[e][0], *e) <= (found[f][0], *f) for w in e for t in ring[w] for x in t for y in near[x] for f in [tuple(sorted((x, y)))] if f in found)
        ]
        good, turned = [], set()
        for e, u, v in sorted(chosen):
            to = found[u, v][1]
            for t in {*ring[u], *ring[v]}:
                if (u in t) + (v in t) == 1:
                    a, b = ([at[w] for w in t], [to if w in (u, v) else at[w] for w in t])
                    m, n = (np.cross(p[1] - p[0], p[2] - p[0]) for p in (a, b))
                    if m @ n <= least * np.linalg.norm(m) * np.linalg.norm(n):
                        turned.add((u, v))
            if (u, v) not in turned:
                good.append((e, u, v))
        barred |= turned
        good = good[: (len(tri) - target + 1) // 2]
        if not good and not turned:
            break
        for e, u, v in good:
            stays, goes = (v, u) if v in fixed else (u, v)
            at[stays], quad[stays], weight[stays] = found[u, v][1], found[u, v][2], weight[u] + weight[v]
            error[stays] = max(error[u], error[v], e)
            tri = [tuple(stays if w == goes else w for w in t) for t in tri]
        tri = [t for t in tri if len(set(t)) == 3]
    return tri, at, error, fixed


@pytest.mark.parametrize(("ratio", "bound", "gone"), [(0.6, math.inf, ()), (0.0, 0.12, ((2, 2), (2, 3)))])
def test_rounds_are_those_of_plain_loops(spark, ratio, bound, gone):
    vertices, rows = terrain(7, 5, gone)
    lock = [(24,), (25,)]
    want, at, error, fixed = plain_simplify(vertices, rows, ratio, bound, [x for (x,) in lock])
    v, t = simplify.simplify(*tables(spark, vertices, rows), ratio=ratio, max_error=bound, locked=spark.createDataFrame(lock, "vid long"))
    got = {r.vid: r for r in v.collect()}
    form = lambda ts: sorted(min((a, b, c), (b, c, a), (c, a, b)) for a, b, c in ts)
    assert form((r.a, r.b, r.c) for r in t.collect()) == form(want)
    for k in {x for w in want for x in w}:
        assert (got[k].x, got[k].y, got[k].z) == pytest.approx(tuple(at[k]), abs=1e-6) and got[k].error == pytest.approx(error[k], abs=1e-6)
    assert len(want) < len(rows) and (ratio == 0 or len(want) <= math.ceil(len(rows) * ratio))
    start = {k: p for k, *p in vertices}
    assert all(k in got and [got[k].x, got[k].y, got[k].z] == start[k] for k in fixed if any(k in w for w in want)) and fixed >= {24, 25}
    assert max(r.error for r in got.values()) <= bound
    both = tables(spark, vertices, rows)[1]
    assert mesh.boundary_edges(t).count() == mesh.boundary_edges(both).count() and mesh.inconsistent_edges(t).isEmpty()


def test_a_flat_mesh_keeps_its_plane_and_an_empty_one_is_empty(spark):
    vertices, rows = terrain(7, 1)
    vertices = [(k, x + 0.01 * ((k * 7) % 5), y + 0.01 * ((k * 3) % 7), 2.0) for k, x, y, _ in vertices]
    v, t = simplify.simplify(*tables(spark, vertices, rows), ratio=0.3, max_error=1e-6)
    assert t.count() <= math.ceil(0.3 * len(rows)) + 1 and all(abs(r.z - 2) < 1e-9 and r.error < 1e-6 for r in v.collect())
    none = simplify.simplify(*[x.limit(0) for x in tables(spark, vertices, rows)])
    assert none[0].count() == none[1].count() == 0


def test_groups_hang_together_and_cut_little(spark):
    n = 9
    rng = random.Random(2)
    links = [(y * n + x, y * n + x + 1, rng.randint(1, 9)) for x in range(n - 1) for y in range(n)] + [(y * n + x, y * n + n + x, rng.randint(1, 9)) for x in range(n) for y in range(n - 1)]
    links += [(b, a, 1) for a, b, _ in links[::5]] + [(3, 3, 99)]
    nodes = spark.range(n * n + 1)
    found = {r.id: r.group for r in simplify.partition(nodes, spark.createDataFrame(links, "u long, v long, weight long"), 4).collect()}
    assert sorted(found) == list(range(n * n + 1)) and found[n * n] == n * n
    groups = {}
    for k, grp in found.items():
        groups.setdefault(grp, set()).add(k)
    assert all(len(m) <= 4 and min(m) == k for k, m in groups.items()) and len(groups) < 45
    inside = spark.createDataFrame([(u, v) for u, v, _ in links if found[u] == found[v]], "u long, v long")
    comp = {r.node: r.component for r in connected_components(inside).collect()}
    assert all(comp.get(k, k) == grp for k, grp in found.items())
    cut = lambda of: sum(w for u, v, w in links if of(u) != of(v))
    assert cut(found.get) <= cut(lambda k: k // 4)
