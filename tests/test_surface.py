"""Clipping, boundary loops and breadth-first search on small meshes."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.operators import mesh, surface


def triangles(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, c long")


def loops_of(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r.loop][r.k] = (r.u, r.v)
    assert all(sorted(x) == list(range(len(x))) for x in out.values())
    return {k: [v[0] for _, v in sorted(x.items())] for k, x in out.items()}


def test_loops_part_at_a_shared_vertex(spark):
    got = loops_of(surface.boundary_loops(triangles(spark, [(0, 1, 2), (0, 3, 4)])))
    assert sorted(got.values()) == [[0, 1, 2], [0, 3, 4]]


def test_loops_around_a_hole(spark):
    quads = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    rows = [t for x, y in quads for i in [y * 4 + x] for t in ((i, i + 1, i + 5), (i + 5, i + 4, i))]
    got = loops_of(surface.boundary_loops(triangles(spark, rows)))
    assert got[(0, 1)] == [0, 1, 2, 3, 7, 11, 15, 14, 13, 12, 8, 4]
    assert sorted(map(len, got.values())) == [4, 12]


def brute_loops(rows):
    """Boundary half-edges in order, loop by loop, following the fan at each vertex."""
    he = {(t[i], t[(i + 1) % 3]): t for t in rows for i in range(3)}
    rim, out = {e for e in he if (e[1], e[0]) not in he}, set()
    for first in sorted(rim):
        loop, e = [], first
        while True:
            loop.append(e)
            u, v = e
            while (u, v) in he:  # turn around v through its fan
                w = sum(he[(u, v)]) - u - v
                if (v, w) in rim:
                    e = (v, w)
                    break
                u = w
            if e == first:
                break
        if min(loop) == first:
            out.add(tuple(loop))
    return out


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_loops_and_fans_are_brute_force_at_any_id(spark, shift):
    import random

    rng = random.Random(3)
    quads = [(x, y) for x in range(9) for y in range(9) if rng.random() < 0.6]
    rows = [tuple(k + shift for k in t) for x, y in quads for i in [y * 10 + x] for t in ((i, i + 1, i + 11), (i + 11, i + 10, i))]
    found = defaultdict(dict)
    for r in surface.boundary_loops(triangles(spark, rows)).collect():
        found[tuple(r.loop)][r.k] = (r.u, r.v)
    assert {tuple(v[k] for k in range(len(v))) for v in found.values()} == brute_loops(rows) and all(v[0] == k for k, v in found.items())
    fans = {r.vid: r.fans for r in mesh.fans(triangles(spark, rows)).collect()}
    want = {}
    for vid in {k for t in rows for k in t}:
        edges = [{k for k in t if k != vid} for t in rows if vid in t]
        n = 0
        while edges:
            n, group = n + 1, edges.pop()
            while near := [e for e in edges if e & group]:
                group = group.union(*near)
                edges = [e for e in edges if e not in near]
        want[vid] = n
    assert fans == want and max(want.values()) > 1


def test_fans_of_far_apart_ids(spark):
    got = {r.vid: r.fans for r in mesh.fans(triangles(spark, [(2**24, 2**31 - 2, 2**31 - 1), (2**61, 5, 2**24)])).collect()}
    assert got == {2**24: 2, 2**31 - 2: 1, 2**31 - 1: 1, 2**61: 1, 5: 1}


def test_a_closed_mesh_has_no_loop(spark):
    assert surface.boundary_loops(triangles(spark, [(0, 1, 2), (0, 3, 1), (1, 3, 2), (2, 3, 0)])).isEmpty()


def test_no_triangles(spark):
    none = triangles(spark, [])
    assert surface.boundary_loops(none).isEmpty()
    assert [tuple(r) for r in surface.breadth_first(none, spark.createDataFrame([(5,)], "vid long")).collect()] == [(5, 0, None)]


def test_search_reaches_its_component_only(spark):
    got = surface.breadth_first(triangles(spark, [(0, 1, 2), (1, 2, 3), (7, 8, 9)]), spark.createDataFrame([(0,), (0,)], "vid long"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 0, None), (1, 1, 0), (2, 1, 0), (3, 2, 1)]


@pytest.mark.parametrize(("planes", "area"), [([], 2.0), ([(1.0, 0.0, 0.0, 1.0)], 0.5), ([(1.0, 0.0, 0.0, 5.0)], None), (g.box_planes((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), 1.0)])
def test_clip_keeps_the_area_inside(spark, planes, area):
    row = spark.createDataFrame([(0, 1, 2, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 2.0, 0.0)], "a long, b long, c long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    cut = surface.clip_triangles(row, planes).select(F.explode(g.fan(F.col("polygon"))).alias("t"))
    total = cut.agg(F.sum(g.orient_2d(*[F.col("t")[i] for i in range(3)])) / 2).first()[0]
    assert total == area if area is None else total == pytest.approx(area)


def test_degenerate_shapes(spark):
    zero = g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    one = g.point(F.lit(3.0), F.lit(4.0), F.lit(0.0))
    r = spark.range(1).select(g.barycentric_2d(zero, one, zero, one).alias("w"), g.segment_distance(one, zero, zero).alias("d"), g.winding(zero, one, zero).alias("t")).first()
    assert r == (None, 5.0, 0)
