"""Outline simplification and atlas packing."""

import math
import random

import numpy as np
import pandas as pd

from massif.operators import outline, texture


def kept(spark, rings, tolerance):
    rows = [("m", 0, k, i, float(x), float(y)) for k, r in enumerate(rings) for i, (x, y) in enumerate(r)]
    df = outline.simplify_outlines(spark.createDataFrame(rows, "mask string, component int, ring int, seq int, x double, y double"), tolerance)
    pdf = df.toPandas().sort_values(["ring", "seq"])
    return [list(map(tuple, g[["x", "y"]].to_numpy())) for _, g in pdf.groupby("ring")]


def crossings(rings):
    segments = [(np.array(a), np.array(b)) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)]
    turn = lambda a, b, p: np.sign((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))
    return sum(turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0 for i, (a, b) in enumerate(segments) for c, d in segments[:i])


def test_straight_edges_lose_their_inner_corners(spark):
    assert kept(spark, [[(0, 0), (1, 0), (2, 0), (4, 0), (4, 4), (2, 4), (0, 4)]], 0.0) == [[(0, 0), (4, 0), (4, 4), (0, 4)]]


def test_a_triangle_stays_and_so_does_a_shared_corner(spark):
    a, b = [(0, 0), (2, 0), (1, 0.1)], [(1, 0.1), (3, 1), (2, 2), (1.001, 0.2)]
    got = kept(spark, [a, b], 10.0)
    assert got[0] == a and (1, 0.1) in got[1] and len(got[1]) >= 3


def test_rings_stay_near_and_do_not_cross(spark):
    rng = random.Random(4)

    def ring(r, n):
        at = [(r + rng.uniform(0, 0.08), 2 * math.pi * i / n) for i in range(n)]
        return [(d * math.cos(t), d * math.sin(t)) for d, t in at]

    rings = [ring(1.0, 200), ring(0.9, 150)]
    assert crossings(rings) == 0
    got = kept(spark, rings, 0.2)
    assert crossings(got) == 0 and sum(map(len, got)) < 150
    for old, new in zip(rings, got, strict=True):
        assert all(min(outline._deviation(np.array([p]), np.array(a), np.array(b)) for a, b in zip(new, [*new[1:], new[0]], strict=True)) <= 0.2 + 1e-9 for p in old)


def test_rectangles_fit_without_overlap():
    rng = random.Random(7)
    sizes = [(rng.randint(1, 40), rng.randint(1, 30)) for _ in range(150)] + [(0, 5), (3, 0)]
    places, w, h = texture.pack_rectangles(sizes)
    seen = np.zeros((h, w), int)
    for (x, y), (a, b) in zip(places, sizes, strict=True):
        seen[y : y + b, x : x + a] += 1
    assert seen.max() == 1 and seen.sum() == sum(a * b for a, b in sizes) and seen.mean() > 0.8
    assert texture.pack_rectangles([]) == ([], 0, 0) and texture.pack_rectangles([(0, 0)]) == ([(0, 0)], 0, 0)


def test_atlas_of_each_node(spark):
    df = spark.createDataFrame(pd.DataFrame({"node": [1, 1, 2], "id": [1, 2, 3], "w": [4, 4, 7], "h": [2, 2, 3], "x": [9, 9, 9]}))
    got = {r.id: r for r in texture.square_plan(df, "node", "id").collect()}
    assert (got[3].x, got[3].y, got[3].atlas_w, got[3].atlas_h) == (0, 0, 7, 3)
    assert (got[1].atlas_w, got[1].atlas_h) == (4, 4) and {got[1].y, got[2].y} == {0, 2}
