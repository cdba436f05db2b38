"""Baking of textures against plain loops over texels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.operators import bake

TARGET = "tid long, " + ", ".join(f"{k}{p} double" for k in "abc" for p in "xyz") + ", " + ", ".join(f"{x}{i} double" for i in range(3) for x in "uv")


def weights(t, p):
    (ax, ay), (bx, by), (cx, cy) = t
    whole = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    if not whole:
        return None
    u = ((cx - bx) * (p[1] - by) - (cy - by) * (p[0] - bx)) / whole
    v = ((ax - cx) * (p[1] - cy) - (ay - cy) * (p[0] - cx)) / whole
    return u, v, 1 - u - v


@pytest.mark.parametrize("seed", [1, 2])
def test_texels_are_those_with_centres_inside(spark, seed):
    rng = random.Random(seed)
    uv = [[(rng.uniform(0, 12), rng.uniform(0, 12)) for _ in range(3)] for _ in range(30)] + [[(0.5, 0.5), (4.5, 0.5), (0.5, 4.5)], [(1, 1), (2, 2), (3, 3)], [(0.5, 0.5)] * 3]
    rows = [(k, *[0.0] * 9, *[float(x) for p in t for x in p]) for k, t in enumerate(uv)]
    got = {(r.tid, r.tx, r.ty): (r.w0, r.w1, r.w2) for r in bake.rasterise(spark.createDataFrame(rows, TARGET)).collect()}
    want = {(k, x, y): w for k, t in enumerate(uv) for x in range(-1, 13) for y in range(-1, 13) for w in [weights(t, (x + 0.5, y + 0.5))] if w and min(w) >= -1e-12}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 100


def nearest(p, a, b, c):
    """Distance of a point to a triangle and the weights of its foot, by a fine search of the triangle's own plane."""
    n = np.cross(b - a, c - a)
    u, v = n @ np.cross(c - b, p - b) / (n @ n), n @ np.cross(a - c, p - c) / (n @ n)
    w = np.array([u, v, 1 - u - v])
    if w.min() >= 0:
        return abs((p - a) @ n) / math.sqrt(n @ n), w
    far = []
    for q, r in ((a, b), (b, c), (c, a)):
        t = min(1.0, max(0.0, (p - q) @ (r - q) / ((r - q) @ (r - q))))
        far.append(np.linalg.norm(p - q - t * (r - q)))
    w = np.maximum(w, 0)
    return min(far), w / w.sum()


@pytest.mark.parametrize("smooth", [False, True])
def test_colours_are_those_of_the_nearest_surface(spark, smooth):
    rng = random.Random(7)
    height = lambda x, y: 0.3 * math.sin(x) + 0.2 * y
    target = []
    for k, t in enumerate([[(0, 0), (4, 0), (4, 4)], [(4, 4), (0, 4), (0, 0)]]):
        target.append((k, *[float(v) for x, y in t for v in (x, y, height(x, y))], *[2.0 * v for p in t for v in p]))
    source = []
    for x in range(4):
        for y in range(4):
            for j, t in enumerate([[(x, y), (x + 1, y), (x + 1, y + 1)], [(x + 1, y + 1), (x, y + 1), (x, y)]]):
                source.append((2 * (y * 4 + x) + j, x % 2, *[float(v) for a, b in t for v in (a, b, height(a, b))], *[3.0 * v for p in t for v in p]))
    pixels = {(i, x, y): rng.randint(0, 255) for i in range(2) for x in range(12) for y in range(12) if rng.random() < 0.9}
    images = spark.createDataFrame([(*k, v) for k, v in pixels.items()], "image int, x long, y long, value long")
    made = bake.bake(
        spark.createDataFrame(target, TARGET), spark.createDataFrame(source, TARGET.replace("tid long", "sid long, image int")),
        spark.createDataFrame([(t[0], s[0]) for t in target for s in source] + [(0, 0)], "tid long, sid long"), images, smooth=smooth,
    )
    got = {(r.tx, r.ty): (r.tid, r.value) for r in made.collect()}
    want = {}
    for x in range(8):
        for y in range(8):
            hits = [(t, w) for t in target for w in [weights([t[10 + 2 * i : 12 + 2 * i] for i in range(3)], (x + 0.5, y + 0.5))] if min(w) >= -1e-12]
            t, w = hits[0]
            p = sum(w[i] * np.array(t[1 + 3 * i : 4 + 3 * i]) for i in range(3))
            far, _, s, sw = min((round(d, 9), s[0], s, tuple(sw)) for s in source for d, sw in [nearest(p, *[np.array(s[2 + 3 * i : 5 + 3 * i]) for i in range(3)])])
            su, sv = (sum(sw[i] * s[11 + 2 * i + j] for i in range(3)) for j in range(2))
            if smooth:
                fx, fy = math.floor(su - 0.5), math.floor(sv - 0.5)
                taps = [(pixels.get((s[1], fx + dx, fy + dy)), (abs(1 - dx - (su - 0.5 - fx))) * abs(1 - dy - (sv - 0.5 - fy))) for dx in (0, 1) for dy in (0, 1)]
                size = sum(q for v, q in taps if v is not None)
                value = sum(v * q for v, q in taps if v is not None) / size if size else None
            else:
                value = pixels.get((s[1], math.floor(su), math.floor(sv)))
            want[x, y] = (t[0], value)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] for k in want)
    assert all((got[k][1] is None) == (want[k][1] is None) and (got[k][1] is None or got[k][1] == pytest.approx(want[k][1], abs=1e-5)) for k in want)


def test_empty_tables_bake_nothing(spark):
    t = spark.createDataFrame([], TARGET)
    made = bake.bake(t, t.withColumnRenamed("tid", "sid").withColumn("image", F.lit(0)), spark.createDataFrame([], "tid long, sid long"), spark.createDataFrame([], "image int, x long, y long, value long"))
    assert made.count() == 0
