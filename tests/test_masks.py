"""Masks: triangulation, cutting and merging, checked by areas and by points."""

import random

import numpy as np
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree
from massif.operators import masks, merge

RINGS = [(0, 0, True, [(0.1, 0.1), (0.9, 0.15), (0.8, 0.5), (0.95, 0.9), (0.4, 0.7), (0.1, 0.95)]), (0, 1, False, [(0.2, 0.2), (0.2, 0.5), (0.5, 0.4)]), (0, 2, False, [(0.6, 0.55), (0.7, 0.6), (0.7, 0.3)]), (1, 0, True, [(0.92, 0.05), (0.99, 0.05), (0.95, 0.12)])]


def rings(spark):
    rows = [(c, r, o, i, x, y) for c, r, o, p in RINGS for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "component int, ring int, is_outer boolean, seq int, x double, y double")


def shoelace(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2


AREA = {0: sum(abs(shoelace(p)) * (1 if o else -1) for c, _, o, p in RINGS if c == 0), 1: abs(shoelace(RINGS[3][3]))}


def inside(x, y, only=None):
    out = False
    for c in {c for c, *_ in RINGS if only in (None, c)}:
        odd = False
        for k, _, _, p in RINGS:
            if k == c:
                for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
                    odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        out |= odd
    return out


def test_pieces_have_the_area_of_their_component(spark):
    pieces = masks.triangulate(merge.normal_rings(rings(spark))).collect()
    area = {c: sum(shoelace([(p.x0, p.y0), (p.x1, p.y1), (p.x2, p.y2)]) for p in pieces if p.component == c) for c in AREA}
    assert all(abs(area[c] - AREA[c]) < 1e-12 for c in AREA) and len(pieces) == 6 + 3 + 3 + 2 * 2 - 2 + 1
    rng = random.Random(1)
    for _ in range(500):
        x, y = rng.random(), rng.random()
        held = any(all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(t, t[1:] + t[:1], strict=True)) for p in pieces for t in [[(p.x0, p.y0), (p.x1, p.y1), (p.x2, p.y2)]])
        assert held == inside(x, y)


def grid(spark, n):
    t = spark.range(2 * n * n).select(F.col("id"), (F.floor(F.col("id") / 2) % n).alias("i"), F.floor(F.col("id") / (2 * n)).alias("j"), (F.col("id") % 2 == 0).alias("low"))
    def p(dx, dy):
        return g.point((F.col("i") + dx) / n, (F.col("j") + dy) / n, F.lit(0.0))
    return t.select("id", F.when(F.col("low"), F.array(p(0, 0), p(1, 0), p(1, 1))).otherwise(F.array(p(1, 1), p(0, 1), p(0, 0))).alias("polygon"))


def test_parts_inside_and_outside_make_up_every_triangle(spark):
    pieces = masks.triangulate(merge.normal_rings(rings(spark)))
    mesh = grid(spark, 9)
    area = {}
    for keep in (True, False):
        got = masks.cut(mesh, pieces, 0.11, keep_inside=keep).withColumn("area", g.polygon_area_2d(F.col("polygon"))).collect()
        for r in got:
            area.setdefault(r.id, [0.0, 0.0])[keep] += r.area
            x, y = np.mean([(p.x, p.y) for p in r.polygon], axis=0)
            assert abs(r.area) < 1e-9 or inside(x, y) == keep
    assert len(area) == 162 and all(abs(sum(a) - 1 / 162) < 1e-12 for a in area.values())
    assert abs(sum(a[1] for a in area.values()) - sum(AREA.values())) < 1e-9


def test_merged_datasets_cover_the_square_once(spark):
    space = octree.Space(0.0, 1.0)

    def dataset(level, first):
        n = 2**level
        k = spark.range(2 * n * n).select("id", (F.floor(F.col("id") / 2) % n).cast("long").alias("i"), F.floor(F.col("id") / (2 * n)).cast("long").alias("j"))
        return grid(spark, n).join(k, "id").select(F.lit(level).cast("long").alias("level"), octree.encode(F.col("i"), F.col("j"), F.lit(0).cast("long")).alias("index"), (F.col("id") + first).alias("id"), "polygon")

    for left, right in ((2, 4), (4, 2), (3, 3)):
        got = masks.merge_datasets(dataset(left, 0), dataset(right, 10_000), rings(spark), space, 0.1).withColumn("area", g.polygon_area_2d(F.col("polygon"))).collect()
        area = {s: sum(r.area for r in got if r.side == s) for s in ("left", "right")}
        assert abs(area["right"] - sum(AREA.values())) < 1e-9 and abs(area["left"] + area["right"] - 1) < 1e-9
        for r in got:
            x, y = np.mean([(p.x, p.y) for p in r.polygon], axis=0)
            assert abs(r.area) < 1e-9 or inside(x, y) == (r.side == "right")


def test_sides_are_halved_until_they_fit(spark):
    import math

    r = spark.createDataFrame([(0, 0, True, i, x, y) for i, (x, y) in enumerate([(10.0, 40.0), (20.0, 40.0), (20.0, 60.0), (10.0, 60.0)])], rings(spark).schema)
    got = masks.subdivide(r, lambda x, y: (x * F.cos(F.radians(y)), y), 0.01).orderBy("seq").collect()
    back = [(p.x / math.cos(math.radians(p.y)), p.y) for p in got]
    assert len(got) > 8 and len({p.seq for p in got}) == len(got) and {(round(x, 9), y) for x, y in back} >= {(10.0, 40.0), (20.0, 60.0)}
    for (x1, y1), (x2, y2) in zip(back, back[1:] + back[:1], strict=True):
        mx, my = (x1 + x2) / 2, (y1 + y2) / 2
        assert abs(mx * math.cos(math.radians(my)) - (x1 * math.cos(math.radians(y1)) + x2 * math.cos(math.radians(y2))) / 2) <= 0.0100001
