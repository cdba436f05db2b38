"""Steps whose work must not grow faster than their input, told from plans and counts of rows."""

import contextlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from test_additions import plain_greedy, plain_multipartite

from massif.functions import octree, regions
from massif.operators import bake, merge, shadow, spatial, terrain, welding

CORNERS = [f"{k}{p}" for k in "abc" for p in "xyz"]
UV = [f"{x}{i}" for i in range(3) for x in "uv"]


def plan(df) -> str:
    with contextlib.redirect_stdout(said := io.StringIO()):
        df.explain("simple")
    return said.getvalue()


def test_texels_meet_their_pairs_without_a_shuffle_of_the_pairs(spark):
    square = [0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 4.0, 4.0, 0.0]
    uv = [0.0, 0.0, 4.0, 0.0, 4.0, 4.0]
    kind = lambda n: f"{n} long, " + ", ".join(f"{c} double" for c in CORNERS + UV)
    targets = spark.createDataFrame([(1, *square, *uv)], kind("tid"))
    flat = [9.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0, 9.0, 0.0]  # a triangle without area, far away
    sources = spark.createDataFrame([(1, *square, *uv), (2, *flat, *uv), (3, *square, *uv)], kind("sid")).withColumn("image", F.lit(0))
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3)], "tid long, sid long")
    found = bake.nearest_source(bake.rasterise(targets), targets, sources, pairs)
    assert {(r.sid, round(r.su - r.tx, 9), round(r.sv - r.ty, 9)) for r in found.collect()} == {(1, 0.5, 0.5)} and found.count() == 10
    assert "Window" not in plan(found)  # which sorted and shuffled a row for each texel's pair


def test_stretches_of_a_side_that_one_holds_go_before_they_are_shuffled():
    side = {"px": 0.0, "py": 0.0, "qx": 8.0, "qy": 0.0}
    tall = [{"x0": -9.0, "y0": -9.0, "x1": 20.0, "y1": -9.0 - k, "x2": 4.0, "y2": 30.0 + k} for k in range(50)]  # hold it whole
    part = [{"x0": 1.0 + k, "y0": -2.0, "x1": 4.0 + k, "y1": -2.0, "x2": 2.0 + k, "y2": 9.0} for k in range(3)]
    rows = [{"by": b, **side, **t} for b, shapes in (("whole", tall + part), ("part", part)) for t in shapes]
    got = pa.Table.from_batches(shadow._stretches(["by"])(pa.Table.from_pylist(rows).to_batches())).to_pylist()
    assert [r["by"] for r in got].count("whole") == 1 and [(r["s"], r["t"]) for r in got if r["by"] == "whole"] == [(0.0, 1.0)]
    assert [r["by"] for r in got].count("part") == 3 and all(0 < r["s"] < r["t"] < 1 for r in got if r["by"] == "part")


def test_polygons_are_not_put_into_one_task_by_their_bytes(spark):
    rings = spark.createDataFrame([(k, 0, i, float(x), float(y)) for k in range(9) for i, (x, y) in enumerate(((0, 0), (1, 0), (0, 1)))], "component int, ring int, seq int, x double, y double")
    caps = shadow.cap_triangles(rings)
    assert "REPARTITION_BY_NUM" in plan(caps) and caps.count() == 9


def test_regions_of_odd_texts_without_functions_over_arrays(spark):
    texts = [None, "", "7", "1,2", "1,2,3", " 1, 2 ,3,4", "1,2,3,4,5", "1,2,3,4,5,6", "1,2,3,x,5,6", "1,2,3,4,5,6,7", "2,3,3,3", "2,4,0,0", "2,64", "-1,0", "1,1,1", "1,2,0", "99,0,0"]
    t = F.col("t")
    found = spark.createDataFrame([(x,) for x in texts], "t string").select("t", regions.bounds_of_values(t).alias("b"), regions.bounds_of_tile(t).alias("q"), regions.node_of(t).alias("n"))
    got = {r.t: r for r in found.collect()}
    inf = float("inf")
    assert {k: tuple(r.b) for k, r in got.items() if r.b} == {" 1, 2 ,3,4": (1, 3, -inf, 3, 7, inf), "1,2,3,4,5,6": (1, 3, 5, 3, 7, 11), "2,3,3,3": (2, 3, -inf, 5, 6, inf), "2,4,0,0": (2, 0, -inf, 6, 0, inf)}
    assert {k for k, r in got.items() if r.q} == {"1,1,1"}
    assert {k: tuple(r.n) for k, r in got.items() if r.n} == {"1,2": (1, 2), "2,3,3,3": (2, 63)}
    assert "transform" not in plan(found) and "forall" not in plan(found)


def test_triangles_within_their_bounds_are_not_clipped(spark):
    pixels = spark.createDataFrame([(x, y, float(x), True) for x in range(4) for y in range(2)], "px long, py long, v double, valid boolean")
    window = "id long, px0 long, py0 long, px1 long, py1 long, " + ", ".join(f"{e}_{a} double" for e in ("lo", "hi") for a in "xyz")
    windows = spark.createDataFrame([(1, 0, 0, 4, 2, -9.0, -9.0, -9.0, 9.0, 9.0, 9.0), (2, 0, 0, 4, 2, -9.0, -9.0, -9.0, 3.0, 9.0, 9.0), (3, 0, 0, 4, 2, 0.5, 0.5, 0.0, 3.5, 1.5, 3.0)], window)
    found = terrain.build_patches(pixels, windows, (0.0, 1.0, 0.0, 0.0, 0.0, 1.0), lambda x, y, v: (x, y, v))
    area = lambda p: abs(sum(a.x * b.y - b.x * a.y for a, b in zip(p, p[1:] + p[:1], strict=True))) / 2
    rows = found.collect()
    assert {k: (round(sum(area(r.polygon) for r in rows if r.id == k), 9), len([r for r in rows if r.id == k])) for k in (1, 2, 3)} == {1: (3.0, 6), 2: (2.5, 6), 3: (3.0, 6)}
    text = plan(found)
    assert "CASE WHEN" in text.split("aggregate(")[0] and "transform(t#" not in text


def test_encode_names_its_argument_few_times(spark):
    values = [0, 1, 127, 128, 16384, 2**21 - 1, 2**21 + 5, 1234567, -1, None]
    rows = [(x, values[-1 - k], 1048575 - k) for k, x in enumerate(values)]
    df = spark.createDataFrame(rows, "x long, y long, z long").select("x", "y", "z", octree.encode(F.col("x"), F.col("y"), F.col("z")).alias("k"))
    want = lambda *p: None if None in p else sum((v >> b & 1) << 3 * b + d for b in range(21) for d, v in enumerate(p))
    assert all(r.k == want(r.x, r.y, r.z) for r in df.collect())
    assert plan(df.select("k")).count("x#") < 40  # 32 times in each of its places


def strip_of_points(n, seed):
    """Points of three sources that one eps-component of 0.06 holds, over several tiles, some of them copies, and two at no place."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(rng.integers(0, 3)), *map(float, rng.random(3) * [2.0, 0.1, 0.05])) for i in rng.permutation(n)]
    return rows + [(n + k, k % 3, *rows[k % 5][2:]) for k in range(20)], [(n + 90, 0, None, 0.0, 0.0), (n + 91, 1, None, 0.0, 0.0), (n + 92, 1, float("nan"), 0.0, 0.0), (n + 93, 2, float("nan"), 0.0, 0.0)]


def welded_without_pairs(spark, monkeypatch, rows, lone, how):
    monkeypatch.setattr(spatial, "epsilon_join", None)  # which made all pairs within eps, to weld each component in one task
    p = spark.createDataFrame(rows + lone, "id long, source long, x double, y double, z double")
    got = {r.id: r.merged for r in how(p, 0.06).collect()}
    assert all(got.pop(r[0]) == r[0] for r in lone)
    return got


def test_multipartite_weld_takes_no_component_whole(spark, monkeypatch):
    rows, lone = strip_of_points(300, 3)
    assert welded_without_pairs(spark, monkeypatch, rows, lone, merge.weld_multipartite) == plain_multipartite(rows, 0.06)


def test_pairs_of_groups_that_wait_for_one_source_are_not_made():
    at, tile = np.random.default_rng(1).random((3000, 3)) * 0.01, np.zeros(3000, np.int64)
    mask = np.array([0b0111] * 2995 + [0b1000] * 5)
    with_one = lambda: sum(len(q) for q, _, _ in welding.near_pairs(at[:2995], tile[:2995], at[2995:], tile[2995:], 0.1))
    p, q, _ = welding.compatible_pairs(at, tile, mask, 0.1)
    assert len(p) == 2995 * 5 == with_one() and {int(a) for a in mask[p] | mask[q]} == {0b1111}


def test_greedy_weld_takes_no_component_whole(spark, monkeypatch):
    rows, lone = strip_of_points(300, 4)
    assert welded_without_pairs(spark, monkeypatch, rows, lone, merge.weld_greedy) == plain_greedy(rows, 0.06)


def test_a_tile_tells_only_what_holds_beyond_its_halo():
    rows, _ = strip_of_points(600, 5)
    at, source = np.array([r[2:] for r in sorted(rows)]), np.array([r[1] for r in sorted(rows)])
    want, told = plain_greedy([(i, s, *p) for i, (s, p) in enumerate(zip(source.tolist(), at.tolist(), strict=True))], 0.06), 0
    for low in (0.0, 0.5, 1.0, 1.5):
        inside = np.minimum(at[:, 0] - low, low + 0.5 - at[:, 0])
        held = np.flatnonzero(inside >= -0.1)
        pairs = welding.greedy_tile(at[held], source[held], inside[held] >= 0, inside[held] + 0.1, 0.06)
        assert {int(held[i]): int(held[j]) for i, j in pairs}.items() <= want.items()
        told += len(pairs)
    assert 0 < told < len(at)
