"""Literal fixtures and consistency checks of the reference operators."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.functions import octree, quadtree, texts
from massif.operators import index, merge, mesh, raster, spatial
from massif.operators.components import connected_components
from massif.sources import files, store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_morton_extremes(spark):
    m = 2**21 - 1
    d = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (m, m, m), (m, 0, 5)], "x long, y long, z long")
    d = d.withColumn("i", octree.encode(F.col("x"), F.col("y"), F.col("z")))
    assert [r.i for r in d.collect()][:5] == [0, 1, 2, 4, 2**63 - 1]
    back = d.select("x", "y", "z", *[c.alias(f"{n}2") for c, n in zip(octree.decode(F.col("i")), "xyz", strict=True)]).collect()
    assert all(r[:3] == r[3:] for r in map(tuple, back))


def test_keys_at_the_root_and_borders(spark):
    d = spark.createDataFrame([(0, 0), (1, 7), (21, 2**63 - 1)], "level long, index long")
    lv, ix = F.col("level"), F.col("index")
    got = d.select(octree.parent(lv, ix)[1].alias("p"), octree.following(lv, ix).alias("n"), octree.valid(lv, ix).alias("ok"), F.size(octree.neighbours(lv, ix)).alias("k"), octree.is_ancestor(lv, ix, lv, ix, True).alias("self")).collect()
    assert [r.p for r in got] == [None, 0, 2**60 - 1]
    assert [r.n for r in got] == [None, None, None]
    assert all(r.ok and r.self for r in got)
    assert [r.k for r in got] == [0, 7, 7]


def test_cells_are_half_open(spark):
    s = octree.Space(-1.0, 2.0)
    d = spark.createDataFrame([(-1.0,), (0.0,), (0.999,), (1.0,), (None,)], "p double")
    got = [r[0] for r in d.select(octree.cell_of(s, F.lit(1), F.col("p"), F.col("p"), F.col("p"))).collect()]
    assert got == [0, 7, 7, None, None]


def test_box_cover_outside_is_empty_unless_clipped(spark):
    s = octree.Space(0.0, 8.0)
    lo, hi = [F.lit(x) for x in (6.5, 0.0, 0.0)], [F.lit(x) for x in (9.0, 1.0, 1.0)]
    d = spark.range(1).select(octree.box_cover(s, F.lit(3), lo, hi).alias("a"), octree.box_cover(s, F.lit(3), lo, hi, clip=True).alias("b")).first()
    assert d.a == [] and len(d.b) == 2


def test_morton_ranges_cover_the_box():
    s = octree.Space(0.0, 16.0)
    ranges = octree.morton_ranges(s, 4, (3.0, 3.0, 3.0), (6.0, 5.0, 9.0))
    for x in range(3, 6):
        for z in range(3, 9):
            i = sum(((x >> b & 1) << 3 * b) | ((4 >> b & 1) << 3 * b + 1) | ((z >> b & 1) << 3 * b + 2) for b in range(4))
            assert any(a <= i <= b for a, b in ranges)


def test_paths_round_trip(spark):
    d = spark.createDataFrame([("5-12",), ("x-1",), ("5-",)], "p string").select(*quadtree.parse_flat(F.col("p")))
    assert [tuple(r) for r in d.collect()] == [(5, 12), (None, None), (None, None)]
    t = spark.createDataFrame([("42",), ("-7",), ("4x",), ("",), (None,), ("9" * 30,)], "p string").select(texts.strict_integer(F.col("p")))
    assert [r[0] for r in t.collect()] == [42, -7, None, None, None, None]


def test_index_add_remove_and_rules(spark):
    leaf = spark.createDataFrame([(2, 0), (2, 9)], "level long, index long")
    ix = index.closure(leaf)
    assert rows(ix) == [(0, 0, "Virtual"), (1, 0, "Virtual"), (1, 1, "Virtual"), (2, 0, "Leaf"), (2, 9, "Leaf")]
    assert index.violations(ix).count() == 0
    more = index.add(ix, spark.createDataFrame([(1, 0)], "level long, index long"))
    assert (1, 0, "Inner") in rows(more)
    less = index.remove(more, spark.createDataFrame([(2, 0)], "level long, index long"))
    assert (1, 0, "Leaf") in rows(less) and less.count() == 4
    assert index.closure(leaf.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(20, 30)] + [(5, 5), (None, 3)]
    random.Random(1).shuffle(links)
    got = dict(rows(connected_components(spark.createDataFrame(links, "u long, v long"))))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[k] == 7 for k in range(20, 30)) and got[5] == 5 and 3 not in got


def test_median_and_mode_ties(spark):
    d = spark.createDataFrame([(0, 0, -3), (1, 0, -2), (0, 1, 7), (1, 1, -9)], "px long, py long, v long")
    assert rows(raster.halve(d, v=raster.reduce_median)) == [(0, 0, -3)]
    t = spark.createDataFrame([(0, 0, 4), (1, 0, 2), (0, 1, 2), (1, 1, 4)], "px long, py long, v long")
    assert rows(raster.mode_of_block(t, "v").select("px", "py", "v")) == [(0, 0, 4)]
    with pytest.raises(ValueError):
        raster.require_divisible(6, 4, 2)


def test_kernels_are_normalised():
    assert abs(sum(raster.gaussian_kernel(7)) - 1) < 1e-12
    assert abs(sum(raster.lanczos_down_kernel(3)) - 1) < 1e-12 and len(raster.lanczos_down_kernel(3)) == 12
    assert all(abs(sum(w for _, w in t) - 1) < 1e-12 for r in (0, 1, 2, 3) for t in raster.upscale_taps(4, r))


def test_clamped_filter_matches_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, (5, 7)).astype(float)
    d = spark.createDataFrame([(x, y, float(a[y, x])) for y in range(5) for x in range(7)], "px long, py long, v double")
    got = raster.separable(d, [(-2, 0.5), (0, 1.0), (1, 0.25)], 7, 5)

    def at(m, axis):
        n = m.shape[axis]
        return sum(w * np.take(m, np.clip(np.arange(n) + o, 0, n - 1), axis) for o, w in ((-2, 0.5), (0, 1.0), (1, 0.25)))

    want = at(at(a, 1), 0)
    assert all(abs(want[r.py, r.px] - r.v) < 1e-9 for r in got.collect())


def test_upscaled_window_is_a_crop(spark):
    d = spark.createDataFrame([(x, 0, float(x * x)) for x in range(6)], "px long, py long, v double")
    up = {r.px: r.v for r in raster.upscale(d, 2, 1, 6, 1).filter("py = 0").collect()}
    assert up[0] == 0 and up[3] == 1 + 0.25 * 3 and len(up) == 12


def test_meshify_cases(spark):
    for missing, n in (((), 2), ((0,), 1), ((1,), 1), ((2,), 1), ((3,), 1), ((0, 1), 0)):
        at = [(0, 0), (1, 0), (1, 1), (0, 1)]
        d = spark.createDataFrame([(*p, i not in missing) for i, p in enumerate(at)], "px long, py long, valid boolean")
        assert mesh.meshify(d, 2).count() == n


def test_closed_mesh_is_a_sphere(spark):
    t = spark.createDataFrame([(0, 1, 2), (0, 3, 1), (1, 3, 2), (2, 3, 0)], "a long, b long, c long")
    v = spark.createDataFrame([(i, float(i), 0.0, 1.0) for i in range(5)], "vid long, x double, y double, z double")
    assert mesh.boundary_edges(t).count() == 0 and mesh.inconsistent_edges(t).count() == 0
    assert rows(mesh.isolated(v, t).select("vid")) == [(4,)]
    assert rows(mesh.components(v, t)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)]
    assert {r.fans for r in mesh.fans(t).collect()} == {1}
    bow = spark.createDataFrame([(0, 1, 2), (0, 3, 4)], "a long, b long, c long")
    assert dict(rows(mesh.fans(bow)))[0] == 2


def test_epsilon_is_inclusive_and_uncapped(spark):
    p = spark.createDataFrame([(i, 0.0, 0.0, float(z)) for i, z in enumerate([0, 0.5, 1, 1.5])] + [(9, None, 0.0, 0.0)], "id long, x double, y double, z double")
    got = rows(spatial.epsilon_join(p, p, 0.5).filter("id < r_id").select("id", "r_id"))
    assert got == [(0, 1), (1, 2), (2, 3)]


def test_multipartite_weld_keeps_sources_apart(spark):
    d = spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.1), (2, 0, 0.15), (3, 1, 5.0)], "id long, source long, x double").withColumns({"y": F.lit(0.0), "z": F.lit(0.0)})
    assert dict(rows(merge.weld_multipartite(d, 0.2))) == {0: 0, 1: 1, 2: 1, 3: 3}


def test_snapshot_is_published_once(spark, tmp_path):
    d = spark.createDataFrame([(1, 2, 3)], "level long, index long, n long")
    final = str(tmp_path / "out")
    a, b = store.create_attempt(final), store.create_attempt(final)
    store.save_nodes(d, a)
    store.write_record(spark, a, {"eps": 1})
    store.save_nodes(d, b)
    assert len(store.attempts(spark, final)) == 2
    store.publish(spark, a, final)
    assert store.attempts(spark, final) == [] and store.matches_record(spark, final, {"eps": 1}) and not store.matches_record(spark, final, {"eps": 2})
    with pytest.raises(store.AlreadyExists):
        store.publish(spark, b, final)
    with pytest.raises(store.AlreadyExists):
        store.save_nodes(d.union(d), store.create_attempt(final))


def test_attribution_rules(spark):
    for bad in ("[]", "{}", '[{"spatial_resolution": "1"}]'):
        with pytest.raises(store.InvalidData):
            store.parse_attribution(spark, bad)


def test_gltf_round_trip(spark, tmp_path):
    at, tri = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]]), np.array([[0, 1, 2]])
    text = files.gltf_of(at, tri)
    (tmp_path / "m.gltf").write_bytes(text)
    got = files.meshes(spark, str(tmp_path))
    assert got.filter("kind = 'vertex'").count() == 3 and rows(got.filter("kind = 'triangle'").select("a", "b", "c")) == [(0, 1, 2)]
    body = text + b" " * (-len(text) % 4)
    glb = b"glTF" + struct.pack("<II", 2, 20 + len(body)) + struct.pack("<I", len(body)) + b"JSON" + body
    assert (files.parse_gltf(glb)[0][0] == at).all()


def test_tiles_by_path(spark, tmp_path):
    for z, x, y in ((1, 0, 1), (2, 3, 1)):
        (tmp_path / f"{z}/{x}").mkdir(parents=True)
        (tmp_path / f"{z}/{x}/{y}.jpeg").write_bytes(b"img")
    (tmp_path / "readme.txt").write_text("no tile")
    assert rows(files.zoom_range(files.tile_files(spark, str(tmp_path)), 2, 9).select("zoom", "x", "y")) == [(2, 3, 1)]


def test_stream_reads_files_once(spark, tmp_path):
    from massif.streaming import tiles

    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    k = spark.createDataFrame([(1, 3)], "level long, index long").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    for _ in range(2):
        k.write.mode("append").parquet(src)
        tiles.append_new(tiles.arrivals(spark, src), out, cp).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
