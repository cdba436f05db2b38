"""Errors, stopping, images, welds, scene transforms and stores of rasters on small cases."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif import errors
from massif.functions import images, octree, predictor, texts
from massif.operators import build, lod, merge, raster
from massif.plans.control import StopSignal, progress
from massif.sources import files, raster_store, store


def test_errors_keep_their_kind():
    e = errors.propagate(errors.NotFound("x"), "reading")
    assert isinstance(e, errors.NotFound) and isinstance(e, FileNotFoundError) and str(e) == "reading: x"
    assert errors.propagate(OSError("disk"), "writing").code == "Io" and errors.propagate(KeyError("k"), "looking").code == "Internal"
    assert len(errors.CODES) == 9


def test_builds_stop_between_levels_and_go_on(spark, tmp_path):
    rows = [(2, i, *[float(v) for v in np.random.default_rng(i).random(9)]) for i in range(64)]
    t = spark.createDataFrame(rows, "level long, index long, " + ", ".join(f"{k}{p} double" for k in "abc" for p in "xyz"))
    stop, space = StopSignal(), octree.Space(0.0, 1.0)
    stop.request()
    with pytest.raises(errors.Cancelled):
        build.build_levels(t, space, 2, 0, path=str(tmp_path / "b"), stop=stop)
    build.build_levels(t, space, 2, 1, path=str(tmp_path / "b"))
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "b").rglob("*.parquet")}
    whole = build.build_levels(t, space, 2, 0, path=str(tmp_path / "b")).groupBy("level").agg(F.sum("n")).collect()
    assert len(whole) == 3 and all(p.stat().st_mtime_ns == m for p, m in before.items())
    assert set(progress(spark)) == {"done", "running", "all"}
    moved = t.withColumns({f"{k}z": F.col(f"{k}z") + 2 for k in "abc"})
    assert build.build_levels(moved, space, 2, 1, path=str(tmp_path / "b")).agg(F.min("lo_z")).first()[0] >= 2  # other inputs, other levels
    other = build.build_levels(moved, space, 2, 1, size=1, path=str(tmp_path / "b")).filter("level = 2")
    assert other.agg(F.max("n")).first()[0] == 1  # and another way to build them


def test_png_filters_are_undone():
    rng = np.random.default_rng(2)
    for bands in (1, 2, 3, 4):
        image = rng.integers(0, 256, (9, 7, bands), np.uint8)
        assert (images.decode_png(images.encode_png(image)) == image).all()
    image = rng.integers(0, 256, (5, 6, 3), np.uint8).astype(int)
    raw = b""
    for y in range(5):  # each row with another filter, by the definition
        left = np.concatenate([np.zeros((1, 3), int), image[y, :-1]])
        up = image[y - 1] if y else np.zeros((6, 3), int)
        corner = np.concatenate([np.zeros((1, 3), int), up[:-1]])
        guess = left + up - corner
        d = np.abs(np.stack([guess - left, guess - up, guess - corner]))
        paeth = np.choose(d.argmin(axis=0), [left, up, corner])
        raw += bytes([y]) + ((image[y] - [0 * left, left, up, (left + up) // 2, paeth][y]) % 256).astype(np.uint8).tobytes()
    head = struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = images.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)[:20]) + chunk(b"IDAT", zlib.compress(raw)[20:]) + chunk(b"IEND", b"")
    assert (images.decode_png(data) == image).all()
    with pytest.raises(errors.CorruptData):
        images.decode_png(data[:-20] + b"\x00" + data[-19:])
    with pytest.raises(errors.Unsupported):
        images.decode_png(b"\xff\xd8 jpeg")


def test_predicted_floats_come_back():
    row = np.array([0.0, -1.5, np.inf, np.nan, 1e-40, 3.25], "f4")
    assert predictor.gather(predictor.spread(row)).tobytes() == row.tobytes() and predictor.spread(np.array([1.0, 1.0], "f4")) == bytes([0x3F, 0, 0x41, 0, 0x80, 0, 0, 0])
    with pytest.raises(ValueError, match="exceed"):
        predictor.expand(predictor.compress(b"x" * 100), 99)


def plain_multipartite(rows, eps):
    at = {i: np.array(p) for i, _, *p in rows}
    src = {i: s for i, s, *_ in rows}
    pairs = sorted((((at[i] - at[j]) ** 2).sum(), i, j) for i in at for j in at if i < j and src[i] != src[j] and ((at[i] - at[j]) ** 2).sum() <= eps * eps)
    group = {i: {i} for i in at}
    for _, i, j in pairs:
        if group[i] is not group[j] and not {src[k] for k in group[i]} & {src[k] for k in group[j]}:
            both = group[i] | group[j]
            for k in both:
                group[k] = both
    return {i: min(g) for i, g in group.items()}


def plain_greedy(rows, eps):
    at = {i: np.array(p) for i, _, *p in rows}
    src, merged = {i: s for i, s, *_ in rows}, {}
    for i in sorted(at):
        if i in merged:
            continue
        merged[i] = i
        near = sorted((((at[j] - at[i]) ** 2).sum(), j) for j in at if j not in merged and src[j] != src[i] and ((at[j] - at[i]) ** 2).sum() <= eps * eps)
        taken = set()
        for _, j in near:
            if src[j] not in taken:
                taken.add(src[j])
                merged[j] = i
    return merged


def test_welds_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 3)), *map(float, rng.random(3) * [0.5, 0.5, 0.1])) for i in range(160)]
    p = spark.createDataFrame(rows, "id long, source long, x double, y double, z double")
    for mode, plain in (("MultipartiteNearest", plain_multipartite), ("GreedyLocal", plain_greedy)):
        assert {r.id: r.merged for r in merge.weld(p, 0.06, mode).collect()} == plain(rows, 0.06), mode
    assert merge.weld_mode("MultipartiteNearest", 0.1, 65) == "GreedyLocal" and merge.weld_mode("MultipartiteNearest", 0.1, 2, within=True) == "ConnectedComponents"
    assert merge.weld_mode("GreedyLocal", 0.0, 2) == "ExactHashBased" and merge.weld_mode("ExactHashBased", 0.1, 2) == "GreedyLocal"


def test_meshes_are_placed_by_their_nodes():
    at, tri = np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]), np.array([[0, 1, 2]])
    half = 2**-0.5
    turned = files.gltf_of(at, tri, {"translation": [10, 0, 0], "rotation": [0, 0, half, half], "scale": [2, 2, 2]})
    doc = json.loads(turned)
    doc["nodes"] = [doc["nodes"][0], {"children": [0], "matrix": [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 5, 0, 1]}, {"mesh": 0}]
    found = files.parse_gltf(json.dumps(doc).encode())
    assert np.allclose(found[1][0], np.array([[10, 2, 0], [8, 0, 0], [10, 0, 2]]) + [0, 5, 0], atol=1e-6) and np.allclose(found[0][0], at)


def test_raster_stores_are_not_made_of_what_other_inputs_left(spark, tmp_path):
    pixels = spark.range(100).select((F.col("id") % 10).alias("px"), F.floor(F.col("id") / 10).alias("py"), F.lit(1).cast("long").alias("v"))
    final, o = str(tmp_path / "store"), raster_store.Options(tile=8, subtile=4, zoom=1)
    attempt = raster_store.create(spark, final, o)
    raster_store.write_level(pixels, attempt, o, 1)
    store.write_record(spark, attempt, raster_store.inputs(pixels, o))
    raster_store.write_level(pixels, store.create_attempt(final), o, 1)  # without manifest or record
    raster_store.build(pixels.withColumn("v", F.lit(2).cast("long")), final, o)
    assert [r.v for r in raster_store.read_level(spark, final, o, 1).select("v").distinct().collect()] == [2] and store.attempts(spark, final) == []
    same = raster_store.inputs(pixels.repartition(3), o)
    assert same == raster_store.inputs(pixels, o) and same != raster_store.inputs(pixels.union(pixels.limit(1)), o)


def test_raster_stores_check_hashes_and_resume(spark, tmp_path):
    pixels = spark.range(400).select((F.col("id") % 20).alias("px"), F.floor(F.col("id") / 20).alias("py"), (F.col("id") * 7 % 50).alias("v"))
    final, o = str(tmp_path / "store"), raster_store.Options(tile=8, subtile=4, zoom=1)
    attempt = raster_store.create(spark, final, o)
    raster_store.write_level(pixels, attempt, o, 1)
    store.write_record(spark, attempt, raster_store.inputs(pixels, o))
    made = spark.read.parquet(f"{attempt}/index/zoom=1").inputFiles()
    raster_store.build(pixels, final, o)  # the stored level is used again
    assert [f.rsplit("/", 1)[1] for f in spark.read.parquet(f"{final}/index/zoom=1").inputFiles()] == [f.rsplit("/", 1)[1] for f in made]
    assert raster_store.read_level(spark, final, o, 1).count() == 400 and raster_store.read_level(spark, final, o, 0).count() == 100
    assert raster_store.read_region(spark, final, 1, 7, 3, 9, 5).count() == 4 and store.attempts(spark, final) == []
    assert raster_store.read_tile(spark, final, 1, 0, 0).count() == 64
    with pytest.raises(errors.CorruptData):
        raster_store.read_tile(spark, final, 1, 0, 0, expected=5)
    with pytest.raises(errors.NotFound):
        raster_store.read_tile(spark, final, 1, 9, 9)
    with pytest.raises(errors.AlreadyExists):
        raster_store.build(pixels, final, o)
    plan = raster_store.read_region(spark, final, 1, 7, 3, 9, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(tx" in plan


def test_byte_ranges_read_no_more(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(bytes(range(100)))
    got = files.byte_range(spark, str(tmp_path / "f.bin"), 10, 5).first()
    assert bytes(got.bytes) == bytes(range(10, 15)) and bytes(files.byte_range(spark, str(tmp_path / "f.bin"), 98, 5).first().bytes) == bytes([98, 99])


def test_pixel_types_and_windows():
    assert raster.pixel_type("float32") == "float32" and raster.pixel_type("uint8", 3) == "vec3<uint8>"
    with pytest.raises(ValueError):
        raster.pixel_type("complex", 2)
    assert raster.source_window(0, 3, 2, 3, 32) == (0, 28) and raster.source_window(4, 4, 0, 3, 32) == (4, 8)


def test_ranges_with_open_ends(spark):
    a, b = texts.span(None, F.lit(5)), texts.inclusive(F.lit(4), F.lit((1 << 63) - 1))
    r = spark.range(1).select(texts.span_intersection(a, b).alias("i"), texts.in_span(b, F.lit((1 << 63) - 1)).alias("top"), texts.spans_overlap(a, texts.span(F.lit(5), None)).alias("touch")).first()
    assert (r.i.lo, r.i.hi, r.top, r.touch) == (4, 5, True, False)


def test_pyramids_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(4)
    points = {i: tuple(map(float, rng.random(3) * 12)) for i in range(90)}
    faces = {tuple(map(int, rng.choice(90, 3, replace=False))) for _ in range(200)}
    v = spark.createDataFrame([(i, *p) for i, p in points.items()], "vid long, x double, y double, z double")
    t = spark.createDataFrame(sorted(faces), "a long, b long, c long")
    want = [len(faces)]
    for cell in (1.0, 2.0, 4.0):
        cells = {}
        for i, p in points.items():
            cells.setdefault(tuple(int(x // cell) for x in p), []).append(i)
        new = {i: min(m) for m in cells.values() for i in m}
        faces = {tuple(f[k:] + f[:k]) for q in faces for f in [tuple(new[i] for i in q)] if len(set(f)) == 3 for k in [f.index(min(f))]}
        points = {min(m): tuple(np.mean([points[i] for i in m], axis=0)) for m in cells.values()}
        want.append(len(faces))
    got = {r.level: r.triangles for r in lod.pyramid(t, v, 1.0, 4).collect()}
    assert [got[k] for k in range(4)] == want and want[-1] > 0
