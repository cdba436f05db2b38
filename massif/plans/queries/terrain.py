"""Queries of terrain patches, coverage, bounds in other systems, welds and mesh files."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import srs
from massif.operators import merge, mesh, terrain
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import V, tri
from massif.plans.registry import query, rounded
from massif.plans.shared import fresh_dir, stash
from massif.sources import files

PT = f"WITH {fx.PT}"
_M = 2 / 32 / 1024


def _at(c: str, s: str) -> str:
    return f"CAST(floor((greatest({c} {s} {_M!r}::DOUBLE, -1.0::DOUBLE) + 1) / 0.0625::DOUBLE) AS BIGINT)"


_SPAN = " , ".join(f"LATERAL (SELECT unnest(range({_at('lo_' + a, '+')}, {_at('hi_' + a, '-')} + 1)) AS {a}) l{a}" for a in "xyz")


@query("covered_cells", f"{PT}, {fx.BOX}, c AS (SELECT DISTINCT {fx.sql_morton('x', 'y', 'z', 5)} AS index FROM (SELECT label, lo_x, lo_y, lo_z, lo_x + (hi_x - lo_x) / 4 AS hi_x, lo_y + (hi_y - lo_y) / 4 AS hi_y, lo_z + (hi_z - lo_z) / 4 AS hi_z FROM bx) bb, {_SPAN}) SELECT DISTINCT CAST(5 - k AS BIGINT) AS level, index >> CAST(3 * k AS BIGINT) AS index FROM c, (SELECT unnest(range(0, 6)) AS k)")
def _(spark, sf):
    b = fx.boxes(spark, sf)
    b = b.withColumns({f"hi_{a}": F.col(f"lo_{a}") + (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / 4 for a in "xyz"})
    return terrain.covered_cells(b, fx.UNIT, 5)


_TX, _TY = "(x + 0.25::DOUBLE * sin(3 * y))", "(y * cos(x))"


@query("transformed_bounds", f"""{PT}, {fx.BOX}, s AS (SELECT label, k // 257 AS side, (k % 257) / 256.0::DOUBLE AS t, lo_x, lo_y, hi_x, hi_y FROM bx, (SELECT unnest(range(0, 1028)) AS k)),
p AS (SELECT label, CASE side WHEN 0 THEN lo_x WHEN 1 THEN hi_x ELSE lo_x + (hi_x - lo_x) * t END AS x, CASE side WHEN 2 THEN lo_y WHEN 3 THEN hi_y ELSE lo_y + (hi_y - lo_y) * t END AS y FROM s),
b AS (SELECT label, min({_TX}) AS a, min({_TY}) AS b, max({_TX}) AS c, max({_TY}) AS d FROM p GROUP BY label) SELECT label, round(a - (c - a) / 256, 6) + 0.0 AS lo_x, round(b - (d - b) / 256, 6) + 0.0 AS lo_y, round(c + (c - a) / 256, 6) + 0.0 AS hi_x, round(d + (d - b) / 256, 6) + 0.0 AS hi_y FROM b""")
def _(spark, sf):
    out = terrain.transformed_bounds(fx.boxes(spark, sf), lambda x, y: (x + 0.25 * F.sin(3 * y), y * F.cos(x)), ["label"])
    names = ["lo_x", "lo_y", "hi_x", "hi_y"]
    return out.select("label", *[c.alias(n) for c, n in zip(rounded(*map(F.col, names)), names, strict=True)])


_BB = "b AS (SELECT id, x AS lo_x, y AS lo_y, z AS lo_z, x + 0.1::DOUBLE AS hi_x, y + 0.08::DOUBLE AS hi_y, z + 0.05::DOUBLE AS hi_z FROM pt)"
_RAW = [f"degrees(atan2({y}, {x}))" for x in ("lo_x", "hi_x") for y in ("lo_y", "hi_y")]
_LON = [f"CASE WHEN lo_y < 0 AND hi_y >= 0 AND hi_x < 0 AND {v} < 0 THEN {v} + 360 ELSE {v} END" for v in _RAW]
_AXIS = "lo_x <= 0 AND hi_x >= 0 AND lo_y <= 0 AND hi_y >= 0"
_NR = {a: f"CASE WHEN lo_{a} <= 0 AND hi_{a} >= 0 THEN 0 ELSE least(abs(lo_{a}), abs(hi_{a})) END" for a in "xy"}
_FR = {a: f"greatest(abs(lo_{a}), abs(hi_{a}))" for a in "xy"}
_LAT = [f"degrees(atan2({z}, sqrt(power({r['x']}, 2) + power({r['y']}, 2))))" for z in ("lo_z", "hi_z") for r in (_NR, _FR)]
_GEO = f"g AS (SELECT id, CASE WHEN {_AXIS} THEN -180.0::DOUBLE ELSE least({', '.join(_LON)}) END AS lo_lon, CASE WHEN {_AXIS} THEN 180.0::DOUBLE ELSE greatest({', '.join(_LON)}) END AS hi_lon, least({', '.join(_LAT)}) AS lo_lat, greatest({', '.join(_LAT)}) AS hi_lat FROM b)"


def _geo(spark, sf):
    p = fx.points(spark, sf)
    b = p.select("id", *[F.col(a).alias(f"lo_{a}") for a in "xyz"], *[(F.col(a) + s).alias(f"hi_{a}") for a, s in zip("xyz", (0.1, 0.08, 0.05), strict=True)])
    return terrain.geographic_coverage(b, ["id"])


@query("geographic_coverage", f"{PT}, {_BB}, {_GEO} SELECT id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("lo_lon", "hi_lon", "lo_lat", "hi_lat")) + " FROM g")
def _(spark, sf):
    names = ["lo_lon", "hi_lon", "lo_lat", "hi_lat"]
    return _geo(spark, sf).select("id", *[c.alias(n) for c, n in zip(rounded(*map(F.col, names)), names, strict=True)])


_EDGE = "degrees(atan(sinh(pi())))"


@query("mercator_coverage", f"{PT}, {_BB}, {_GEO} SELECT id, round(lo_lon * (20037508.342789244 / 180), 3) + 0.0 AS lo_x, round(ln(tan(radians(least(greatest(hi_lat, -{_EDGE}), {_EDGE})) / 2 + pi() / 4)) * 6378137.0, 3) + 0.0 AS hi_y FROM g".replace("degrees(atan(sinh(pi())))", "85.0511287798066"))
def _(spark, sf):
    m = terrain.mercator_coverage(_geo(spark, sf), ["id"])
    return m.select("id", (F.round("lo_x", 3) + 0.0).alias("lo_x"), (F.round("hi_y", 3) + 0.0).alias("hi_y"))


_DS = "ds AS (SELECT * FROM (VALUES (0, -180.0::DOUBLE, -95.5::DOUBLE, -90.0::DOUBLE, 10.0::DOUBLE), (1, -100.0, 120.25, -35.0, 60.0), (2, 100.0, 180.0, -5.0, 90.0)) t(dataset, lo_lon, hi_lon, lo_lat, hi_lat))"


@query("native_read_windows", f"""{PT}, {_BB}, {_GEO}, {_DS}, a AS (SELECT id, hi_lon - lo_lon AS w, lo_lon + 180 - 360 * floor((lo_lon + 180) / 360) - 180 AS a, lo_lat, hi_lat FROM g),
p AS (SELECT id, CASE WHEN w >= 360 THEN -180.0::DOUBLE ELSE a END AS lo, CASE WHEN w >= 360 THEN 180.0::DOUBLE ELSE least(a + w, 180.0) END AS hi, lo_lat, hi_lat FROM a UNION ALL SELECT id, -180.0, a + w - 360, lo_lat, hi_lat FROM a WHERE w < 360 AND a + w > 180),
j AS (SELECT id, dataset, greatest(p.lo, ds.lo_lon) AS lo_lon, least(p.hi, ds.hi_lon) AS hi_lon, greatest(p.lo_lat, ds.lo_lat) AS lo_lat, least(p.hi_lat, ds.hi_lat) AS hi_lat FROM p, ds) SELECT DISTINCT id, dataset, round(lo_lon, 6) + 0.0 AS lo_lon, round(hi_lon, 6) + 0.0 AS hi_lon, round(lo_lat, 6) + 0.0 AS lo_lat, round(hi_lat, 6) + 0.0 AS hi_lat FROM j WHERE lo_lon < hi_lon AND lo_lat < hi_lat""")
def _(spark, sf):
    ds = spark.createDataFrame([(0, -180.0, -95.5, -90.0, 10.0), (1, -100.0, 120.25, -35.0, 60.0), (2, 100.0, 180.0, -5.0, 90.0)], "dataset int, lo_lon double, hi_lon double, lo_lat double, hi_lat double")
    names = ["lo_lon", "hi_lon", "lo_lat", "hi_lat"]
    w = terrain.read_windows(_geo(spark, sf), ds)
    return w.select("id", "dataset", *[c.alias(n) for c, n in zip(rounded(*map(F.col, names)), names, strict=True)])


PX = f"WITH {fx.GROWN_PX}"
# Windows of 17 by 17 pixels at every 16; bounds leave out what lies beyond the centres of their border pixels, and heights over 300.
_QUADS = f"""{PX}, ok AS (SELECT px, py, v FROM px WHERE valid), q AS (SELECT x, y, count(*) AS n, max(v) AS top, sum(v) AS total FROM (SELECT px - dx AS x, py - dy AS y, v FROM ok, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) o(dx, dy)) WHERE x BETWEEN 0 AND 254 AND y >= 0 GROUP BY x, y HAVING count(*) >= 3)"""


def _patches(spark, sf):
    p = fx.grown_pixels(spark, sf)
    w = p.select(F.floor(F.col("px") / 16).cast("long").alias("i"), F.floor(F.col("py") / 16).cast("long").alias("j")).distinct()
    w = w.select((F.col("j") * 16 + F.col("i")).alias("id"), (F.col("i") * 16).alias("px0"), (F.col("j") * 16).alias("py0"), (F.col("i") * 16 + 17).alias("px1"), (F.col("j") * 16 + 17).alias("py1"))
    b = {"lo_x": F.col("px0") * 2.0, "hi_x": (F.col("px0") + 17) * 2.0, "lo_y": F.col("py0") * 3.0, "hi_y": (F.col("py0") + 17) * 3.0, "lo_z": F.lit(-1.0), "hi_z": F.lit(1e9)}
    return terrain.build_patches(p, w.withColumns(b), (0.0, 2.0, 0.0, 0.0, 0.0, 3.0), lambda x, y, v: (x, y, v))


@query("terrain_patches", f"{_QUADS} SELECT CAST(y // 16 * 16 + x // 16 AS BIGINT) AS id, CAST(sum(n - 2) AS BIGINT) AS triangles, round(sum((n - 2) * 3.0::DOUBLE), 6) AS area FROM q GROUP BY 1")
def _(spark, sf):
    return _patches(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"), F.round(F.sum(F.abs(g.polygon_area_2d(F.col("polygon")))), 6).alias("area"))


@query("terrain_patch_meshes", f"{_QUADS}, c AS (SELECT y // 16 * 16 + x // 16 AS id, x, y, n FROM q), v AS (SELECT DISTINCT id, ok.px, ok.py FROM c JOIN ok ON ok.px IN (x, x + 1) AND ok.py IN (y, y + 1)) SELECT CAST(id AS BIGINT) AS id, CAST(t AS BIGINT) AS triangles, n AS vertices FROM (SELECT id, sum(n - 2) AS t FROM c GROUP BY id) JOIN (SELECT id, count(*) AS n FROM v GROUP BY id) USING (id)")
def _(spark, sf):
    return terrain.patch_meshes(_patches(spark, sf))


_B_A, _B_E2 = srs.BESSEL_A, srs.BESSEL_E2
_RX, _RY, _RZ = (t * 3.141592653589793 / 180 / 3600 for t in srs.MGI_TURN)


@query("mgi_to_ecef", f"""{PT}, r AS (SELECT id, radians(13 + x * 4) AS l, radians(47.5 + y * 2) AS p, z * 1000 + 500 AS h FROM pt), n AS (SELECT *, {_B_A!r}::DOUBLE / sqrt(1 - {_B_E2!r}::DOUBLE * sin(p) * sin(p)) AS n FROM r),
e AS (SELECT id, (n + h) * cos(p) * cos(l) AS x, (n + h) * cos(p) * sin(l) AS y, (n * (1 - {_B_E2!r}::DOUBLE) + h) * sin(p) AS z FROM n)
SELECT id, round((x - y * {_RZ!r}::DOUBLE + z * {_RY!r}::DOUBLE) * 1.0000024232::DOUBLE + 577.326, 4) AS x, round((x * {_RZ!r}::DOUBLE + y - z * {_RX!r}::DOUBLE) * 1.0000024232::DOUBLE + 90.129, 4) AS y, round((y * {_RX!r}::DOUBLE - x * {_RY!r}::DOUBLE + z) * 1.0000024232::DOUBLE + 463.919, 4) AS z FROM e""")
def _(spark, sf):
    p = fx.points(spark, sf)
    at = srs.mgi_to_ecef(13 + F.col("x") * 4, 47.5 + F.col("y") * 2, F.col("z") * 1000 + 500)
    return p.select("id", *[F.round(c, 4).alias(n) for c, n in zip(at, "xyz", strict=True)])


@query("triangle_order", f"{V.replace(', ' + fx.VERTS, '')}, p AS (SELECT a, b, c, CASE WHEN a % 2 = 0 THEN a ELSE b END AS d, CASE WHEN a % 2 = 0 THEN c ELSE a END AS e, CASE WHEN a % 2 = 0 THEN b ELSE c END AS f FROM tri), q AS (SELECT *, CASE WHEN a = least(a, b, c) THEN [a, b, c] WHEN b = least(a, b, c) THEN [b, c, a] ELSE [c, a, b] END AS t, CASE WHEN d = least(d, e, f) THEN [d, e, f] WHEN e = least(d, e, f) THEN [e, f, d] ELSE [f, d, e] END AS s FROM p) SELECT a, b, c, CASE WHEN t < s THEN -1 WHEN t > s THEN 1 ELSE 0 END AS strict, CASE WHEN list_sort(t) < list_sort(s) THEN -1 WHEN list_sort(t) > list_sort(s) THEN 1 ELSE 0 END AS loose FROM q")
def _(spark, sf):
    even = F.col("a") % 2 == 0
    t, s = [F.col(k) for k in "abc"], [F.when(even, F.col(p)).otherwise(F.col(q)) for p, q in ("ab", "ca", "bc")]
    return tri(spark, sf).select("a", "b", "c", mesh.compare(t, s).alias("strict"), mesh.compare(t, s, orientation=False).alias("loose"))


# Welds


@query("weld_mapping_backwards", f"{PT}, g AS (SELECT id, id % 4 AS source, min(id) OVER (PARTITION BY floor(x * 8), floor(y * 8), floor(z * 8)) AS merged FROM pt) SELECT merged, list(id ORDER BY source, id) AS ids FROM g GROUP BY merged")
def _(spark, sf):
    p = fx.points(spark, sf).withColumn("source", F.col("id") % 4)
    m = merge.weld(p.select("id", "source", *[F.floor(F.col(a) * 8).alias(a) for a in "xyz"]), 0.0)
    return merge.mapping_sources(m, p).select("merged", F.transform("sources", lambda s: s["id"]).alias("ids"))


@query("weld_last_writer", f"{PT}, g AS (SELECT *, min(id) OVER (PARTITION BY floor(x * 8), floor(y * 8), floor(z * 8)) AS merged FROM pt) SELECT merged, max_by(x, id) AS x, max_by(y, id) AS y, max_by(z, id) AS z FROM g GROUP BY merged")
def _(spark, sf):
    p = fx.points(spark, sf)
    return merge.last_written(p.select("id", "x", "y", "z"), merge.weld_exact(p.select("id", *[F.floor(F.col(a) * 8).alias(a) for a in "xyz"])))


_PARTS = f"{V}, parts AS (SELECT a, b, c, a // 32 % 2 AS source FROM tri)"


@query("welded_parts", f"{_PARTS}, o AS (SELECT DISTINCT CASE WHEN a = least(a, b, c) THEN [a, b, c] WHEN b = least(a, b, c) THEN [b, c, a] ELSE [c, a, b] END AS t FROM parts) SELECT t[1] AS a, t[2] AS b, t[3] AS c FROM o")
def _(spark, sf):
    """The grid, cut into strips with vertices of their own and put together again."""
    t = tri(spark, sf).withColumn("source", F.floor(F.col("a") / 32) % 2)
    v = t.select("source", F.explode(F.array("a", "b", "c")).alias("vid")).distinct().join(fx.vertices(spark, sf), "vid")
    v = stash(v.select((F.col("vid") + F.col("source") * 100_000).alias("id"), "source", "x", "y", "z"), "strip-vertices")
    own = t.select(*[(F.col(k) + F.col("source") * 100_000).alias(k) for k in "abc"])
    _, out = merge.weld_meshes(v, own, 1e-6)
    back = [F.when(F.col(k) >= 100_000, F.col(k) - 100_000).otherwise(F.col(k)) for k in "abc"]
    return out.select(mesh.oriented(*back).alias("t")).select(*[F.col("t")[i].alias(k) for i, k in enumerate("abc")])


@query("weld_greedy_local")
def _(spark, sf):
    return merge.weld(fx.points(spark, sf).withColumn("source", F.col("id") % 3), 0.05, "GreedyLocal")


@query("gltf_files", f"{V}, n AS (SELECT vid // 320 AS name, x * 2 + 10 AS x, y * 3 AS y, z FROM vert) SELECT 'm' || name AS name, count(*) AS n, min(x) AS lo_x, max(y) AS hi_y, CAST(sum(z) AS DOUBLE) AS z FROM n GROUP BY 1")
def _(spark, sf):
    """Meshes of strips written as files and read back."""
    v = fx.vertices(spark, sf).withColumn("name", F.concat(F.lit("m"), F.floor(F.col("vid") / 320).cast("string")))
    v = v.select("name", "vid", (F.col("x") * 2 + 10).alias("x"), (F.col("y") * 3).alias("y"), "z")
    t = tri(spark, sf).filter("a div 320 = b div 320 and b div 320 = c div 320").withColumn("name", F.concat(F.lit("m"), F.floor(F.col("a") / 320).cast("string")))
    path = fresh_dir(spark, "gltf")
    files.write_meshes(v, t, path).collect()  # a row a mesh
    back = files.meshes(spark, f"{path}/*.gltf").filter("kind = 'vertex'").withColumn("name", F.regexp_extract("path", r"/(m\d+)\.gltf$", 1))
    return back.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo_x"), F.max("y").alias("hi_y"), F.sum("z").alias("z"))
