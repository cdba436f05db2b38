"""Queries on fixtures that grow with the tables, and on stored rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import octree, predictor, srs
from massif.operators import index, lod, mesh, raster, spatial
from massif.plans import fixtures as fx
from massif.plans.queries.rasters import HALF
from massif.plans.registry import query, rounded
from massif.plans.shared import fresh_dir, stash
from massif.sources import raster_store, store

PT, PX = f"WITH {fx.GROWN_PT}", f"WITH {fx.GROWN_PX}"
SMALL = f"WITH {fx.PX}"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_EPS = 0.01
_CELLS = ", ".join(f"CAST(floor({c} / {_EPS}) AS BIGINT) AS c{c}" for c in "xyz")


@query("grown_eps_pairs", f"""{PT}, g AS (SELECT *, {_CELLS} FROM pt), n AS (SELECT * FROM g, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k))
SELECT a.id AS u, b.id AS v FROM g a JOIN n b ON a.cx = b.cx + b.i AND a.cy = b.cy + b.j AND a.cz = b.cz + b.k WHERE a.id < b.id AND {_D2} <= {_EPS * _EPS!r}""")
def _(spark, sf):
    p = fx.grown_points(spark, sf).select("id", "x", "y", "z")
    return spatial.epsilon_join(p, p, _EPS).filter("id < r_id").select(F.col("id").alias("u"), F.col("r_id").alias("v"))


def _leaf(spark, sf, level: int, keep: str):
    p = fx.grown_points(spark, sf).filter(keep)
    return p.select(F.lit(level).cast("long").alias("level"), octree.cell_of(fx.UNIT, F.lit(level), F.col("x"), F.col("y"), F.col("z")).alias("index")).distinct()


_LEAVES = f"leaf AS (SELECT DISTINCT CAST(9 AS BIGINT) AS level, {fx.sql_cell(9)} AS index FROM pt)"


@query("grown_index", f"{PT}, {_LEAVES}, {fx.sql_closure('leaf', 'ix', 9)} SELECT level, status, count(*) AS n, CAST(bit_xor(index) AS BIGINT) AS indices FROM ix GROUP BY 1, 2")
def _(spark, sf):
    ix = index.closure(_leaf(spark, sf, 9, "true"))
    return ix.groupBy("level", "status").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("index").alias("indices"))


_STORED = f"s AS (SELECT DISTINCT CAST(3 AS BIGINT) AS level, {fx.sql_cell(3)} AS index FROM pt WHERE id % 3 = 0 UNION SELECT DISTINCT CAST(6 AS BIGINT), {fx.sql_cell(6)} FROM pt WHERE id % 5 = 0)"


@query("grown_nearest_ancestor", f"{PT}, {_LEAVES}, {_STORED} SELECT l.level, l.index, coalesce(b.level, a.level) AS found_level, coalesce(b.index, a.index) AS found_index FROM leaf l LEFT JOIN s a ON a.level = 3 AND a.index = l.index >> 18 LEFT JOIN s b ON b.level = 6 AND b.index = l.index >> 9")
def _(spark, sf):
    stored = stash(_leaf(spark, sf, 3, "id % 3 = 0").union(_leaf(spark, sf, 6, "id % 5 = 0")), "stored")
    return spatial.nearest_ancestor(_leaf(spark, sf, 9, "true"), stored)


@query("grown_raster_map", f"{PX} SELECT px, py, CASE WHEN valid THEN v * 3 + attr ELSE -1 END AS v FROM px")
def _(spark, sf):
    return raster.pixel_map(fx.grown_pixels(spark, sf), v=F.when(F.col("valid"), F.col("v") * 3 + F.col("attr")).otherwise(-1)).select("px", "py", "v")


@query("grown_reduce_max", f"{PX} SELECT CAST(px // 8 AS BIGINT) AS px, CAST(py // 8 AS BIGINT) AS py, max(v) AS v FROM px GROUP BY 1, 2")
def _(spark, sf):
    return raster.halve(fx.grown_pixels(spark, sf), 3, v=raster.reduce_max)


@query("grown_stencil", f"{PX}, o AS (SELECT unnest([-1, 0, 1]) AS d), s AS (SELECT px - x.d - 1 AS px, py - y.d - 1 AS py, v * (2 - abs(x.d)) * (2 - abs(y.d)) AS v FROM px, o x, o y) SELECT px, py, CAST(sum(v) AS DOUBLE) AS v FROM s WHERE px BETWEEN 0 AND 253 AND py >= 0 GROUP BY 1, 2 HAVING count(*) = 9")
def _(spark, sf):
    kernel = [(i + 1, j + 1, float((2 - abs(i)) * (2 - abs(j)))) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return raster.stencil(fx.grown_pixels(spark, sf), kernel, 256, 1 << 40)


_MESH = fx.MESH.replace("py * 32", "py * 256").replace("y * 32", "y * 256").replace("i + 33", "i + 257").replace("i + 32", "i + 256").replace("BETWEEN 0 AND 30 AND py - dy BETWEEN 0 AND 30", "BETWEEN 0 AND 254 AND py - dy >= 0")


def grown_mesh(spark, sf):
    return mesh.meshify(fx.grown_pixels(spark, sf), width=256).select("a", "b", "c")


@query("grown_boundary_edges", f"{PX}, {_MESH}, {fx.HALF_EDGES.replace('he AS (', 'he AS MATERIALIZED (', 1)}, net AS (SELECT least(u, v) AS p, greatest(u, v) AS q, sum(CASE WHEN u < v THEN 1 ELSE -1 END) AS n FROM he GROUP BY 1, 2) SELECT CASE WHEN n > 0 THEN p ELSE q END AS u, CASE WHEN n > 0 THEN q ELSE p END AS v FROM net WHERE n <> 0")
def _(spark, sf):
    return mesh.boundary_edges(grown_mesh(spark, sf))


@query("grown_vertex_clustering", f"""{PX}, {_MESH}, m AS (SELECT py * 256 + px AS vid, min(py * 256 + px) OVER (PARTITION BY px // 4, py // 4, v // 64) AS new FROM px WHERE valid),
q AS (SELECT a.new AS a, b.new AS b, c.new AS c FROM tri JOIN m a ON tri.a = a.vid JOIN m b ON tri.b = b.vid JOIN m c ON tri.c = c.vid)
SELECT DISTINCT t[1] AS a, t[2] AS b, t[3] AS c FROM (SELECT CASE WHEN a = least(a, b, c) THEN [a, b, c] WHEN b = least(a, b, c) THEN [b, c, a] ELSE [c, a, b] END AS t FROM q WHERE a <> b AND b <> c AND a <> c)""")
def _(spark, sf):
    v = fx.grown_pixels(spark, sf).filter("valid").select((F.col("py") * 256 + F.col("px")).alias("vid"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), (F.col("v") / 16).alias("z"))
    return lod.simplify(grown_mesh(spark, sf), v, 4.0)[1]


# Windows, validity and samples of rasters


@query("clamped_window", f"{SMALL} SELECT px, py, v FROM px WHERE px >= 0 AND px < 31 AND py >= 5 AND py < 31")
def _(spark, sf):
    return raster.clamped_window(fx.pixels(spark, sf), -4, 5, 40, 77, 32, 32).select("px", "py", "v")


@query("raster_metadata", f"{PX} SELECT min(px) AS lo_px, min(py) AS lo_py, max(px) AS hi_px, max(py) AS hi_py, min(v) FILTER (WHERE valid) AS lo_v, max(v) FILTER (WHERE valid) AS hi_v, count(*) AS pixels, count(*) FILTER (WHERE valid) AS valid_pixels FROM px")
def _(spark, sf):
    return raster.describe(fx.grown_pixels(spark, sf))


@query("band_validity", f"{PX} SELECT px, py, v % 3 > 0 AND (v % 5 = 4 OR v % 5 > 0) AND valid AS ok FROM px")
def _(spark, sf):
    p = fx.grown_pixels(spark, sf)
    masks = [F.col("v") % 3, F.when(F.col("v") % 5 != 4, F.col("v") % 5), F.when(F.col("valid"), 255).otherwise(0)]
    return p.select("px", "py", raster.all_valid(*masks).alias("ok"))


_BOX = "SELECT p_partkey AS id, p_partkey % 40 / 2.0::DOUBLE AS lo_x, p_partkey // 40 % 40 / 2.0::DOUBLE AS lo_y, p_partkey % 40 / 2.0::DOUBLE + 0.75 AS hi_x, p_partkey // 40 % 40 / 2.0::DOUBLE + 0.25 AS hi_y FROM part"


@query("empty_source_skip", f"WITH t AS ({_BOX}), s AS (SELECT * FROM t WHERE id % 11 = 0) SELECT id FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.lo_x <= t.hi_x + 0.75 * 0.05::DOUBLE AND s.hi_x >= t.lo_x - 0.75 * 0.05::DOUBLE AND s.lo_y <= t.hi_y + 0.25 * 0.05::DOUBLE AND s.hi_y >= t.lo_y - 0.25 * 0.05::DOUBLE)")
def _(spark, sf):
    k = F.col("p_partkey")
    x, y = (k % 40) / 2, (F.floor(k / 40) % 40) / 2
    t = fx.read(spark, sf, "part").select(k.alias("id"), x.alias("lo_x"), y.alias("lo_y"), (x + 0.75).alias("hi_x"), (y + 0.25).alias("hi_y"))
    return raster.not_known_empty(t, t.filter("id % 11 = 0"), 0.05).select("id")


_SX, _SY = "(px * 0.875::DOUBLE + 1.25)", "(py * 0.6875::DOUBLE + px * 0.0625::DOUBLE + 0.1875)"


@query("warp_bilinear", f"""{PX}, t AS (SELECT px, py, {_SX} AS sx, {_SY} AS sy FROM px), q AS (SELECT *, floor(sx - 0.5) AS fx, floor(sy - 0.5) AS fy FROM t),
w AS (SELECT px, py, fx + i AS x, fy + j AS y, CASE i WHEN 1 THEN sx - 0.5 - fx ELSE 1 - (sx - 0.5 - fx) END * CASE j WHEN 1 THEN sy - 0.5 - fy ELSE 1 - (sy - 0.5 - fy) END AS w FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
a AS (SELECT w.px, w.py, sum(CASE WHEN s.v IS NOT NULL THEN w END) AS w, sum(s.v * w) AS s FROM w LEFT JOIN px s ON s.px = w.x AND s.py = w.y AND s.valid GROUP BY 1, 2)
SELECT px, py, round(CASE WHEN w > 0 THEN s / w ELSE 0 END, 6) + 0.0 AS v, coalesce(w > 0, false) AS valid FROM a""")
def _(spark, sf):
    p = fx.grown_pixels(spark, sf)
    out = raster.warp(p, p.select("px", "py"), F.col("px") * 0.875 + 1.25, F.col("py") * 0.6875 + F.col("px") * 0.0625 + 0.1875)
    return out.select("px", "py", rounded(F.col("v"))[0].alias("v"), "valid")


_RAD = "(180 / 20037508.342789244)"


@query("native_resolution", f"""WITH b AS (SELECT p_partkey AS id, p_partkey * 50.0::DOUBLE AS lo_x, p_partkey * 70.0::DOUBLE AS lo_y, p_partkey * 50.0::DOUBLE + 1000 AS hi_x, p_partkey * 70.0::DOUBLE + 3000 AS hi_y FROM part),
s AS (SELECT id, lo_x + 1000 * (k % 5) / 4.0::DOUBLE AS x, lo_y + 3000 * (k // 5) / 4.0::DOUBLE AS y FROM b, (SELECT unnest(range(0, 25)) AS k)),
d AS (SELECT id, {_RAD} * 3600 + abs(degrees(atan(exp((y + 1) / 6378137.0)) * 2 - pi() / 2) - degrees(atan(exp(y / 6378137.0)) * 2 - pi() / 2)) * 3600 AS c FROM s) SELECT id, round(min(1 / c), 4) AS size FROM d GROUP BY id""")
def _(spark, sf):
    k = F.col("p_partkey")
    b = fx.read(spark, sf, "part").select(k.alias("id"), (k * 50.0).alias("lo_x"), (k * 70.0).alias("lo_y"), (k * 50.0 + 1000).alias("hi_x"), (k * 70.0 + 3000).alias("hi_y"))
    size = raster.native_pixel_size(b, lambda x, y: tuple(c * 3600 for c in srs.from_mercator(x, y)), step=1.0)
    return size.select("id", F.round("size", 4).alias("size"))


def _clamp(taps, table: str, axis: str, n: int, name: str) -> str:
    values = ", ".join(f"({d}, CAST({w!r} AS DOUBLE))" for d, w in taps)
    other = "py" if axis == "px" else "px"
    return f"k_{name}(d, b) AS (VALUES {values}), {name} AS (SELECT o.i AS {axis}, s.{other} AS {other}, sum(s.v * k.b) AS v FROM (SELECT unnest(range(0, {n})) AS i) o, k_{name} k JOIN {table} s ON s.{axis} = least(greatest(o.i + k.d, 0), {n - 1}) GROUP BY 1, 2 HAVING count(*) = {len(taps)})"


for _a in (2, 4):
    _taps = [(k - (2 * _a - 1), w) for k, w in enumerate(raster.lanczos_down_kernel(_a))]

    def _down(spark, sf, a=_a):
        out = raster.lanczos_down(fx.pixels(spark, sf), a, 32, 32)
        return out.select("px", "py", rounded(F.col("v"))[0].alias("v"))

    query(f"lanczos{_a}_down", f"{SMALL}, {_clamp(_taps, 'px', 'px', 32, 'h')}, {_clamp(_taps, 'h', 'py', 32, 'g')} SELECT {HALF}, round(v, 6) + 0.0 AS v FROM g WHERE px % 2 = 0 AND py % 2 = 0")(_down)

_NODE = [(k - 5, w) for k, w in enumerate(raster.lanczos_node_kernel(3))]


@query("lanczos3_nodes_down", f"WITH {fx.PX}, s31 AS (SELECT * FROM px WHERE px < 31 AND py < 31), {_clamp(_NODE, 's31', 'px', 31, 'h')}, {_clamp(_NODE, 'h', 'py', 31, 'g')} SELECT {HALF}, round(v, 6) + 0.0 AS v FROM g WHERE px % 2 = 0 AND py % 2 = 0")
def _(spark, sf):
    out = raster.lanczos_nodes_down(raster.window(fx.pixels(spark, sf), 0, 0, 31, 31), 3, 31, 31)
    return out.select("px", "py", rounded(F.col("v"))[0].alias("v"))


_L3 = [(k - 5, w) for k, w in enumerate(raster.lanczos_down_kernel(3))]
_TWO = ", ".join([_clamp(_L3, "px", "px", 32, "h"), _clamp(_L3, "h", "py", 32, "g"), "m1 AS (SELECT px // 2 AS px, py // 2 AS py, v FROM g WHERE px % 2 = 0 AND py % 2 = 0)", _clamp(_L3, "m1", "px", 16, "h2"), _clamp(_L3, "h2", "py", 16, "g2")])


@query("windowed_scaling", f"{SMALL}, {_TWO} SELECT {HALF}, round(v, 6) + 0.0 AS v FROM g2 WHERE px % 2 = 0 AND py % 2 = 0 AND px // 2 BETWEEN 0 AND 2 AND py // 2 BETWEEN 4 AND 7")
def _(spark, sf):
    out = raster.lanczos_window(fx.pixels(spark, sf), 3, 2, (0, 4), (3, 4), 32, 32)
    return out.select("px", "py", rounded(F.col("v"))[0].alias("v"))


@query("window_median", f"{PX}, o AS (SELECT unnest([0, 1, 2]) AS d), s AS (SELECT px - x.d AS px, py - y.d AS py, v FROM px, o x, o y) SELECT px, py, list_sort(list(v))[5] AS v FROM s WHERE px BETWEEN 0 AND 253 AND py >= 0 GROUP BY 1, 2 HAVING count(*) = 9")
def _(spark, sf):
    return raster.window_function(fx.grown_pixels(spark, sf), 3, lambda v: F.sort_array(v)[4], 256, 1 << 40)


@query("geometric_mean", f"{PX} SELECT {HALF}, round(exp(avg(ln(v + 1.0))) - 1, 6) + 0.0 AS v FROM px GROUP BY 1, 2")
def _(spark, sf):
    mean = raster.converted(F.avg, lambda v: F.log(v + 1.0), lambda v: F.exp(v) - 1)
    out = raster.halve(fx.grown_pixels(spark, sf), 1, v=mean)
    return out.select("px", "py", rounded(F.col("v"))[0].alias("v"))


@query("float_predictor", f"{PX} SELECT py, list(CAST(v AS FLOAT) / 8 ORDER BY px) AS v FROM px GROUP BY py".replace("CAST(v AS FLOAT) / 8", "CAST(v / 8.0 AS FLOAT)"))
def _(spark, sf):
    rows = raster.rows_of(fx.grown_pixels(spark, sf).withColumn("v", (F.col("v") / 8).cast("float")))
    coded = rows.select("py", predictor.encode_rows("values").alias("data"))
    return coded.select("py", predictor.decode_rows("data").alias("v"))


@query("pixel_centres", f"{PX} SELECT px, py, round(CAST(100 + (px + 0.5) * 2.5 + (py + 0.5) * 0.5 AS DOUBLE), 6) AS x, round(CAST(200 - (py + 0.5) * 2.0 AS DOUBLE), 6) + 0.0 AS y FROM px")
def _(spark, sf):
    x, y = raster.to_srs(F.col("px") + 0.5, F.col("py") + 0.5, (100.0, 2.5, 0.5, 200.0, 0.0, -2.0))
    return fx.grown_pixels(spark, sf).select("px", "py", F.round(x, 6).alias("x"), (F.round(y, 6) + 0.0).alias("y"))


# Stored rasters

_OPTIONS = raster_store.Options(tile=64, subtile=16, zoom=3)


def built(spark, sf) -> str:
    final = fresh_dir(spark, "raster-store")
    raster_store.build(fx.grown_pixels(spark, sf), final, _OPTIONS)
    return final


@query("raster_store_levels", f"{PX} " + " UNION ALL ".join(f"SELECT CAST({z} AS BIGINT) AS zoom, CAST(px // {2 ** (3 - z)} AS BIGINT) AS px, CAST(py // {2 ** (3 - z)} AS BIGINT) AS py, max(v) AS v FROM px GROUP BY ALL" for z in range(4)))
def _(spark, sf):
    at, out = built(spark, sf), None
    for z in range(4):
        level = raster_store.read_level(spark, at, _OPTIONS, z).select(F.lit(z).cast("long").alias("zoom"), "px", "py", "v")
        out = level if out is None else out.union(level)
    return out


@query("raster_store_region", f"{PX} SELECT CAST(px // 2 AS BIGINT) AS px, CAST(py // 2 AS BIGINT) AS py, max(v) AS v FROM px WHERE px // 2 BETWEEN 30 AND 99 AND py // 2 BETWEEN 5 AND 20 GROUP BY 1, 2")
def _(spark, sf):
    return raster_store.read_region(spark, built(spark, sf), 2, 30, 5, 100, 21)


@query("raster_store_tile", f"{PX} SELECT px, py, v FROM px WHERE px BETWEEN 64 AND 127 AND py < 64")
def _(spark, sf):
    return raster_store.read_tile(spark, built(spark, sf), 3, 1, 0)


@query("raster_store_index", f"{PX} " + " UNION ALL ".join(f"SELECT CAST({z} AS BIGINT) AS zoom, CAST(px // {64 * 2 ** (3 - z)} AS BIGINT) AS tx, CAST(py // {64 * 2 ** (3 - z)} AS BIGINT) AS ty, count(DISTINCT (px // {16 * 2 ** (3 - z)}, py // {16 * 2 ** (3 - z)})) AS subtiles FROM px GROUP BY ALL" for z in range(4)))
def _(spark, sf):
    return raster_store.index(spark, built(spark, sf)).select(F.col("zoom").cast("long").alias("zoom"), "tx", "ty", "subtiles")


@query("tile_children_status", f"WITH {fx.QK}, t AS (SELECT zoom - k AS zoom, x >> CAST(k AS BIGINT) AS x, y >> CAST(k AS BIGINT) AS y, max(k = 0 AND (x + y) % 9 = 0) AS pending FROM qk, (SELECT unnest(range(0, 7)) AS k) GROUP BY ALL), u AS (SELECT DISTINCT zoom - k AS zoom, x >> CAST(k AS BIGINT) AS x, y >> CAST(k AS BIGINT) AS y FROM t, (SELECT unnest(range(0, 7)) AS k) WHERE pending AND k <= zoom) SELECT t.zoom, t.x, t.y, CASE WHEN u.zoom IS NULL THEN 'complete' ELSE 'children pending' END AS status FROM t LEFT JOIN u ON t.zoom = u.zoom AND t.x = u.x AND t.y = u.y")
def _(spark, sf):
    q = fx.quad_keys(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    t = q.groupBy((F.col("zoom") - F.col("k")).alias("zoom"), *[F.call_function("shiftright", F.col(c), F.col("k")).alias(c) for c in "xy"]).agg(F.max((F.col("k") == 0) & ((F.col("x") + F.col("y")) % 9 == 0)).alias("pending"))
    return raster_store.mark_complete(t)


@query("resume_other_input", f"{PX} SELECT CAST(px // 2 AS BIGINT) AS px, CAST(py // 2 AS BIGINT) AS py, max(v) + 1 AS v FROM px GROUP BY 1, 2")
def _(spark, sf):
    """Attempts left by other pixels, and one without a manifest, aren't gone on with."""
    final, pixels = fresh_dir(spark, "raster-store"), fx.grown_pixels(spark, sf)
    attempt = raster_store.create(spark, final, _OPTIONS)
    raster_store.write_level(pixels, attempt, _OPTIONS, 3)
    store.write_record(spark, attempt, raster_store.inputs(pixels, _OPTIONS))
    raster_store.write_level(pixels, store.create_attempt(final), _OPTIONS, 3)
    raster_store.build(pixels.withColumn("v", F.col("v") + 1), final, _OPTIONS)
    return raster_store.read_level(spark, final, _OPTIONS, 2)
