"""Queries on rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import raster
from massif.plans import fixtures as fx
from massif.plans.registry import query, rounded

PX = f"WITH {fx.PX}"
HALF = "CAST(px // 2 AS BIGINT) AS px, CAST(py // 2 AS BIGINT) AS py"
_G = (10.0, 0.5, 0.0, 20.0, 0.0, -0.5)


def r6(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


def px(spark, sf):
    return fx.pixels(spark, sf)


@query("raster_map", f"{PX} SELECT px, py, v * 2 + attr AS v FROM px")
def _(spark, sf):
    return raster.pixel_map(px(spark, sf), v=F.col("v") * 2 + F.col("attr")).select("px", "py", "v")


def _third(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return li.groupBy((k % 32).cast("long").alias("px"), (F.floor(k / 32) % 32).cast("long").alias("py")).agg(F.max("l_linenumber").cast("long").alias("w"))


_W = "w3 AS (SELECT CAST(l_orderkey % 32 AS BIGINT) AS px, CAST((l_orderkey // 32) % 32 AS BIGINT) AS py, CAST(max(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2)"


@query("raster_zip2", f"{PX} SELECT px, py, v - attr AS v FROM px")
def _(spark, sf):
    p = px(spark, sf)
    return raster.zip_with(p.select("px", "py", "v"), p.select("px", "py", "attr")).select("px", "py", (F.col("v") - F.col("attr")).alias("v"))


@query("raster_zip3", f"{PX}, {_W} SELECT px.px, px.py, v + attr * w AS v FROM px JOIN w3 ON px.px = w3.px AND px.py = w3.py")
def _(spark, sf):
    p = px(spark, sf)
    return raster.zip_with(p.select("px", "py", "v"), p.select("px", "py", "attr"), _third(spark, sf)).select("px", "py", (F.col("v") + F.col("attr") * F.col("w")).alias("v"))


@query("raster_fold", f"{PX} SELECT py, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), list(v ORDER BY px)), lambda a, b: (a * 31 + b) % 1000003) AS BIGINT) AS h FROM px GROUP BY py")
def _(spark, sf):
    h = raster.fold(F.col("values"), F.lit(7).cast("long"), lambda a, b: (a * 31 + b) % 1000003)
    return raster.rows_of(px(spark, sf)).select("py", h.alias("h"))


@query("raster_crop", f"{PX} SELECT px, py, v FROM px WHERE px >= 5 AND px < 20 AND py >= 3 AND py < 9")
def _(spark, sf):
    return raster.window(px(spark, sf), 5, 3, 20, 9).select("px", "py", "v")


@query("raster_srs_window", f"{PX} SELECT px, py, v, 10 + px * 0.5 AS x, 20 - py * 0.5 AS y FROM px WHERE px >= 4 AND px < 15 AND py >= 2 AND py < 11".replace("10 + px * 0.5", "CAST(10 + px * 0.5 AS DOUBLE)").replace("20 - py * 0.5", "CAST(20 - py * 0.5 AS DOUBLE)"))
def _(spark, sf):
    x, y = raster.to_srs(F.col("px"), F.col("py"), _G)
    return raster.srs_window(px(spark, sf), (12.1, 14.6), (17.4, 18.9), _G).select("px", "py", "v", x.alias("x"), y.alias("y"))


@query("raster_bounds", f"{PX} SELECT min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, min(v) AS v0, max(v) AS v1, count(*) AS n FROM px WHERE valid")
def _(spark, sf):
    p = px(spark, sf).filter("valid")
    return p.agg(*[f(c).alias(f"{n}{k}") for n, c in (("x", "px"), ("y", "py"), ("v", "v")) for k, f in ((0, F.min), (1, F.max))], F.count(F.lit(1)).alias("n"))


for _name, _fn, _sql in (
    ("reduce_min", raster.reduce_min, "min(v)"), ("reduce_max", raster.reduce_max, "max(v)"), ("reduce_box_l1", raster.reduce_mean, "CAST(round(avg(v)) AS BIGINT)"),
    ("reduce_median", raster.reduce_median, "CAST(round((list_sort(list(v))[2] + list_sort(list(v))[3]) / 2.0) AS BIGINT)"),
):
    def _q(spark, sf, fn=_fn):
        return raster.halve(px(spark, sf), v=fn)

    _ok = "" if _name != "reduce_median" else " HAVING count(*) = 4"
    if _ok:
        def _q(spark, sf, fn=_fn):  # noqa: F811
            p = px(spark, sf)
            whole = p.groupBy(F.floor(F.col("px") / 2).alias("bx"), F.floor(F.col("py") / 2).alias("by")).agg(F.count(F.lit(1)).alias("k")).filter("k = 4")
            return raster.halve(p.join(whole, (F.floor(F.col("px") / 2) == F.col("bx")) & (F.floor(F.col("py") / 2) == F.col("by")), "left_semi"), v=fn)

    query(_name, f"{PX} SELECT {HALF}, {_sql} AS v FROM px GROUP BY ALL".replace("GROUP BY ALL", f"GROUP BY px // 2, py // 2{_ok}"))(_q)


@query("reduce_mode", f"""{PX}, c AS (SELECT px // 2 AS x, py // 2 AS y, attr, count(*) AS n, min((py % 2) * 2 + px % 2) AS f FROM px GROUP BY 1, 2, 3)
SELECT CAST(x AS BIGINT) AS px, CAST(y AS BIGINT) AS py, attr FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def _(spark, sf):
    return raster.mode_of_block(px(spark, sf), "attr").select("px", "py", "attr")


@query("attribution_vote", f"""{PX}, c AS (SELECT px // 2 AS x, py // 2 AS y, attr, count(*) AS n, min((py % 2) * 2 + px % 2) AS f FROM px GROUP BY 1, 2, 3),
m AS (SELECT x, y, attr FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY n DESC, f) AS r FROM c) WHERE r = 1),
b AS (SELECT px // 2 AS x, py // 2 AS y, CAST(round(avg(v)) AS BIGINT) AS v FROM px GROUP BY 1, 2)
SELECT CAST(b.x AS BIGINT) AS px, CAST(b.y AS BIGINT) AS py, v, attr FROM b JOIN m ON b.x = m.x AND b.y = m.y""")
def _(spark, sf):
    p = px(spark, sf)
    return raster.zip_with(raster.halve(p, v=raster.reduce_mean), raster.mode_of_block(p, "attr"))


_L1 = f"l1 AS (SELECT {HALF}, CAST(round(avg(v)) AS BIGINT) AS v FROM px GROUP BY px // 2, py // 2)"


@query("reduce_box_l3_stagewise", f"{PX}, {_L1}, l2 AS (SELECT {HALF}, CAST(round(avg(v)) AS BIGINT) AS v FROM l1 GROUP BY px // 2, py // 2) SELECT {HALF}, CAST(round(avg(v)) AS BIGINT) AS v FROM l2 GROUP BY px // 2, py // 2")
def _(spark, sf):
    raster.require_divisible(32, 32, 3)
    return raster.halve(px(spark, sf), 3, v=raster.reduce_mean)


@query("decimate", f"{PX} SELECT {HALF}, v FROM px WHERE px % 2 = 0 AND py % 2 = 0")
def _(spark, sf):
    return raster.strided(px(spark, sf), 2).select("px", "py", "v")


@query("attribution_join", f"{PX}, a AS (SELECT n_nationkey AS idx, n_name AS copyright, r_name AS license FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT px, py, copyright, license FROM px LEFT JOIN a ON attr = idx")
def _(spark, sf):
    a = fx.read(spark, sf, "nation").join(fx.read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    a = a.select(F.col("n_nationkey").cast("long").alias("attr"), F.col("n_name").alias("copyright"), F.col("r_name").alias("license"))
    return px(spark, sf).join(a, "attr", "left").select("px", "py", "copyright", "license")


_S = "CASE WHEN s <= 0.04045 THEN s / 12.92 ELSE power((s + 0.055) / 1.055, 2.4) END"


@query("srgb_box", f"""{PX}, s AS (SELECT px, py, (v % 256) / 255.0 AS s FROM px), a AS (SELECT {HALF}, avg({_S}) AS m FROM s GROUP BY px // 2, py // 2)
SELECT px, py, CAST(least(greatest(round(255.0 * CASE WHEN m <= 0.0031308 THEN m * 12.92 ELSE 1.055 * power(m, 1 / 2.4) - 0.055 END), 0), 255) AS BIGINT) AS v FROM a""")
def _(spark, sf):
    p = px(spark, sf).withColumn("v", raster.decode_srgb(F.col("v") % 256))
    return raster.halve(p, v=F.avg).withColumn("v", raster.encode_srgb(F.col("v")))


@query("valid_default_replace", f"{PX} SELECT px, py, CASE WHEN valid THEN v ELSE -1 END AS v FROM px")
def _(spark, sf):
    return px(spark, sf).select("px", "py", raster.replace_invalid(F.col("v"), F.col("valid"), F.lit(-1).cast("long")).alias("v"))


@query("stencil_sum3x3", f"{PX} SELECT a.px - dx AS px, a.py - dy AS py, CAST(sum(v) AS DOUBLE) AS v FROM px a, (SELECT unnest([0, 1, 2]) AS dx), (SELECT unnest([0, 1, 2]) AS dy) WHERE a.px - dx BETWEEN 0 AND 29 AND a.py - dy BETWEEN 0 AND 29 GROUP BY 1, 2 HAVING count(*) = 9")
def _(spark, sf):
    return raster.stencil(px(spark, sf), [(x, y, 1.0) for x in range(3) for y in range(3)], 32, 32)


def _values(name: str, rows) -> str:
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(f'CAST({x!r} AS DOUBLE)' if isinstance(x, float) else repr(x) for x in r)})" for r in rows) + f") t({', '.join('abcd'[: len(rows[0])])}))"


@query("gaussian_1d", f"{PX}, {_values('k', list(enumerate(raster.gaussian_kernel(5))))} SELECT px.px - a AS px, py, {r6('sum(v * b)')} AS v FROM px, k WHERE px.px - a BETWEEN 0 AND 27 GROUP BY 1, 2 HAVING count(*) = 5")
def _(spark, sf):
    out = raster.stencil(px(spark, sf), [(i, 0, w) for i, w in enumerate(raster.gaussian_kernel(5))], 32, 32)
    return out.select("px", "py", *[c.alias("v") for c in rounded(F.col("v"))])


def _clamped(taps, table: str, axis: str, n: int, name: str) -> str:
    """Axis-wise clamped filter in SQL: every place reads its taps."""
    other = "py" if axis == "px" else "px"
    at = f"least(greatest(o.i + k.a, 0), {n - 1})"
    return f"{_values('k_' + name, taps)}, {name} AS (SELECT o.i AS {axis}, s.{other} AS {other}, sum(s.v * k.b) AS v FROM (SELECT unnest(range(0, {n})) AS i) o, k_{name} k JOIN {table} s ON s.{axis} = {at} GROUP BY 1, 2 HAVING count(*) = {len(taps)})"


@query("clamped_stencil", f"{PX}, {_clamped([(-1, 1.0), (0, 2.0), (1, 1.0)], 'px', 'px', 32, 'h')}, {_clamped([(-1, 1.0), (0, 2.0), (1, 1.0)], 'h', 'py', 32, 'g')} SELECT px, py, {r6('v')} AS v FROM g")
def _(spark, sf):
    out = raster.separable(px(spark, sf).select("px", "py", "v"), [(-1, 1.0), (0, 2.0), (1, 1.0)], 32, 32)
    return out.select("px", "py", *[c.alias("v") for c in rounded(F.col("v"))])


_L3 = [(k - 5, w) for k, w in enumerate(raster.lanczos_down_kernel(3))]


@query("lanczos3_down", f"{PX}, {_clamped(_L3, 'px', 'px', 32, 'h')}, {_clamped(_L3, 'h', 'py', 32, 'g')} SELECT {HALF}, {r6('v')} AS v FROM g WHERE px % 2 = 0 AND py % 2 = 0")
def _(spark, sf):
    out = raster.lanczos_down(px(spark, sf), 3, 32, 32)
    return out.select("px", "py", *[c.alias("v") for c in rounded(F.col("v"))])


def _upscaled(factor: int, radius: int) -> str:
    parts, taps = [PX], raster.upscale_taps(factor, radius)
    for axis, source, n in (("px", "px", 32), ("py", "ux", 32)):
        names = []
        for r, t in enumerate(taps):
            parts.append(_clamped(t, source, axis, n, f"{axis}{r}"))
            names.append(f"SELECT {axis} * {factor} + {r} AS {axis}, {'py' if axis == 'px' else 'px'}, v FROM {axis}{r}")
        parts.append(f"u{axis[1]} AS ({' UNION ALL '.join(names)})")
    return ", ".join(parts) + f" SELECT px, py, {r6('v')} AS v FROM uy"


for _name, _f, _r in (("upscale_nearest", 2, 0), ("upscale_bilinear", 2, 1), ("lanczos2_up", 2, 2)):
    def _u(spark, sf, f=_f, r=_r):
        out = raster.upscale(px(spark, sf), f, r, 32, 32)
        return out.select("px", "py", *[c.alias("v") for c in rounded(F.col("v"))])

    query(_name, _upscaled(_f, _r))(_u)


@query("grid_node_linear_up", f"""{PX}, h AS (SELECT px * 2 AS px, py, CAST(v AS DOUBLE) AS v FROM px UNION ALL SELECT a.px * 2 + 1, a.py, (a.v + b.v) / 2.0 FROM px a JOIN px b ON b.py = a.py AND b.px = a.px + 1)
SELECT px, py * 2 AS py, {r6('v')} AS v FROM h UNION ALL SELECT a.px, a.py * 2 + 1, {r6('(a.v + b.v) / 2.0')} FROM h a JOIN h b ON b.px = a.px AND b.py = a.py + 1""")
def _(spark, sf):
    whole = px(spark, sf)
    return raster.upscale_nodes(whole).select("px", "py", *[c.alias("v") for c in rounded(F.col("v"))])


@query("dilate_one_round", f"""{PX}, g AS (SELECT a.px + dx AS px, a.py + dy AS py, avg(v) AS m FROM px a, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy) WHERE valid GROUP BY 1, 2)
SELECT px.px, px.py, {r6('CASE WHEN valid THEN v ELSE coalesce(m, v) END')} AS v, valid OR m IS NOT NULL AS valid FROM px LEFT JOIN g ON px.px = g.px AND px.py = g.py""")
def _(spark, sf):
    out = raster.dilate(px(spark, sf), 32, 32)
    return out.select("px", "py", *[c.alias("v") for c in rounded(F.col("v"))], "valid")
