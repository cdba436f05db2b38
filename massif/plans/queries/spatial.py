"""Queries of spatial joins, coordinates and tiles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from massif.functions import octree, quadtree, srs, texts
from massif.operators import outline, spatial
from massif.plans import fixtures as fx
from massif.plans.registry import query, rounded

PT = f"WITH {fx.PT}"
EPS = 0.05
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query("eps_pairs", f"{PT} SELECT a.id AS u, b.id AS v FROM pt a JOIN pt b ON a.id < b.id WHERE {D2} <= {EPS * EPS!r}")
def _(spark, sf):
    p = fx.points(spark, sf)
    return spatial.epsilon_join(p, p, EPS).filter("id < r_id").select(F.col("id").alias("u"), F.col("r_id").alias("v"))


@query("eps_nearest", f"""{PT} SELECT id, near FROM (SELECT a.id AS id, b.id AS near, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS r
FROM pt a JOIN pt b ON a.id % 2 = 0 AND b.id % 2 = 1 WHERE {D2} < {0.2 * 0.2!r}) WHERE r = 1""")
def _(spark, sf):
    p = fx.points(spark, sf)
    return spatial.nearest(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 0.2).select("id", "near")


_GRID = ", ".join(f"floor({a} * 8) AS {a}" for a in "xyz")


@query("exact_position_join", f"WITH {fx.PT}, g AS (SELECT id, {_GRID} FROM pt) SELECT a.id AS id, b.id AS r_id FROM g a JOIN g b ON a.x = b.x AND a.y = b.y AND a.z = b.z WHERE a.id % 2 = 0 AND b.id % 2 = 1")
def _(spark, sf):
    g = fx.points(spark, sf).select("id", *[F.floor(F.col(a) * 8).alias(a) for a in "xyz"])
    return spatial.exact_join(g.filter("id % 2 = 0"), g.filter("id % 2 = 1")).select("id", "r_id")


_N = "sqrt(x * x + y * y + z * z)"


@query("sphere_projected_join", f"WITH {fx.PT}, s AS (SELECT id, x / {_N} AS x, y / {_N} AS y, z / {_N} AS z FROM pt) SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.id < b.id WHERE {D2} <= {0.06 * 0.06!r}")
def _(spark, sf):
    p = spatial.on_sphere(fx.points(spark, sf), 1.0)
    return spatial.epsilon_join(p, p, 0.06).filter("id < r_id").select(F.col("id").alias("u"), F.col("r_id").alias("v"))


@query("box_intersection_join", f"""WITH {fx.PT}, b AS (SELECT id, x - 0.02 AS x0, x + 0.02 AS x1, y - 0.03 AS y0, y + 0.03 AS y1, z - 0.02 AS z0, z + 0.02 AS z1 FROM pt)
SELECT a.id AS l_id, b.id AS r_id FROM b a JOIN b ON a.id < b.id AND greatest(a.x0, b.x0) <= least(a.x1, b.x1) AND greatest(a.y0, b.y0) <= least(a.y1, b.y1) AND greatest(a.z0, b.z0) <= least(a.z1, b.z1)""")
def _(spark, sf):
    half = {"x": 0.02, "y": 0.03, "z": 0.02}
    b = fx.points(spark, sf).select("id", *[(F.col(a) - half[a]).alias(f"lo_{a}") for a in "xyz"], *[(F.col(a) + half[a]).alias(f"hi_{a}") for a in "xyz"])
    return spatial.box_join(b, b, fx.UNIT, 4).filter("l_id < r_id")


@query("nearest_ancestor_join", f"""WITH {fx.PT}, {fx.PAIR}, st AS (SELECT level, index FROM lp UNION SELECT DISTINCT CAST(2 AS BIGINT), index >> 3 FROM lp WHERE index % 4 = 0)
SELECT r.level, r.index, max(st.level) AS found_level, max_by(st.index, st.level) AS found_index FROM rp r LEFT JOIN st ON st.level <= r.level AND r.index >> CAST(3 * (r.level - st.level) AS BIGINT) = st.index GROUP BY 1, 2""")
def _(spark, sf):
    left, right = fx.tree_pair(spark, sf)
    up = left.filter("index % 4 = 0").select(F.lit(2).cast("long").alias("level"), F.shiftright("index", 3).alias("index"))
    return spatial.nearest_ancestor(right, left.union(up).distinct())


@query("region_filter", f"{PT} SELECT id FROM pt WHERE ((x >= -0.2 AND x < 0.1 AND y >= -0.2 AND y < 0.2 AND z >= -0.3 AND z < 0.3) OR (x >= 0.1 AND x < 0.3 AND y >= -0.1 AND y < 0.1 AND z >= -0.3 AND z < 0.3)) AND NOT (x >= -0.05 AND x < 0.05 AND y >= -0.05 AND y < 0.05 AND z >= -0.3 AND z < 0.3)")
def _(spark, sf):
    inc = [((-0.2, -0.2, -0.3), (0.1, 0.2, 0.3)), ((0.1, -0.1, -0.3), (0.3, 0.1, 0.3))]
    return spatial.region_filter(fx.points(spark, sf), inc, [((-0.05, -0.05, -0.3), (0.05, 0.05, 0.3))]).select("id")


@query("octant_partition", f"{PT} SELECT CAST((CASE WHEN x >= 0 THEN 1 ELSE 0 END) + (CASE WHEN y >= 0 THEN 2 ELSE 0 END) + (CASE WHEN z >= 0 THEN 4 ELSE 0 END) AS BIGINT) AS octant, count(*) AS n FROM pt GROUP BY 1")
def _(spark, sf):
    return fx.points(spark, sf).groupBy(spatial.octant((0.0, 0.0, 0.0)).cast("long").alias("octant")).agg(F.count(F.lit(1)).alias("n"))


_LL = "ll AS (SELECT id, x * 900 AS lo, x * 900 + 5 + abs(y) * 200 AS hi FROM pt)"


@query("antimeridian_split", f"""WITH {fx.PT}, {_LL}, a AS (SELECT id, hi - lo AS w, lo + 180 - 360 * floor((lo + 180) / 360) - 180 AS a FROM ll)
SELECT id, round(a, 6) + 0.0 AS lo, round(least(a + w, 180.0), 6) + 0.0 AS hi FROM a WHERE w < 360
UNION ALL SELECT id, -180.0, round(a + w - 360, 6) + 0.0 FROM a WHERE w < 360 AND a + w > 180""")
def _(spark, sf):
    d = fx.points(spark, sf).select("id", (F.col("x") * 900).alias("lo"), (F.col("x") * 900 + 5 + F.abs("y") * 200).alias("hi"))
    d = d.select("id", F.explode(spatial.longitude_parts(F.col("lo"), F.col("hi"))).alias("p"))
    lo, hi = rounded(F.col("p.lo"), F.col("p.hi"))
    return d.select("id", lo.alias("lo"), hi.alias("hi"))


@query("native_window_join", f"""WITH {fx.PT}, {_LL}, a AS (SELECT id, hi - lo AS w, lo + 180 - 360 * floor((lo + 180) / 360) - 180 AS a FROM ll),
p AS (SELECT id, a AS lo, least(a + w, 180.0) AS hi FROM a UNION ALL SELECT id, -180.0, a + w - 360 FROM a WHERE a + w > 180),
s AS (SELECT unnest(range(0, 36)) AS strip)
SELECT DISTINCT id, strip FROM p JOIN s ON floor((lo + 180) / 10) <= strip AND strip <= least(floor((hi + 180) / 10), 35)""")
def _(spark, sf):
    d = fx.points(spark, sf).select("id", F.explode(spatial.longitude_parts(F.col("x") * 900, F.col("x") * 900 + 5 + F.abs("y") * 200)).alias("p"))
    a, b = F.floor((F.col("p.lo") + 180) / 10), F.least(F.floor((F.col("p.hi") + 180) / 10), F.lit(35))
    return d.select("id", F.explode(F.sequence(a.cast("long"), b.cast("long"))).alias("strip")).distinct()


def _cover_sql(depth: int) -> str:
    parts = [f"{fx.QK}, t AS (SELECT zoom, x, y FROM qk UNION SELECT DISTINCT zoom - 1, x >> 1, y >> 1 FROM qk UNION SELECT DISTINCT zoom - 2, x >> 2, y >> 2 FROM qk), c{depth} AS (SELECT x, y FROM t WHERE zoom = {depth})"]
    for z in range(depth - 1, -1, -1):
        parts.append(f"f{z} AS (SELECT x >> 1 AS x, y >> 1 AS y FROM c{z + 1} GROUP BY 1, 2 HAVING count(*) = 4), c{z} AS (SELECT x, y FROM t WHERE zoom = {z} UNION SELECT x, y FROM f{z})")
    last = " UNION ALL ".join([f"SELECT CAST({depth} AS BIGINT) AS zoom, x, y FROM c{depth}"] + [f"SELECT CAST({z} AS BIGINT), x, y FROM t WHERE zoom = {z} AND (x, y) NOT IN (SELECT (x, y) FROM f{z})" for z in range(depth)])
    return f"WITH {', '.join(parts)} {last}"


@query("tile_cover_painter", _cover_sql(6))
def _(spark, sf):
    k = fx.quad_keys(spark, sf)
    up = [k.select((F.col("zoom") - d).alias("zoom"), F.shiftright("x", d).alias("x"), F.shiftright("y", d).alias("y")) for d in (1, 2)]
    return spatial.tile_cover(k.union(up[0]).union(up[1]).distinct(), 6)


@query("nearest_top_k", f"{PT} SELECT id FROM pt ORDER BY power(x - 0.1, 2) + power(y + 0.05, 2) + power(z - 0.0, 2), id LIMIT 10")
def _(spark, sf):
    """The ten closest: the limit is the operator."""
    return spatial.rank_by_distance(fx.points(spark, sf), (0.1, -0.05, 0.0), 10).select("id")


_LON, _LAT = "x * 400", "y * 200"
_M = f"({_LON}) * (20037508.342789244 / 180) AS mx, ln(tan(radians({_LAT}) / 2 + pi() / 4)) * 6378137.0 AS my"


def _ll(spark, sf):
    return fx.points(spark, sf).select("id", (F.col("x") * 400).alias("lon"), (F.col("y") * 200).alias("lat"), (F.col("z") * 3000).alias("h"))


@query("lonlat_to_mercator", f"{PT} SELECT id, round(mx, 3) + 0.0 AS mx, round(my, 3) + 0.0 AS my FROM (SELECT id, {_M} FROM pt)")
def _(spark, sf):
    x, y = srs.to_mercator(F.col("lon"), F.col("lat"))
    return _ll(spark, sf).select("id", (F.round(x, 3) + 0.0).alias("mx"), (F.round(y, 3) + 0.0).alias("my"))


# Embeddings reach past 90 degrees: there Mercator has no northing, so no latitude comes back. At -90 itself it is the logarithm of zero.
_PROJECTS = f"{_LAT} > -90 AND {_LAT} <= 90"


@query("mercator_roundtrip", f"{PT} SELECT id, round({_LON}, 6) + 0.0 AS lon, CASE WHEN {_PROJECTS} THEN round({_LAT}, 6) + 0.0 END AS lat FROM pt")
def _(spark, sf):
    x, y = srs.to_mercator(F.col("lon"), F.col("lat"))
    d = _ll(spark, sf).select("id", x.alias("mx"), y.alias("my"))
    lon, lat = rounded(*srs.from_mercator(F.col("mx"), F.col("my")))
    return d.select("id", lon.alias("lon"), lat.alias("lat"))


@query("tile_for_point", f"{PT}, m AS (SELECT id, {_M} FROM pt) SELECT id, CAST(floor((mx + 20037508.342789244) / (2 * 20037508.342789244 / 4096)) AS BIGINT) AS tx, CAST(floor((my + 20037508.342789244) / (2 * 20037508.342789244 / 4096)) AS BIGINT) AS ty FROM m")
def _(spark, sf):
    tx, ty = quadtree.tile_of(F.lit(12), *srs.to_mercator(F.col("lon"), F.col("lat")))
    return _ll(spark, sf).select("id", tx.alias("tx"), ty.alias("ty"))


_E2 = repr(srs.E2)
_NN = f"6378137.0 / sqrt(1 - {_E2} * sin(phi) * sin(phi))"


@query("lonlat_to_ecef", f"{PT}, e AS (SELECT id, radians({_LON}) AS lam, radians({_LAT}) AS phi, z * 3000 AS h FROM pt) SELECT id, round(({_NN} + h) * cos(phi) * cos(lam), 3) + 0.0 AS x, round(({_NN} + h) * cos(phi) * sin(lam), 3) + 0.0 AS y, round(({_NN} * (1 - {_E2}) + h) * sin(phi), 3) + 0.0 AS z FROM e")
def _(spark, sf):
    at = srs.to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    return _ll(spark, sf).select("id", *[(F.round(c, 3) + 0.0).alias(n) for c, n in zip(at, "xyz", strict=True)])


# A place comes back with its longitude in -180 to 180 and its latitude in -90 to 90: over a pole both turn.
_OVER = f"abs({_LAT}) > 90"
_BACK = f"CASE WHEN {_OVER} THEN {_LON} + 180 ELSE {_LON} END"


@query("ecef_to_lonlat", f"{PT} SELECT id, round(CASE WHEN abs(t) > 180 THEN t - 360 * floor((t + 180) / 360) ELSE t END, 6) + 0.0 AS lon, round(CASE WHEN {_OVER} THEN sign(y) * 180 - {_LAT} ELSE {_LAT} END, 6) + 0.0 AS lat, round(z * 3000, 2) + 0.0 AS h FROM (SELECT *, {_BACK} AS t FROM pt)")
def _(spark, sf):
    d = _ll(spark, sf).select("id", *[c.alias(n) for c, n in zip(srs.to_ecef(F.col("lon"), F.col("lat"), F.col("h")), "xyz", strict=True)])
    lon, lat, h = srs.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return d.select("id", *[c.alias(n) for c, n in zip(rounded(lon, lat), ("lon", "lat"), strict=True)], (F.round(h, 2) + 0.0).alias("h"))


@query("sphere_directions", f"{PT} SELECT id, round(degrees(atan2(y, x)), 6) + 0.0 AS lon, round(degrees(asin(z / {_N})), 6) + 0.0 AS lat FROM pt")
def _(spark, sf):
    lon, lat = rounded(*srs.sphere(F.col("x"), F.col("y"), F.col("z")))
    return fx.points(spark, sf).select("id", lon.alias("lon"), lat.alias("lat"))


_RX = [f"x * cos({k} * pi() / 8) - y * sin({k} * pi() / 8)" for k in range(16)]


@query("rotated_bounds", f"WITH {fx.PT}, {fx.BOX}, s AS (SELECT label, lo_x AS x, unnest([lo_y, (lo_y + hi_y) / 2, hi_y]) AS y FROM bx UNION ALL SELECT label, hi_x, unnest([lo_y, (lo_y + hi_y) / 2, hi_y]) FROM bx), m AS (SELECT label, CASE WHEN {_PROJECTS} THEN ln(tan(radians(y * 200) / 2 + pi() / 4)) END AS my FROM s) SELECT label, round(min(my), 6) + 0.0 AS lo, round(max(my), 6) + 0.0 AS hi FROM m GROUP BY label")
def _(spark, sf):
    """Bounds of transformed boundary samples; samples past a pole have no northing and are left out."""
    b = fx.boxes(spark, sf)
    s = b.select("label", F.explode(F.array("lo_x", "hi_x")).alias("x"), "lo_y", "hi_y").select("label", "x", F.explode(F.array(F.col("lo_y"), (F.col("lo_y") + F.col("hi_y")) / 2, F.col("hi_y"))).alias("y"))
    my = F.log(F.tan(F.radians(F.col("y") * 200) / 2 + math.pi / 4))
    lo, hi = rounded(F.min(my), F.max(my))
    return s.groupBy("label").agg(lo.alias("lo"), hi.alias("hi"))


@query("quantise", f"{PT} SELECT id, round(floor(x / 0.01) * 0.01, 6) + 0.0 AS down, CAST(floor(y / 0.01) AS BIGINT) AS cell, CAST(CASE WHEN id <= 1 THEN 1 ELSE power(2, ceil(log2(id))) END AS BIGINT) AS pow2, CAST(ceil(id / 16.0) * 16 AS BIGINT) AS aligned FROM pt")
def _(spark, sf):
    down = rounded(texts.quantize_floor(F.col("x"), 0.01))[0]
    return fx.points(spark, sf).select("id", down.alias("down"), spatial.bucket(F.col("y"), 0.01).alias("cell"), texts.next_power_of_two(F.col("id")).alias("pow2"), texts.align_up(F.col("id"), 16).alias("aligned"))


@query("strict_integer_parse", "SELECT p_partkey, TRY_CAST(CASE WHEN regexp_matches(p_brand, '^-?[0-9]+$') THEN p_brand END AS BIGINT) AS whole, CASE WHEN regexp_matches(regexp_replace(p_brand, '[^0-9]', '', 'g'), '^[0-9]+$') THEN CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS BIGINT) END AS digits, CASE WHEN p_partkey < 1024 THEN p_partkey || ' B'" + "".join(f" WHEN p_partkey < {1 << 10 * k + 10} THEN printf('%.2f {u}', round(p_partkey / {1 << 10 * k}.0, 2))" for k, u in ((1, "KiB"), (2, "MiB"), (3, "GiB"))) + " ELSE printf('%.2f TiB', round(p_partkey / 1099511627776.0, 2)) END AS size FROM part")
def _(spark, sf):
    p = fx.read(spark, sf, "part")
    return p.select("p_partkey", texts.strict_integer(F.col("p_brand")).alias("whole"), texts.strict_integer(F.regexp_replace("p_brand", "[^0-9]", "")).alias("digits"), texts.byte_size(F.col("p_partkey")).alias("size"))


@query("range_algebra", f"WITH {fx.PT}, {fx.BOX} SELECT a.label AS l, b.label AS r, round(greatest(a.lo_x, b.lo_x), 6) + 0.0 AS lo, round(least(a.hi_x, b.hi_x), 6) + 0.0 AS hi FROM bx a JOIN bx b ON a.label + 1 = b.label WHERE greatest(a.lo_x, b.lo_x) < least(a.hi_x, b.hi_x)")
def _(spark, sf):
    b = fx.boxes(spark, sf)
    j = b.join(b.select((F.col("label") - 1).alias("label"), F.col("label").alias("r"), F.col("lo_x").alias("l2"), F.col("hi_x").alias("h2")), "label")
    j = j.withColumn("i", texts.intersect_ranges(F.col("lo_x"), F.col("hi_x"), F.col("l2"), F.col("h2"))).filter("i is not null")
    lo, hi = rounded(F.col("i.lo"), F.col("i.hi"))
    return j.select(F.col("label").alias("l"), "r", lo.alias("lo"), hi.alias("hi"))


@query("coarse_cell_counts", f"WITH {fx.PT} SELECT {fx.sql_cell(2)} AS cell, count(*) AS n FROM pt GROUP BY 1")
def _(spark, sf):
    return fx.points(spark, sf).groupBy(octree.cell_of(fx.UNIT, F.lit(2), F.col("x"), F.col("y"), F.col("z")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("mask_simplify")
def _(spark, sf):
    """One ring of 360 corners for each label, its radius taken from the points of the label."""
    p = fx.points(spark, sf).groupBy("label", (F.col("id") % 360).alias("seq")).agg(F.avg("x").alias("x"))
    t = F.radians(F.col("seq").cast("double"))
    ring = p.select(F.col("label").alias("mask"), F.lit(0).alias("component"), F.lit(0).alias("ring"), "seq", ((1 + F.col("x") / 100) * F.cos(t)).alias("x"), ((1 + F.col("x") / 100) * F.sin(t)).alias("y"))
    return outline.simplify_outlines(ring, 0.01)
