"""Queries of functions on keys, ranges, integers, triangles and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree, quadtree, texts
from massif.operators import mesh
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import PLACED, V, tri
from massif.plans.registry import query, rounded

PT = f"WITH {fx.PT}"


def _shifted(level: int, c: str) -> tuple[str, str]:
    size = 2.0 / 2**level
    if level % 2 == 0:
        return f"-1 + {c} * {size!r}", f"-1 + ({c} + 1) * {size!r}"
    return f"-1 + {c} * {size!r} - CASE WHEN {c} > 0 THEN {size / 2!r} ELSE 0 END", f"-1 + ({c} + 1) * {size!r} - CASE WHEN {c} < {2**level - 1} THEN {size / 2!r} ELSE 0 END"


_PARTS = []
for _k, _n in enumerate("xyz"):
    _c = fx.sql_coord("index", _k, 5)
    _PARTS.append(f"CAST(least({_shifted(5, _c)[0]}, {_shifted(6, f'(2 * {_c})')[0]}) AS DOUBLE) AS lo_{_n}, CAST(greatest({_shifted(5, _c)[1]}, {_shifted(6, f'(2 * {_c} + 1)')[1]}) AS DOUBLE) AS hi_{_n}")


@query("shifted_bounds_with_children", f"{PT}, {fx.LEAF} SELECT level, index, {', '.join(_PARTS)} FROM leaf")
def _(spark, sf):
    leaf = fx.leaves(spark, sf)
    b = octree.shifted_bounds_with_children(fx.UNIT, F.col("level"), F.col("index"))
    return leaf.select("level", "index", *[b[k + 3 * h].alias(f"{p}_{n}") for h, p in enumerate(("lo", "hi")) for k, n in enumerate("xyz")])


_AT = {n: (f"least(CAST(floor((lo_{n} + {2 / 8 / 1024!r} + 1) / 0.25 + 0.5) AS BIGINT), 7)", f"least(CAST(floor((hi_{n} - {2 / 8 / 1024!r} + 1) / 0.25 + 0.5) AS BIGINT), 7)") for n in "xyz"}
_EACH = ", ".join(f"unnest(range({a}, {b} + 1)) AS c{n}" for n, (a, b) in _AT.items())


@query("shifted_box_cover", f"{PT}, {fx.BOX}, s AS (SELECT label, x, y, z FROM bx, LATERAL (SELECT unnest(range({_AT['x'][0]}, {_AT['x'][1]} + 1)) AS x), LATERAL (SELECT unnest(range({_AT['y'][0]}, {_AT['y'][1]} + 1)) AS y), LATERAL (SELECT unnest(range({_AT['z'][0]}, {_AT['z'][1]} + 1)) AS z)) SELECT label, {fx.sql_morton('x', 'y', 'z', 3)} AS index FROM s")
def _(spark, sf):
    b = fx.boxes(spark, sf)
    cover = octree.shifted_box_cover(fx.UNIT, F.lit(3), [F.col(f"lo_{n}") for n in "xyz"], [F.col(f"hi_{n}") for n in "xyz"])
    return b.select("label", F.explode(cover).alias("index"))


@query("key_text", f"{PT}, {fx.LEAF} SELECT level, index, 'Id(level=' || level || ', coords=(' || {fx.sql_coord('index', 0, 5)} || ', ' || {fx.sql_coord('index', 1, 5)} || ', ' || {fx.sql_coord('index', 2, 5)} || '), index=' || index || ')' AS text FROM leaf")
def _(spark, sf):
    return fx.leaves(spark, sf).select("level", "index", octree.key_text(F.col("level"), F.col("index")).alias("text"))


@query("point_containment", f"{PT} SELECT id, x >= -0.25 AND x < 0.25 AND y >= -0.25 AND y < 0.25 AND z >= -0.25 AND z < 0.25 AS inside FROM pt")
def _(spark, sf):
    inside = octree.contains(octree.Space(-0.25, 0.5), F.col("x"), F.col("y"), F.col("z"))
    return fx.points(spark, sf).select("id", inside.alias("inside"))


_H = 20037508.342789244
_TILE = f"CAST(floor((%s * {_H!r} + {_H!r}) / ({2 * _H!r} / (1 << z))) AS BIGINT)"


@query("smallest_encompassing_tile", f"""{PT}, {fx.BOX}, zs AS (SELECT label, z, {_TILE % 'lo_x'} AS x, {_TILE % 'lo_y'} AS y, {_TILE % 'hi_x'} AS x1, {_TILE % 'hi_y'} AS y1 FROM (SELECT label, lo_x / 8 AS lo_x, lo_y / 8 AS lo_y, lo_x / 8 + (hi_x - lo_x) / 512 AS hi_x, lo_y / 8 + (hi_y - lo_y) / 512 AS hi_y FROM bx), (SELECT unnest(range(0, 25)) AS z))
SELECT label, CAST(max(z) AS BIGINT) AS zoom, max_by(x, z) AS x, max_by(y, z) AS y FROM zs WHERE x = x1 AND y = y1 GROUP BY label""")
def _(spark, sf):
    b = fx.boxes(spark, sf)
    lo = [F.col(f"lo_{n}") / 8 for n in "xy"]
    hi = [F.col(f"lo_{n}") / 8 + (F.col(f"hi_{n}") - F.col(f"lo_{n}")) / 512 for n in "xy"]
    found = quadtree.smallest_tile(*[c * _H for c in (*lo, *hi)])
    return b.select("label", found.alias("t")).select("label", "t.zoom", "t.x", "t.y")


@query("range_set_algebra", """WITH r AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_partkey END AS a0, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_partkey + l_quantity::BIGINT END AS a1, l_suppkey * 7 AS b0, l_suppkey * 7 + l_linenumber AS b1 FROM lineitem),
i AS (SELECT *, greatest(a0, b0) AS lo, least(a1, b1 + 1) AS hi FROM r)
SELECT k, n, (a0 IS NULL OR k >= a0) AND (a1 IS NULL OR k < a1) AS has, coalesce(a0 >= a1, false) AS empty, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, NOT coalesce(a0 >= a1, false) AND NOT coalesce(lo >= hi, false) AS overlap FROM i""")
def _(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    a = texts.span(F.when(n % 3 != 0, F.col("l_partkey")), F.when(n % 4 != 0, F.col("l_partkey") + F.col("l_quantity").cast("long")))
    b = texts.inclusive(F.col("l_suppkey") * 7, F.col("l_suppkey") * 7 + n)
    i = texts.span_intersection(a, b)
    k = F.col("l_orderkey")
    return li.select(k.alias("k"), n.alias("n"), texts.in_span(a, k).alias("has"), texts.span_is_empty(a).alias("empty"), i["lo"].alias("lo"), i["hi"].alias("hi"), texts.spans_overlap(a, b).alias("overlap"))


@query("integer_math", """WITH k AS (SELECT DISTINCT l_orderkey AS k, l_orderkey - 3 * l_suppkey AS d FROM lineitem), p AS (SELECT *, CASE WHEN k >= 1 THEN CAST(power(2, floor(log2(k + 0.25))) AS BIGINT) END AS prev FROM k)
SELECT k, d, CAST(floor(d / 7.0) AS BIGINT) AS floor_div, CAST(ceil(d / 7.0) AS BIGINT) AS ceil_div, CAST(power(3, k % 20) AS BIGINT) AS pow3, prev, CASE WHEN prev IS NULL THEN NULL WHEN k = prev OR k - prev < 2 * prev - k THEN prev ELSE 2 * prev END AS nearest,
  d - ((d % 16) + 16) % 16 AS down, CASE WHEN d < 0 THEN d ELSE 9223372036854775807 END AS added, CASE WHEN d < 0 THEN -9223372036854775808 ELSE d END AS taken FROM p""".replace("CASE WHEN d < 0 THEN d ELSE 9223372036854775807 END", "CASE WHEN d < 0 THEN 9223372036854775807 + d ELSE 9223372036854775807 END").replace("CASE WHEN d < 0 THEN -9223372036854775808 ELSE d END", "CASE WHEN d < -1 THEN -9223372036854775808 ELSE d - 9223372036854775807 END"))
def _(spark, sf):
    k = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") - 3 * F.col("l_suppkey")).alias("d")).distinct()
    d, top = F.col("d"), F.lit((1 << 63) - 1)
    return k.select(
        "k", "d", texts.floor_div(d, 7).alias("floor_div"), texts.ceil_div(d, 7).alias("ceil_div"), texts.integer_power(3, F.col("k") % 20).alias("pow3"), texts.previous_power_of_two(F.col("k")).alias("prev"),
        texts.nearest_power_of_two(F.col("k")).alias("nearest"), texts.align_down(d, 16).alias("down"), texts.saturating_add(d, top).alias("added"), texts.saturating_subtract(d, top).alias("taken"),
    )


@query("next_representable", f"{PT} SELECT id, nextafter(x, CAST('inf' AS DOUBLE)) AS higher, nextafter(x, CAST('-inf' AS DOUBLE)) AS lower FROM pt")
def _(spark, sf):
    return fx.points(spark, sf).select("id", texts.next_higher(F.col("x")).alias("higher"), texts.next_lower(F.col("x")).alias("lower"))


@query("content_digests", "WITH d AS (SELECT p_partkey, sha256(length(p_partkey::VARCHAR) || ':' || p_partkey || length(p_size::VARCHAR) || ':' || p_size) AS a, sha256(length(p_name) || ':' || p_name) AS b FROM part) SELECT p_partkey, a, b, sha256(a || b) AS both FROM d")
def _(spark, sf):
    a, b = texts.content_digest(F.col("p_partkey"), F.col("p_size")), texts.content_digest(F.col("p_name"))
    return fx.read(spark, sf, "part").select("p_partkey", a.alias("a"), b.alias("b"), texts.combine_digests(a, b).alias("both"))


# Triangles

_CEN = ", ".join(f'(a{p} + "b{p}" + c{p}) / 3 AS m{p}' for p in "xyz")
_NN = ", ".join(f'("b{p}" - a{p}) AS u{p}, (c{p} - a{p}) AS w{p}' for p in "xyz")
_FR = f"{PLACED}, f0 AS (SELECT *, {_NN} FROM pl), f1 AS (SELECT *, uy * wz - uz * wy AS nx, uz * wx - ux * wz AS ny, ux * wy - uy * wx AS nz FROM f0), f2 AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS nl, sqrt(ux * ux + uy * uy + uz * uz) AS ul FROM f1)"


@query("plane_frames", f"""{_FR}, q AS (SELECT a, b, c, (0 - ax) * ux / ul + (0 - ay) * uy / ul + (0 - az) * uz / ul AS x, (0 - ax) * nx / nl + (0 - ay) * ny / nl + (0 - az) * nz / nl AS z,
  (0 - ax) * (ny * uz - nz * uy) / nl / ul + (0 - ay) * (nz * ux - nx * uz) / nl / ul + (0 - az) * (nx * uy - ny * ux) / nl / ul AS y FROM f2) SELECT a, b, c, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z FROM q""")
def _(spark, sf):
    t = mesh.placed(tri(spark, sf), fx.vertices(spark, sf))
    corner = [g.point(*[F.col(f"{k}{p}") for p in "xyz"]) for k in "abc"]
    t = t.select("a", "b", "c", g.plane_frame(*corner).alias("f"))
    q = t.select("a", "b", "c", g.project(F.col("f"), g.point(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("q"))
    return q.select("a", "b", "c", *[c.alias(n) for c, n in zip(rounded(*[F.col(f"q.{p}") for p in "xyz"]), "xyz", strict=True)])


def _seg(a: str, b: str) -> str:
    d = {p: f"({b}{p} - {a}{p})" for p in "xyz"}
    size = " + ".join(f"{d[p]} * {d[p]}" for p in "xyz")
    t = f"greatest(0.0, least(1.0, ({' + '.join(f'(p{p} - {a}{p}) * {d[p]}' for p in 'xyz')}) / ({size})))"
    return "sqrt(" + " + ".join(f"power(p{p} - {a}{p} - {t} * {d[p]}, 2)" for p in "xyz") + ")"


def _in(a: str, b: str) -> str:
    d, e = {p: f"({b}{p} - {a}{p})" for p in "xyz"}, {p: f"(p{p} - {a}{p})" for p in "xyz"}
    return f"(({d['y']} * {e['z']} - {d['z']} * {e['y']}) * nx + ({d['z']} * {e['x']} - {d['x']} * {e['z']}) * ny + ({d['x']} * {e['y']} - {d['y']} * {e['x']}) * nz >= 0)"


_RENAMED = f"{_FR}, f3 AS (SELECT a, b, c, nx, ny, nz, nl, " + ", ".join(f'{k}{p} AS {t}{p}' if k != "b" else f'"b{p}" AS {t}{p}' for k, t in zip("abc", ("q", "r", "s"), strict=True) for p in "xyz") + ', ax + 1 + a % 3 AS px, ay + b % 2 AS py, az + 4 AS pz FROM f2)'


@query("triangle_distance", f"""{_RENAMED} SELECT a, b, c, round(CASE WHEN {_in('q', 'r')} AND {_in('r', 's')} AND {_in('s', 'q')} THEN abs((px - qx) * nx + (py - qy) * ny + (pz - qz) * nz) / nl
  ELSE least({_seg('q', 'r')}, {_seg('r', 's')}, {_seg('s', 'q')}) END, 6) + 0.0 AS d FROM f3""")
def _(spark, sf):
    t = mesh.placed(tri(spark, sf), fx.vertices(spark, sf))
    corner = [g.point(*[F.col(f"{k}{p}") for p in "xyz"]) for k in "abc"]
    p = g.point(F.col("ax") + 1 + F.col("a") % 3, F.col("ay") + F.col("b") % 2, F.col("az") + 4)
    return t.select("a", "b", "c", rounded(g.triangle_distance(p, *corner))[0].alias("d"))


def _o(a: str, b: str, p: str) -> str:
    return f"(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"


def _apart(own: str, other: str) -> str:
    out = []
    for i in range(3):
        a, b, c = (f"{own}{(i + k) % 3}" for k in range(3))
        out.append("(" + " AND ".join(f"sign({_o(a, b, c)}) * {_o(a, b, f'{other}{k}')} <= 0" for k in range(3)) + ")")
    return " OR ".join(out)


_T6 = ", ".join(f"round({p}.{c} * 64) AS {n}{c}" for p, n in (("p0", "t0"), ("p1", "t1"), ("p2", "t2"), ("p3", "s0"), ("p4", "s1"), ("p5", "s2")) for c in "xy")
_SIX = "FROM pt p0 " + " ".join(f"JOIN pt p{k} ON p{k}.id = p0.id + {k}" for k in range(1, 6))


def _six(spark, sf):
    p = fx.points(spark, sf).select("id", *[F.round(F.col(c) * 64).alias(c) for c in "xy"])
    out = None
    for k in range(6):
        q = p.select((F.col("id") - k).alias("id"), g.point(F.col("x"), F.col("y"), F.lit(0.0)).alias(f"p{k}"))
        out = q if out is None else out.join(q, "id")
    return out


@query("triangles_overlap", f"{PT}, six AS (SELECT p0.id AS id, {_T6} {_SIX}) SELECT id, NOT ({_apart('t', 's')} OR {_apart('s', 't')}) AS overlap FROM six")
def _(spark, sf):
    s = _six(spark, sf)
    return s.select("id", g.triangles_overlap([F.col(f"p{k}") for k in range(3)], [F.col(f"p{k}") for k in range(3, 6)]).alias("overlap"))


_Q4 = ", ".join(f"CAST(round(round({p}.{c} * 8) / 8 * 65536) AS BIGINT) AS {n}{c}" for p, n in (("p0", "k"), ("p1", "l"), ("p2", "m"), ("p3", "n")) for c in "xy")


def _on(a: str, b: str, p: str) -> str:
    return f"({_o(a, b, p)} = 0 AND {p}x BETWEEN least({a}x, {b}x) AND greatest({a}x, {b}x) AND {p}y BETWEEN least({a}y, {b}y) AND greatest({a}y, {b}y))"


@query("fixed_point_segments", f"""{PT}, f AS (SELECT p0.id AS id, {_Q4} FROM pt p0 JOIN pt p1 ON p1.id = p0.id + 1 JOIN pt p2 ON p2.id = p0.id + 2 JOIN pt p3 ON p3.id = p0.id + 3)
SELECT id, CAST(sign({_o('k', 'l', 'm')}) AS INTEGER) AS side, (sign({_o('k', 'l', 'm')}) * sign({_o('k', 'l', 'n')}) < 0 AND sign({_o('m', 'n', 'k')}) * sign({_o('m', 'n', 'l')}) < 0)
  OR {_on('k', 'l', 'm')} OR {_on('k', 'l', 'n')} OR {_on('m', 'n', 'k')} OR {_on('m', 'n', 'l')} AS meet, kx + (((lx - kx) * 16384) >> 16) AS quarter FROM f""")
def _(spark, sf):
    p, out = fx.points(spark, sf), None
    for k in range(4):
        at = F.struct(*[g.to_fixed(F.round(F.col(c) * 8) / 8).alias(c) for c in "xy"])
        q = p.select((F.col("id") - k).alias("id"), at.alias("abcd"[k]))
        out = q if out is None else out.join(q, "id")
    a, b, c, d = (F.col(n) for n in "abcd")
    return out.select("id", g.fixed_orient(a, b, c).alias("side"), g.fixed_segments_meet(a, b, c, d).alias("meet"), g.fixed_lerp(a["x"], b["x"], F.lit(16384)).alias("quarter"))


@query("normalised_positions", f"""{V}, e AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 AS h, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (min(z) + max(z)) / 2 AS mz FROM vert)
SELECT vid, round(CAST(CAST((x - mx) / h AS FLOAT) AS DOUBLE), 5) + 0.0 AS x, round(CAST(CAST((y - my) / h AS FLOAT) AS DOUBLE), 5) + 0.0 AS y, round(CAST(CAST((z - mz) / h AS FLOAT) AS DOUBLE), 5) + 0.0 AS z FROM vert, e""")
def _(spark, sf):
    v = fx.vertices(spark, sf)
    lo, hi = (F.struct(*[f(p).alias(p) for p in "xyz"]) for f in (F.min, F.max))
    b = v.agg(lo.alias("lo"), hi.alias("hi")).first()  # six numbers
    box = [F.struct(*[F.lit(b[k][p]).alias(p) for p in "xyz"]) for k in ("lo", "hi")]
    n = v.select("vid", g.normalised(F.struct("x", "y", "z"), *box).alias("n"))
    return n.select("vid", *[(F.round(F.col(f"n.{p}").cast("double"), 5) + 0.0).alias(p) for p in "xyz"])
