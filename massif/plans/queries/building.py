"""Queries of building levels of detail and of what serves them."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree
from massif.operators import build
from massif.operators.index import closure
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import _TARGETS, _inputs
from massif.plans.registry import query, rounded
from massif.plans.shared import fresh_dir, stash

PT = f"WITH {fx.PT}"
XYZ9 = [f"{k}{p}" for k in "abc" for p in "xyz"]
# A small triangle at each point, on a grid of 1/1024 so that sums are exact; corners are shared where points are close.
_SNAP = {p: f"(round({p} * 64) / 64)" for p in "xyz"}


def triangles(spark, sf, level: int):
    p = fx.points(spark, sf).select(*[(F.round(F.col(a) * 64) / 64).alias(a) for a in "xyz"]).distinct()
    d = 1 / 64
    c = {"ax": F.col("x"), "ay": F.col("y"), "az": F.col("z"), "bx": F.col("x") + d, "by": F.col("y"), "bz": F.col("z"), "cx": F.col("x"), "cy": F.col("y") + d, "cz": F.col("z") + d}
    cell = octree.cell_of(fx.UNIT, F.lit(level), F.col("x"), F.col("y"), F.col("z"))
    return p.select(F.lit(level).cast("long").alias("level"), cell.alias("index"), *[v.alias(k) for k, v in c.items()])


_TRI = f"t5 AS (SELECT DISTINCT {', '.join(f'{v} AS {k}' for k, v in _SNAP.items())} FROM pt), tr AS (SELECT {fx.sql_cell(5)} AS index, 0.0::DOUBLE AS error, x AS ax, y AS ay, z AS az, x + 1 / 64.0::DOUBLE AS bx, y AS \"by\", z AS bz, x AS cx, y + 1 / 64.0::DOUBLE AS cy, z + 1 / 64.0::DOUBLE AS cz FROM t5)"


def _q(c: str) -> str:
    return '"by"' if c == "by" else c


def _level(source: str, name: str, level: int) -> str:
    """The triangles of a level from those of the next finer one."""
    cell = 2.0 / 2**level / 64 * 16
    pts = " UNION ".join(f"SELECT index, {_q(k + 'x')} AS x, {_q(k + 'y')} AS y, {_q(k + 'z')} AS z FROM {source}" for k in "abc")
    join = " ".join(f"JOIN mv_{name} {k} ON t.{_q(k + 'x')} = {k}.x AND t.{_q(k + 'y')} = {k}.y AND t.{_q(k + 'z')} = {k}.z" for k in "abc")
    p = {k: f"{{'x': {k}.tx, 'y': {k}.ty, 'z': {k}.tz}}" for k in "abc"}
    return f"""us_{name} AS ({pts}), lk_{name} AS (SELECT x, y, z, count(DISTINCT index >> 3) > 1 AS locked FROM us_{name} GROUP BY ALL),
ml_{name} AS (SELECT floor(x / {cell!r}) AS gx, floor(y / {cell!r}) AS gy, floor(z / {cell!r}) AS gz, avg(x) AS tx, avg(y) AS ty, avg(z) AS tz FROM lk_{name} WHERE NOT locked GROUP BY ALL),
mv_{name} AS (SELECT x, y, z, CASE WHEN locked THEN x ELSE tx END AS tx, CASE WHEN locked THEN y ELSE ty END AS ty, CASE WHEN locked THEN z ELSE tz END AS tz FROM lk_{name} LEFT JOIN ml_{name} ON floor(x / {cell!r}) = gx AND floor(y / {cell!r}) = gy AND floor(z / {cell!r}) = gz),
sn_{name} AS (SELECT index >> 3 AS index, error, {p['a']} AS a, {p['b']} AS b, {p['c']} AS c FROM {source} t {join}),
or_{name} AS (SELECT index, CASE WHEN a = least(a, b, c) THEN [a, b, c] WHEN b = least(a, b, c) THEN [b, c, a] ELSE [c, a, b] END AS f, error FROM sn_{name} WHERE a <> b AND b <> c AND a <> c),
{name} AS (SELECT index, max(error) + {cell * 3**0.5!r} AS error, {", ".join(f"f[{i + 1}].{q} AS {_q(k + q)}" for i, k in enumerate("abc") for q in "xyz")} FROM or_{name} GROUP BY index, f)"""


_LEVELS = f"{PT}, {_TRI}, {_level('tr', 't4', 4)}, {_level('t4', 't3', 3)}, {_level('t3', 't2', 2)}"


def _built(spark, sf, path=None):
    return build.build_levels(triangles(spark, sf, 5), fx.UNIT, 5, 2, size=16, cells=4.0, path=path)


_AVG = ", ".join(f"round(least(min(ax), min(bx), min(cx)), 6) + 0.0 AS lo_x, round(greatest(max(az), max(bz), max(cz)), 6) + 0.0 AS hi_z" for _ in [0])


@query("lod_full_build", f"{_LEVELS} " + " UNION ALL ".join(f"SELECT CAST({lv} AS BIGINT) AS level, index, count(*) AS n, CAST(ceil(count(*) / 16.0) AS BIGINT) AS clusters, {_AVG}, round(max(error), 6) + 0.0 AS error FROM {t} GROUP BY index" for lv, t in ((5, "tr"), (4, "t4"), (3, "t3"), (2, "t2"))))
def _(spark, sf):
    b = _built(spark, sf)
    n = b.groupBy("level", "index").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("clusters"), F.min("lo_x").alias("lo_x"), F.max("hi_z").alias("hi_z"), F.max("error").alias("error"))
    return n.select("level", "index", "n", "clusters", *[c.alias(k) for c, k in zip(rounded(F.col("lo_x"), F.col("hi_z"), F.col("error")), ("lo_x", "hi_z", "error"), strict=True)])


@query("lod_resumed_build", f"{_LEVELS} SELECT CAST(2 AS BIGINT) AS level, index, count(*) AS n FROM t2 GROUP BY index")
def _(spark, sf):
    """Built up to level 3, then again from what is stored, down to level 2."""
    path = fresh_dir(spark, "lod")
    build.build_levels(triangles(spark, sf, 5), fx.UNIT, 5, 3, size=16, cells=4.0, path=path)
    return _built(spark, sf, path).filter("level = 2").groupBy("level", "index").agg(F.sum("n").alias("n"))


_MEETS = " AND ".join(f"t.lo_{a} <= s.hi_{a} AND t.hi_{a} >= s.lo_{a}" for a in "xyz")


def _sb(level: int, k: int) -> str:
    c, size = fx.sql_coord("index", k, level), 2.0 / 2**level
    a = "xyz"[k]
    return f"(-1 + {c} * {size!r}::DOUBLE) AS lo_{a}, (-1 + ({c} + 1) * {size!r}::DOUBLE) AS hi_{a}"


def _tb(k: int) -> str:
    c, a = fx.sql_coord("index", k, 3), "xyz"[k]
    return f"(-1 + {c} * 0.25::DOUBLE - CASE WHEN {c} > 0 THEN 0.125 ELSE 0 END) AS lo_{a}, (-1 + ({c} + 1) * 0.25::DOUBLE - CASE WHEN {c} < 7 THEN 0.125 ELSE 0 END) AS hi_{a}"


@query("relevant_inputs", f"{_TARGETS}, tb AS (SELECT index, {', '.join(_tb(k) for k in range(3))} FROM tg), i2 AS (SELECT * FROM inp UNION SELECT 2, index >> 6 FROM inp WHERE level = 4 AND index % 5 = 0), sb AS ({' UNION ALL '.join(f'SELECT level, index, {_sb(lv, 0)}, {_sb(lv, 1)}, {_sb(lv, 2)} FROM i2 WHERE level = {lv}' for lv in (2, 3))}) SELECT t.index AS target, CAST(s.level AS BIGINT) AS level, s.index FROM tb t JOIN sb s ON {_MEETS}")
def _(spark, sf):
    from massif.operators import lod

    i = _inputs(spark, sf)
    more = i.union(i.filter("level = 4 and index % 5 = 0").select(F.lit(2).cast("long").alias("level"), F.shiftright("index", 6).alias("index"))).distinct()
    return build.relevant_inputs(lod.level_targets(i, i, 3), more, fx.UNIT, 3, coarser=True)


_NEAR = " AND ".join(f"-1 + {fx.sql_coord('index', k, 5)} * 0.0625::DOUBLE <= {h} AND -1 + ({fx.sql_coord('index', k, 5)} + 1) * 0.0625::DOUBLE >= {lo}" for k, (lo, h) in enumerate(((-0.25, 0.1), (-0.3, 0.125), (-0.2, 0.2))))


@query("gather_leaves", f"{PT}, {fx.LEAF} SELECT level, index FROM leaf WHERE {_NEAR}")
def _(spark, sf):
    ix = closure(fx.leaves(spark, sf))
    return build.gather_leaves(ix, fx.UNIT, (-0.25, -0.3, -0.2), (0.1, 0.125, 0.2), 5).select("level", "index")


@query("find_clusters", f"{PT}, {_TRI} SELECT index, count(*) AS n FROM tr GROUP BY index HAVING round(avg((ax + bx + cx) / 3), 9) >= -0.25 AND round(avg((ax + bx + cx) / 3), 9) < 0.125")
def _(spark, sf):
    t = triangles(spark, sf, 5).withColumns({"cluster": F.lit(0).cast("long"), "error": F.lit(0.0)})
    c = build.cluster_table(t, 4).withColumns({f"c{a}": F.round(f"c{a}", 9) for a in "xyz"})
    return build.find_clusters(c, build.inside_bounds((-0.25, -9.0, -9.0), (0.125, 9.0, 9.0))).select("index", "n")


_CORNERS = " UNION ALL ".join(f"SELECT index, ax, ay, az, {k}x AS x, {_q(k + 'y')} AS y, {k}z AS z FROM tr" for k in "abc")


@query("merged_groups", f"{PT}, {_TRI}, v AS ({_CORNERS}) SELECT index, CAST(count(DISTINCT (x, y, z)) AS BIGINT) AS vertices, count(DISTINCT (ax, ay, az)) AS triangles FROM v GROUP BY index")
def _(spark, sf):
    m = build.merged_groups(triangles(spark, sf, 5).withColumn("cluster", F.lit(0).cast("long")), 4)
    return m.groupBy("index").agg(F.count_if(F.col("kind") == "vertex").alias("vertices"), F.count_if(F.col("kind") == "triangle").alias("triangles"))


@query("locked_corners", f"""{PT}, {_TRI}, c AS (SELECT index, floor(ax * 64)::BIGINT % 2 AS cluster, ax, ay, az, bx, "by", bz, cx, cy, cz FROM tr), v AS (SELECT index, cluster, ax AS x, ay AS y, az AS z FROM c UNION SELECT index, cluster, bx, "by", bz FROM c UNION SELECT index, cluster, cx, cy, cz FROM c),
s AS (SELECT index, x, y, z FROM v GROUP BY ALL HAVING count(*) > 1), sd AS (SELECT index, least({{'x': ax, 'y': ay, 'z': az}}, {{'x': bx, 'y': "by", 'z': bz}}) AS p, greatest({{'x': ax, 'y': ay, 'z': az}}, {{'x': bx, 'y': "by", 'z': bz}}) AS q FROM c
  UNION ALL SELECT index, least({{'x': bx, 'y': "by", 'z': bz}}, {{'x': cx, 'y': cy, 'z': cz}}), greatest({{'x': bx, 'y': "by", 'z': bz}}, {{'x': cx, 'y': cy, 'z': cz}}) FROM c UNION ALL SELECT index, least({{'x': ax, 'y': ay, 'z': az}}, {{'x': cx, 'y': cy, 'z': cz}}), greatest({{'x': ax, 'y': ay, 'z': az}}, {{'x': cx, 'y': cy, 'z': cz}}) FROM c),
r AS (SELECT index, unnest([p, q]) AS p FROM (SELECT index, p, q FROM sd GROUP BY ALL HAVING count(*) = 1)), n AS (SELECT DISTINCT index, p.x AS x, p.y AS y, p.z AS z FROM r)
SELECT index, x, y, z FROM s UNION SELECT index, x, y, z FROM n WHERE {" OR ".join(f"{a} <= -1 + {fx.sql_coord('index', k, 5)} * 0.0625::DOUBLE + 0.003125::DOUBLE OR {a} >= -1 + ({fx.sql_coord('index', k, 5)} + 1) * 0.0625::DOUBLE - 0.003125::DOUBLE" for k, a in enumerate("xyz"))}""")
def _(spark, sf):
    t = triangles(spark, sf, 5).withColumn("cluster", F.floor(F.col("ax") * 64) % 2)
    return build.lock_at_border(t, t, fx.UNIT, 5, 0.05).select("index", "p.x", "p.y", "p.z")


@query("texel_demand", """WITH c AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS area, (p_partkey % 13) / 10.0::DOUBLE AS uv, 64 << CAST(p_size % 3 AS INTEGER) AS w FROM part), d AS (SELECT p_partkey, area, least(uv, 1.0::DOUBLE) AS utilisation, w FROM c),
s AS (SELECT *, CASE WHEN area > 0 THEN utilisation * w * 128 / area ELSE 0 END AS source_density FROM d) SELECT p_partkey, utilisation, round(source_density, 6) AS source_density, CAST(least(ceil(least(source_density, 900.5::DOUBLE) * area), 4096) AS BIGINT) AS texels FROM s""")
def _(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    c = fx.read(spark, sf, "part").select(k, (s / 10).alias("area"), ((k % 13) / 10).alias("uv_area"), F.call_function("shiftleft", F.lit(64), (s % 3).cast("int")).alias("texture_w"), F.lit(128).alias("texture_h"))
    return build.texel_demand(c, F.lit(900.5), 4096).select("p_partkey", "utilisation", F.round("source_density", 6).alias("source_density"), "texels")


# Output triangles twice the size of the sources, in the same plane: grids over the points' places.


def _flat(spark, sf, step: int):
    p = fx.points(spark, sf).select(*[F.floor(F.col(a) * 8).cast("long").alias(a) for a in "xy"]).distinct()
    if step > 1:
        p = p.select(*[(F.floor(F.col(a) / step) * step).alias(a) for a in "xy"]).distinct()
    c = {"ax": F.col("x"), "ay": F.col("y"), "bx": F.col("x") + step, "by": F.col("y"), "cx": F.col("x") + step, "cy": F.col("y") + step}
    return p.select((F.col("x") * 1000 + F.col("y")).alias("id"), *[v.cast("double").alias(k) for k, v in c.items()], *[F.lit(0.0).alias(f"{k}z") for k in "abc"])


_F1 = "f1 AS (SELECT DISTINCT CAST(floor(x * 8) AS BIGINT) AS x, CAST(floor(y * 8) AS BIGINT) AS y FROM pt), f2 AS (SELECT DISTINCT CAST(floor(x / 2.0) * 2 AS BIGINT) AS x, CAST(floor(y / 2.0) * 2 AS BIGINT) AS y FROM f1)"
_BELOW = "o.x <= s.x AND s.x < o.x + 2 AND o.y <= s.y AND s.y < o.y + 2 AND s.x - o.x >= s.y - o.y"


@query("triangle_correspondence", f"{PT}, {_F1} SELECT o.x * 1000 + o.y AS out_id, s.x * 1000 + s.y AS source_id FROM f2 o JOIN f1 s ON {_BELOW}")
def _(spark, sf):
    return build.correspond(_flat(spark, sf, 2), _flat(spark, sf, 1), 2.0)


@query("texture_fragments", f"{PT}, {_F1} SELECT o.x * 1000 + o.y AS out_id, s.x * 1000 + s.y AS source_id, 0.5::DOUBLE AS area, 0.25::DOUBLE AS share FROM f2 o JOIN f1 s ON {_BELOW}")
def _(spark, sf):
    out, source = _flat(spark, sf, 2), _flat(spark, sf, 1)
    pairs = stash(build.correspond(out, source, 2.0), "correspondence")
    for n, d in (("out", out), ("source", source)):
        pairs = pairs.join(d.select(F.col("id").alias(f"{n}_id"), F.array(*[build.corner(k) for k in "abc"]).alias(n)), f"{n}_id")
    return build.fragments(pairs).select("out_id", "source_id", F.round("area", 9).alias("area"), F.round("share", 9).alias("share"))


@query("texture_trim", f"""{PT}, b AS (SELECT label, min(abs(x)) AS lo_u, max(abs(x)) AS hi_u, min(abs(y)) AS lo_v, max(abs(y)) AS hi_v FROM pt GROUP BY label),
r AS (SELECT label AS id, CAST(greatest(floor(lo_u * 512) - 2, 0) AS BIGINT) AS x, CAST(greatest(floor(lo_v * 256) - 2, 0) AS BIGINT) AS y, CAST(least(ceil(hi_u * 512) + 2, 512) AS BIGINT) AS x1, CAST(least(ceil(hi_v * 256) + 2, 256) AS BIGINT) AS y1 FROM b)
SELECT id, x, y, greatest(x1 - x, 1) AS w, greatest(y1 - y, 1) AS h, round(512.0 / greatest(x1 - x, 1), 6) AS scale_u, round(-y / greatest(y1 - y, 1)::DOUBLE, 6) + 0.0 AS move_v FROM r""".replace("round(512.0 /", "round(512.0::DOUBLE /"))
def _(spark, sf):
    uv = fx.points(spark, sf).select(F.col("label").alias("id"), F.abs("x").alias("u"), F.abs("y").alias("v"))
    return build.trimmed(uv, 512, 256, 2).select("id", "x", "y", "w", "h", F.round("scale_u", 6).alias("scale_u"), (F.round("move_v", 6) + 0.0).alias("move_v"))


@query("node_store_roundtrip", f"{PT}, {_TRI}, k AS (SELECT index, count(*) AS n FROM tr GROUP BY index), b AS (SELECT index FROM k ORDER BY n DESC, index LIMIT 1) SELECT CAST(5 AS BIGINT) AS level, tr.index, ax, ay, az, k.n FROM tr JOIN b USING (index) JOIN k USING (index)")
def _(spark, sf):
    """The fullest node, written with all others and read by its key."""
    t = build.clustered(triangles(spark, sf, 5).withColumn("error", F.lit(0.0)), 1000)
    path = fresh_dir(spark, "nodes")
    build.write_nodes(build.cluster_table(t, 4).withColumn("level", F.lit(5).cast("long")).withColumnsRenamed({f"c{a}": f"m{a}" for a in "xyz"}).drop("error"), t, path)
    best = build.read_clusters(spark, path).groupBy("index").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "index").first()
    return build.read_node(spark, path, 5, best["index"]).select("level", "index", "ax", "ay", "az", "n")


@query("polygon_planarity", f"{PT} SELECT id, abs(z) <= 0.1 AS planar FROM pt")
def _(spark, sf):
    from massif.operators import masks

    p = fx.points(spark, sf)
    zero = F.lit(0.0)
    quad = F.array(g.point(zero, zero, zero), g.point(F.lit(1.0), zero, zero), g.point(zero, F.lit(1.0), zero), g.point(F.col("x"), F.col("y"), F.col("z")))
    return p.select("id", masks.is_planar(quad, 0.1).alias("planar"))
