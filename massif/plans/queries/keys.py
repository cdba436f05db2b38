"""Queries on keys of octrees and quadtrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import octree, quadtree
from massif.plans import fixtures as fx
from massif.plans.registry import query, rounded
from massif.plans.shared import stash


def L():
    return F.col("level")


def I():  # noqa: E743
    return F.col("index")


DEC5 = ", ".join(f"{fx.sql_coord('index', k, 5)} AS c{n}" for k, n in enumerate("xyz"))
LEAF = f"WITH {fx.PT}, {fx.LEAF}"
LEAFC = f"WITH {fx.PT}, {fx.LEAF}, lc AS (SELECT level, index, {DEC5} FROM leaf)"
_BIG = "CAST(o_orderkey * 83 % 2097152 AS BIGINT) AS x, CAST(o_custkey * 911 % 2097152 AS BIGINT) AS y, CAST(o_orderkey * 7 % 2097152 AS BIGINT) AS z"


def _big(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return fx.read(spark, sf, "orders").select(k, (k * 83 % 2097152).alias("x"), (c * 911 % 2097152).alias("y"), (k * 7 % 2097152).alias("z"))


@query("morton_encode", f"SELECT o_orderkey, {fx.sql_morton('x', 'y', 'z', 21)} AS index FROM (SELECT o_orderkey, {_BIG} FROM orders)")
def _(spark, sf):
    return _big(spark, sf).select("o_orderkey", octree.encode(F.col("x"), F.col("y"), F.col("z")).alias("index"))


@query("morton_decode_roundtrip", f"SELECT o_orderkey, {_BIG} FROM orders")
def _(spark, sf):
    k = _big(spark, sf).select("o_orderkey", octree.encode(F.col("x"), F.col("y"), F.col("z")).alias("index"))
    return k.select("o_orderkey", *[c.alias(n) for c, n in zip(octree.decode(F.col("index")), "xyz", strict=True)])


@query("key_parent", f"{LEAF} SELECT level, index, level - 1 AS p_level, index >> 3 AS p_index FROM leaf")
def _(spark, sf):
    p = octree.parent(L(), I())
    return fx.leaves(spark, sf).select("level", "index", p[0].alias("p_level"), p[1].alias("p_index"))


@query("key_children", f"{LEAF} SELECT level + 1 AS level, index * 8 + i AS index FROM leaf, (SELECT unnest(range(0, 8)) AS i)")
def _(spark, sf):
    kids = F.explode(F.array(*[octree.child(I(), F.lit(i)) for i in range(8)]))
    return fx.leaves(spark, sf).select((L() + 1).alias("level"), kids.alias("index"))


@query("key_ancestors", f"{LEAF} SELECT index, a AS on_level, index >> CAST(3 * (level - a) AS BIGINT) AS a_index FROM leaf, (SELECT unnest(range(0, 6)) AS a)")
def _(spark, sf):
    d = fx.leaves(spark, sf).withColumn("on_level", F.explode(F.sequence(F.lit(0), L().cast("int")))).withColumn("on_level", F.col("on_level").cast("long"))
    return d.select("index", "on_level", octree.ancestor(L(), I(), F.col("on_level")).alias("a_index"))


@query("key_descendant_range", f"{LEAF} SELECT index, d AS on_level, index << CAST(3 * (d - 5) AS BIGINT) AS first, ((index + 1) << CAST(3 * (d - 5) AS BIGINT)) - 1 AS last FROM leaf, (SELECT unnest(range(5, 12)) AS d)")
def _(spark, sf):
    d = fx.leaves(spark, sf).withColumn("on_level", F.explode(F.sequence(F.lit(5), F.lit(11)))).withColumn("on_level", F.col("on_level").cast("long"))
    a, b = octree.descendants(L(), I(), F.col("on_level"))
    return d.select("index", "on_level", a.alias("first"), b.alias("last"))


@query("key_neighbours", f"""{LEAFC}, o AS (SELECT unnest([-1, 0, 1]) AS d), nb AS (
  SELECT index, cx + a.d AS x, cy + b.d AS y, cz + c.d AS z FROM lc, o a, o b, o c WHERE NOT (a.d = 0 AND b.d = 0 AND c.d = 0))
SELECT index, {fx.sql_morton('x', 'y', 'z', 5)} AS n_index FROM nb WHERE x BETWEEN 0 AND 31 AND y BETWEEN 0 AND 31 AND z BETWEEN 0 AND 31""")
def _(spark, sf):
    return fx.leaves(spark, sf).select("index", F.explode(octree.neighbours(L(), I())).alias("n_index"))


@query("key_is_ancestor", f"""{LEAF}, c AS (SELECT DISTINCT CAST(3 AS BIGINT) AS level, index >> 6 AS index FROM leaf WHERE index % 2 = 0)
SELECT c.index AS a_index, leaf.index AS index FROM c JOIN leaf ON leaf.index >> 6 = c.index""")
def _(spark, sf):
    leaf = fx.leaves(spark, sf)
    c = leaf.filter(I() % 2 == 0).select(F.lit(3).cast("long").alias("a_level"), F.shiftright("index", 6).alias("a_index")).distinct()
    # The predicate, as an equi-join on the ancestor's index and a residual check.
    j = leaf.join(c, octree.up(I(), L() - 3) == F.col("a_index"))
    return j.filter(octree.is_ancestor(F.col("a_level"), F.col("a_index"), L(), I())).select("a_index", "index")


@query("key_order_step", f"{LEAF} SELECT index, CASE WHEN index < 32767 THEN index + 1 END AS next, CASE WHEN index > 0 THEN index - 1 END AS prev, 'Id(level=5, coords=(' || {fx.sql_coord('index', 0, 5)} || ', ' || {fx.sql_coord('index', 1, 5)} || ', ' || {fx.sql_coord('index', 2, 5)} || '), index=' || index || ')' AS text FROM leaf")
def _(spark, sf):
    return fx.leaves(spark, sf).select("index", octree.following(L(), I()).alias("next"), octree.preceding(I()).alias("prev"), octree.key_text(L(), I()).alias("text"))


@query("key_rectangle", f"""{LEAFC} SELECT index, {fx.sql_morton('x', 'y', 'z', 5)} AS member FROM (
  SELECT index, cx - a AS x, cy - b AS y, cz - c AS z FROM lc, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c))
WHERE x >= 0 AND y >= 0 AND z >= 0""")
def _(spark, sf):
    low = [F.greatest(c - 1, F.lit(0)).alias(n) for c, n in zip(octree.decode(I()), "xyz", strict=True)]
    d = fx.leaves(spark, sf).select("level", "index", *low).select("level", "index", octree.encode(F.col("x"), F.col("y"), F.col("z")).alias("begin"))
    return d.select("index", F.explode(octree.rectangle(L(), F.col("begin"), I())).alias("member"))


@query("key_validate", """SELECT o_orderkey, o_orderkey % 23 AS level, CASE WHEN o_orderkey % 23 <= 21 AND o_custkey * 1000 < (CAST(1 AS HUGEINT) << CAST(3 * (o_orderkey % 23) AS INTEGER)) THEN TRUE ELSE FALSE END AS ok FROM orders""")
def _(spark, sf):
    level = F.col("o_orderkey") % 23
    return fx.read(spark, sf, "orders").select("o_orderkey", level.alias("level"), octree.valid(level, F.col("o_custkey") * 1000).alias("ok"))


@query("cell_bounds", f"{LEAFC} SELECT index, " + ", ".join(f"round(-1 + (c{a} + {k}) * (2.0 / 32), 6) + 0.0 AS {n}_{a}" for n, k in (("lo", 0), ("hi", 1)) for a in "xyz") + " FROM lc")
def _(spark, sf):
    b = rounded(*octree.cell_bounds(fx.UNIT, L(), I()))
    return fx.leaves(spark, sf).select("index", *[c.alias(f"{n}_{a}") for c, (n, a) in zip(b, [(n, a) for n in ("lo", "hi") for a in "xyz"], strict=True)])


_LEVELS = "(SELECT unnest(range(0, 8)) AS level)"


def sql_at_level(p: str, shift: str = "0.0") -> str:
    return f"CAST(floor(({p} + 1) / (2.0 / (1 << CAST(level AS INTEGER))) + {shift}) AS BIGINT)"


@query("point_to_cell", f"WITH {fx.PT} SELECT id, level, {fx.sql_morton(*[sql_at_level(a) for a in 'xyz'], 8)} AS index FROM pt, {_LEVELS}")
def _(spark, sf):
    p = fx.points(spark, sf).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("level", F.col("level").cast("long"))
    return p.select("id", "level", octree.cell_of(fx.UNIT, L(), *[F.col(a) for a in "xyz"]).alias("index"))


_SH = [f"least({sql_at_level(a, 'CASE WHEN level % 2 = 1 THEN 0.5 ELSE 0.0 END')}, (1 << CAST(level AS INTEGER)) - 1)" for a in "xyz"]


@query("shifted_point_to_cell", f"WITH {fx.PT} SELECT id, level, {fx.sql_morton('x', 'y', 'z', 8)} AS index FROM (SELECT id, level, {_SH[0]} AS x, {_SH[1]} AS y, {_SH[2]} AS z FROM pt, {_LEVELS})")
def _(spark, sf):
    p = fx.points(spark, sf).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("level", F.col("level").cast("long"))
    return p.select("id", "level", octree.shifted_cell_of(fx.UNIT, L(), *[F.col(a) for a in "xyz"]).alias("index"))


@query("shifted_cell_bounds", f"{LEAFC} SELECT index, " + ", ".join(f"round(-1 + (c{a} - CASE WHEN c{a} > 0 THEN 0.5 ELSE 0 END) * (2.0 / 32), 6) + 0.0 AS lo_{a}, round(-1 + (c{a} + 1 - CASE WHEN c{a} < 31 THEN 0.5 ELSE 0 END) * (2.0 / 32), 6) + 0.0 AS hi_{a}" for a in "xyz") + " FROM lc")
def _(spark, sf):
    b = rounded(*octree.shifted_bounds(fx.UNIT, L(), I()))
    return fx.leaves(spark, sf).select("index", *[c.alias(f"{n}_{a}") for c, (n, a) in zip(b, [(n, a) for n in ("lo", "hi") for a in "xyz"], strict=True)])


@query("shifted_to_standard_cells", f"""{LEAFC} SELECT DISTINCT index, {fx.sql_morton('x', 'y', 'z', 5)} AS s_index FROM (
  SELECT index, greatest(cx - a, 0) AS x, greatest(cy - b, 0) AS y, greatest(cz - c, 0) AS z FROM lc, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c))""")
def _(spark, sf):
    return fx.leaves(spark, sf).select("index", F.explode(octree.shifted_to_standard(L(), I())).alias("s_index"))


@query("standard_to_shifted_cells", f"""{LEAFC} SELECT DISTINCT index, {fx.sql_morton('x', 'y', 'z', 5)} AS s_index FROM (
  SELECT index, least(cx + a, 31) AS x, least(cy + b, 31) AS y, least(cz + c, 31) AS z FROM lc, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c))""")
def _(spark, sf):
    return fx.leaves(spark, sf).select("index", F.explode(octree.standard_to_shifted(L(), I())).alias("s_index"))


def _shrunk(level: int) -> str:
    m = f"(2.0 / {2**level} / 1024)"
    return ", ".join(f"lo_{a} + {m} AS l{a}, hi_{a} - {m} AS h{a}" for a in "xyz")


_C4 = ", ".join(f"{fx.sql_at('l' + a, 4)} AS a{a}, {fx.sql_at('h' + a, 4)} AS b{a}" for a in "xyz")


@query("box_cover", f"""WITH {fx.PT}, {fx.BOX}, s AS (SELECT label, {_shrunk(4)} FROM bx),
k AS (SELECT label, {_C4} FROM s WHERE lx >= -1 AND ly >= -1 AND lz >= -1 AND hx < 1 AND hy < 1 AND hz < 1 AND lx < 1 AND ly < 1 AND lz < 1 AND hx >= -1 AND hy >= -1 AND hz >= -1),
e AS (SELECT label, x, y, z FROM k, (SELECT unnest(range(0, 16)) AS x), (SELECT unnest(range(0, 16)) AS y), (SELECT unnest(range(0, 16)) AS z)
  WHERE x BETWEEN ax AND bx AND y BETWEEN ay AND k.by AND z BETWEEN az AND bz)
SELECT label, {fx.sql_morton('x', 'y', 'z', 4)} AS index FROM e""".replace("bx AND y", "k.bx AND y").replace("AND k.by", "AND k.by").replace("AND bz)", "AND k.bz)"))
def _(spark, sf):
    b = fx.boxes(spark, sf)
    cover = octree.box_cover(fx.UNIT, F.lit(4), [F.col(f"lo_{a}") for a in "xyz"], [F.col(f"hi_{a}") for a in "xyz"])
    return b.select("label", F.explode(cover).alias("index"))


_SM = " UNION ALL ".join(f"SELECT id, {l} AS level, {fx.sql_cell(l)} AS a, {fx.sql_cell(l, 'x2', 'y2', 'z2')} AS b FROM q" for l in range(0, 13))


@query("smallest_enclosing_cell", f"""WITH {fx.PT}, q AS (SELECT id, x, y, z, least(x + 0.01 * (id % 7), 0.999) AS x2, least(y + 0.01, 0.999) AS y2, least(z + 0.001 * (id % 3), 0.999) AS z2 FROM pt)
SELECT id, CAST(max(level) AS BIGINT) AS level FROM ({_SM}) WHERE a = b GROUP BY id""")
def _(spark, sf):
    k = F.col("id")
    p = fx.points(spark, sf).withColumns({"x2": F.least(F.col("x") + 0.01 * (k % 7), F.lit(0.999)), "y2": F.least(F.col("y") + 0.01, F.lit(0.999)), "z2": F.least(F.col("z") + 0.001 * (k % 3), F.lit(0.999))})
    return p.select("id", octree.enclosing_level(fx.UNIT, [F.col(a) for a in "xyz"], [F.col(f"{a}2") for a in "xyz"], 12).cast("long").alias("level"))


@query("path_layouts", f"""{LEAFC} SELECT index, level || '-' || index AS flat, level || '/' || cx || '/' || cy || '/' || cz AS nested, level AS p_level, index AS p_index, cz AS p_z FROM lc""")
def _(spark, sf):
    d = fx.leaves(spark, sf).select("index", quadtree.flat_path(L(), I()).alias("flat"), quadtree.nested_path(L(), *octree.decode(I())).alias("nested"))
    a, b = quadtree.parse_flat(F.col("flat"))
    return d.select("index", "flat", "nested", a.alias("p_level"), b.alias("p_index"), quadtree.parse_nested(F.col("nested"), 4)[3].alias("p_z"))


@query("quadtree_parent_children", f"""WITH {fx.QK} SELECT zoom - 1 AS p_zoom, x >> 1 AS p_x, y >> 1 AS p_y, zoom + 1 AS c_zoom, 2 * x + i AS c_x, 2 * y + j AS c_y
FROM qk, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)""")
def _(spark, sf):
    z, x, y = F.col("zoom"), F.col("x"), F.col("y")
    p = [c.alias(f"p_{n}") for c, n in zip(quadtree.parent(z, x, y), ("zoom", "x", "y"), strict=True)]
    d = fx.quad_keys(spark, sf).filter(quadtree.valid(z, x, y)).select(*p, F.explode(quadtree.children(z, x, y)).alias("c"))
    return d.select("p_zoom", "p_x", "p_y", *[F.col(f"c.{n}").alias(f"c_{n}") for n in ("zoom", "x", "y")])


@query("tile_bounds", f"WITH {fx.QK} SELECT zoom, x, y, " + ", ".join(f"round(({a} + {k}) * (2 * 20037508.342789244 / 64) - 20037508.342789244, 6) + 0.0 AS {n}_{a}" for n, k in (("lo", 0), ("hi", 1)) for a in "xy") + " FROM qk")
def _(spark, sf):
    b = rounded(*quadtree.tile_bounds(F.col("zoom"), F.col("x"), F.col("y")))
    return fx.quad_keys(spark, sf).select("zoom", "x", "y", *[c.alias(n) for c, n in zip(b, ("lo_x", "lo_y", "hi_x", "hi_y"), strict=True)])


@query("url_template_tms", f"WITH {fx.QK} SELECT 'https://tiles.test/' || zoom || '/' || x || '/' || y || '.jpeg' AS url, 'https://tiles.test/' || zoom || '/' || x || '/' || (63 - y) || '.jpeg' AS tms FROM qk")
def _(spark, sf):
    t, at = "https://tiles.test/{zoom}/{x}/{y}.jpeg", (F.col("zoom"), F.col("x"), F.col("y"))
    return fx.quad_keys(spark, sf).select(quadtree.url_of(t, *at).alias("url"), quadtree.url_of(t, *at, tms=True).alias("tms"))


@query("morton_range_scan", f"{LEAFC} SELECT index FROM lc WHERE " + " AND ".join(f"-1 + c{a} * (2.0 / 32) < {h} AND -1 + (c{a} + 1) * (2.0 / 32) > {l}" for a, l, h in (("x", -0.1, 0.2), ("y", -0.15, 0.1), ("z", 0.0, 0.3))))
def _(spark, sf):
    low, high = (-0.1, -0.15, 0.0), (0.2, 0.1, 0.3)
    b = octree.cell_bounds(fx.UNIT, L(), I())
    exact = F.lit(True)
    for k in range(3):
        exact = exact & (b[k] < high[k]) & (b[k + 3] > low[k])
    # A stored index: the ranges reach the Parquet scan.
    return stash(fx.leaves(spark, sf), "leaves").filter(octree.in_ranges(I(), octree.morton_ranges(fx.UNIT, 5, low, high)) & exact).select("index")
