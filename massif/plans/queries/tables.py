"""Queries on containers as tables and on whole meshes as tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from massif.functions import containers as c
from massif.operators import mesh
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import _OR, _REACH, PLACED, H, M, V, tri
from massif.plans.registry import query


def lines(spark, sf):
    li = fx.read(spark, sf, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 5000).cast("long").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


_SIZES = "WITH z AS (SELECT CAST(l_orderkey % 5000 AS BIGINT) AS segment, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT segment, n, CAST(sum(n) OVER (ORDER BY segment) - n AS BIGINT) AS first FROM z)"


@query("offset_table", f"{_SIZES} SELECT * FROM o")
def _(spark, sf):
    return c.offsets(lines(spark, sf))


@query("offset_locate", f"{_SIZES}, f AS (SELECT CAST(p_partkey * 3 AS BIGINT) AS i FROM part) SELECT f.i, segment, f.i - first AS local FROM f JOIN o ON f.i >= first AND f.i < first + n")
def _(spark, sf):
    return c.locate(fx.read(spark, sf, "part").select((F.col("p_partkey") * 3).alias("i")), c.offsets(lines(spark, sf)))


@query("segmented_arrays", """WITH a AS (SELECT l_suppkey AS k, list(l_orderkey ORDER BY l_orderkey, l_linenumber) FILTER (WHERE l_linenumber = 6) AS six, list(l_orderkey ORDER BY l_orderkey, l_linenumber) FILTER (WHERE l_linenumber = 7) AS seven FROM lineitem GROUP BY 1)
SELECT k, list_filter([coalesce(six, []), list_append(coalesce(seven, []), k)], x -> len(x) > 0) AS segments FROM a""".replace("x -> len(x) > 0", "lambda x: len(x) > 0"))
def _(spark, sf):
    rows = F.sort_array(F.collect_list(F.when(F.col("l_linenumber").isin(6, 7), F.struct("l_orderkey", "l_linenumber"))))
    g = fx.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(rows.alias("r"))


    def of(n: int):
        return F.transform(F.filter("r", lambda s: s["l_linenumber"] == n), lambda s: s["l_orderkey"])

    part = [of(6), of(7)]
    return g.select("k", c.drop_empty(c.push_last(F.array(*part), F.col("k"))).alias("segments"))


@query("pair_map", "WITH m AS (SELECT l_partkey % 50 AS i, l_suppkey % 20 AS j, sum(l_quantity)::BIGINT AS value FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2) SELECT p.p_partkey, CAST(p.p_partkey % 50 AS BIGINT) AS i, CAST(p.p_size % 20 AS BIGINT) AS j, coalesce(m.value, -1) AS value FROM part p LEFT JOIN m ON m.i = p.p_partkey % 50 AND m.j = p.p_size % 20")
def _(spark, sf):
    m = fx.read(spark, sf, "lineitem").filter("l_linenumber < 4").groupBy((F.col("l_partkey") % 50).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.sum("l_quantity").cast("long").alias("value"))
    p = fx.read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("i"), (F.col("p_size") % 20).cast("long").alias("j"))
    return c.pair_lookup(p, m, default=F.lit(-1).cast("long")).select("p_partkey", "i", "j", "value")


@query("visited_set", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)")
def _(spark, sf):
    seen = fx.read(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return c.unvisited(fx.read(spark, sf, "part").select("p_partkey"), seen, ["p_partkey"])


@query("coverage_bitmap", f"WITH {fx.PX} SELECT py, CAST(px // 32 AS BIGINT) AS word, CAST(bit_or(CAST(1 AS BIGINT) << px % 32) AS BIGINT) AS bits FROM px WHERE valid GROUP BY 1, 2")
def _(spark, sf):
    return c.bitmap(fx.pixels(spark, sf).filter("valid"), "px", "py")


@query("array_helpers", """WITH a AS (SELECT l_suppkey AS k, list(l_linenumber ORDER BY l_orderkey, l_linenumber) AS v FROM lineitem GROUP BY 1)
SELECT k, list_sort(list_distinct(v)) AS distinct_sorted, CAST(list_position(v, 7) - 1 AS BIGINT) AS at, CASE WHEN len(list_filter(v, lambda x: x = 7)) = 1 THEN 7 END AS single, CAST(list_sum(v) AS BIGINT) AS total FROM a""")
def _(spark, sf):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))), lambda s: s["l_linenumber"])
    g = fx.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(rows.alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x)
    return g.select("k", c.dedup_sorted(F.col("v")).alias("distinct_sorted"), c.index_of(F.col("v"), F.lit(7)).cast("long").alias("at"), c.find_single(F.col("v"), lambda x: x == 7).cast("int").alias("single"), total.alias("total"))


# Meshes

_TID = "tt AS (SELECT *, CAST(row_number() OVER (ORDER BY a, b, c) - 1 AS BIGINT) AS tid FROM tri)"


def numbered(spark, sf):
    blk = F.floor(F.col("a") / 4096)
    t = tri(spark, sf).withColumn("blk", blk)
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("blk").orderBy("a", "b", "c")))
    base = t.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).select("blk", (F.sum("n").over(Window.orderBy("blk")) - F.col("n")).alias("base"))
    return r.join(base, "blk").select((F.col("base") + F.col("r") - 1).alias("tid"), "a", "b", "c")


@query("edge_triangles", f"{M}, {_TID}, he AS (SELECT a AS u, b AS v, tid FROM tt UNION ALL SELECT b, c, tid FROM tt UNION ALL SELECT c, a, tid FROM tt) SELECT least(u, v) AS u, greatest(u, v) AS v, list_sort(list(DISTINCT tid)) AS triangles FROM he GROUP BY 1, 2")
def _(spark, sf):
    return mesh.edge_triangles(numbered(spark, sf))


_P = {k: f"{{'x': {k}x, 'y': {k}y, 'z': {k}z}}" if k != "b" else "{'x': bx, 'y': \"by\", 'z': bz}" for k in "abc"}
_TURN = f"CASE WHEN {_P['a']} = least({_P['a']}, {_P['b']}, {_P['c']}) THEN [{_P['a']}, {_P['b']}, {_P['c']}] WHEN {_P['b']} = least({_P['a']}, {_P['b']}, {_P['c']}) THEN [{_P['b']}, {_P['c']}, {_P['a']}] ELSE [{_P['c']}, {_P['a']}, {_P['b']}] END"


@query("triangle_soup", f"{PLACED}, s AS (SELECT {_TURN} AS p FROM pl) SELECT p[1].x AS x1, p[1].y AS y1, p[2].x AS x2, p[2].y AS y2, p[3].x AS x3, p[3].z AS z3, count(*) AS n FROM s GROUP BY p")
def _(spark, sf):
    s = mesh.soup(tri(spark, sf), fx.vertices(spark, sf))
    return s.select(*[F.col("p")[i][p].alias(f"{p}{i + 1}") for i, p in ((0, "x"), (0, "y"), (1, "x"), (1, "y"), (2, "x"), (2, "z"))], "n")


@query("meshes_equal", f"{M} SELECT a, b, c FROM tri WHERE a % 97 = 3")
def _(spark, sf):
    t, v = tri(spark, sf), fx.vertices(spark, sf)
    renamed = t.filter("a % 97 <> 3").select((F.col("b") + 5000).alias("a"), (F.col("c") + 5000).alias("b"), (F.col("a") + 5000).alias("c"))
    odd = mesh.same_shape((t, v), (renamed, v.withColumn("vid", F.col("vid") + 5000))).filter("side = 'left'").select("p")
    ids = mesh.placed(t, v).select("a", "b", "c", mesh.oriented(*[F.struct(*[F.col(f"{k}{p}").alias(p) for p in "xyz"]) for k in "abc"]).alias("p"))
    return ids.join(odd, "p", "left_semi").select("a", "b", "c")


_NRM = ", ".join(f"{n} AS n{p}" for p, n in zip("xyz", ("(\"by\" - ay) * (cz - az) - (bz - az) * (cy - ay)", "(bz - az) * (cx - ax) - (bx - ax) * (cz - az)", "(bx - ax) * (cy - ay) - (\"by\" - ay) * (cx - ax)"), strict=True))


@query("dedup_by_normal", f"""{V}, du AS (SELECT a, b, c FROM tri UNION ALL SELECT a, c, b FROM tri WHERE a % 5 = 0 UNION ALL SELECT b, c, a FROM tri WHERE a % 3 = 0),
pl AS (SELECT du.a, du.b, du.c, {", ".join(f'v{k}.{p} AS "{k}{p}"' for k in "abc" for p in "xyz")} FROM du{"".join(f" JOIN vert v{k} ON v{k}.vid = du.{k}" for k in "abc")}),
t AS (SELECT DISTINCT {_OR} AS t, {_NRM} FROM pl), m AS (SELECT vid, sum(nx) AS mx, sum(ny) AS my, sum(nz) AS mz FROM (SELECT unnest(t) AS vid, nx, ny, nz FROM t) GROUP BY vid),
s AS (SELECT t, any_value(list_sort(t)) AS k, sum(nx * mx + ny * my + nz * mz) AS d FROM (SELECT t, unnest(t) AS vid, nx, ny, nz FROM t) q JOIN m ON q.vid = m.vid GROUP BY t),
r AS (SELECT t, row_number() OVER (PARTITION BY k ORDER BY -round(d, 9), t) AS n FROM s) SELECT t[1] AS a, t[2] AS b, t[3] AS c FROM r WHERE n = 1""")
def _(spark, sf):
    t = tri(spark, sf)
    both = t.union(t.filter("a % 5 = 0").select("a", "c", "b")).union(t.filter("a % 3 = 0").select("b", "c", "a"))
    return mesh.deduplicated_by_normal(both, fx.vertices(spark, sf))


_USE = f"{_TID}, us AS (SELECT vid, CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS BIGINT) AS new FROM (SELECT tid * 3 AS pos, a AS vid FROM tt UNION ALL SELECT tid * 3 + 1, b FROM tt UNION ALL SELECT tid * 3 + 2, c FROM tt) GROUP BY vid)"


@query("reindex_first_use", f"{M}, {_USE} SELECT * FROM us")
def _(spark, sf):
    return mesh.first_use(numbered(spark, sf))


@query("isolated_removed", f"{V}, {_USE} SELECT us.new AS vid, x, y, z FROM vert JOIN us ON vert.vid = us.vid")
def _(spark, sf):
    return mesh.compact(fx.vertices(spark, sf), numbered(spark, sf))[0]


@query("compact_triangles", f"{M}, {_USE} SELECT tid, p.new AS a, q.new AS b, r.new AS c FROM tt JOIN us p ON tt.a = p.vid JOIN us q ON tt.b = q.vid JOIN us r ON tt.c = r.vid")
def _(spark, sf):
    return mesh.compact(fx.vertices(spark, sf), numbered(spark, sf))[1]


@query("split_by_vertex", f"{M} SELECT a // 320 AS \"group\", a, b, c FROM tri WHERE a // 320 = b // 320 AND b // 320 = c // 320")
def _(spark, sf):
    groups = fx.vertices(spark, sf).select("vid", F.floor(F.col("vid") / 320).alias("group"))
    return mesh.split_by_vertex(tri(spark, sf), groups)


@query("split_by_triangle", f"{V}, g AS (SELECT a // 320 AS \"group\", unnest([a, b, c]) AS vid FROM tri) SELECT DISTINCT \"group\", vert.* FROM g JOIN vert ON g.vid = vert.vid")
def _(spark, sf):
    return mesh.split_by_triangle(tri(spark, sf).withColumn("group", F.floor(F.col("a") / 320)), fx.vertices(spark, sf))[0]


for _name, _keep in (("mesh_intersection", True), ("mesh_difference", False)):
    def _set(spark, sf, keep=_keep):
        t = tri(spark, sf)
        return mesh.set_operation(t, t.filter("a % 2 = 0").select("a", "c", "b").toDF("a", "b", "c"), keep=keep)

    query(_name, f"{M} SELECT a, b, c FROM tri WHERE a % 2 {'=' if _keep else '<>'} 0")(_set)


@query("topology_by_component", f"""{H.replace('WITH', 'WITH RECURSIVE', 1)}, fn AS (SELECT min(vid) AS x FROM (SELECT 0 AS vid)), e AS (SELECT u, v FROM he UNION SELECT v, u FROM he), {_REACH},
cp AS (SELECT n AS vid, min(m) AS component FROM r GROUP BY n), be AS (SELECT u, v FROM he WHERE NOT EXISTS (SELECT 1 FROM he x WHERE x.u = he.v AND x.v = he.u)), b2 AS (SELECT u, v FROM be UNION SELECT v, u FROM be),
rb AS (SELECT u AS n, u AS m FROM b2 UNION SELECT rb.n, b2.v FROM rb JOIN b2 ON rb.m = b2.u), lp AS (SELECT DISTINCT min(m) AS vid FROM rb GROUP BY n)
SELECT component, CAST(sum(v) AS BIGINT) AS v, CAST(sum(e) AS BIGINT) AS e, CAST(sum(f) AS BIGINT) AS f, CAST(sum(l) AS BIGINT) AS loops, CAST(sum(v) - sum(e) + sum(f) AS BIGINT) AS chi FROM (
  SELECT component, 1 AS v, 0 AS e, 0 AS f, 0 AS l FROM cp UNION ALL SELECT component, 0, 1, 0, 0 FROM (SELECT DISTINCT least(u, v) AS vid, greatest(u, v) AS w FROM he) JOIN cp USING (vid)
  UNION ALL SELECT component, 0, 0, 1, 0 FROM tri JOIN cp ON tri.a = cp.vid UNION ALL SELECT component, 0, 0, 0, 1 FROM lp JOIN cp USING (vid)) GROUP BY component""".replace("fn AS (SELECT min(vid) AS x FROM (SELECT 0 AS vid)), ", ""))
def _(spark, sf):
    t = tri(spark, sf)
    used = mesh.degrees(t).select("vid")
    return mesh.component_topology(used, t).select("component", "v", "e", "f", "loops", "chi")
