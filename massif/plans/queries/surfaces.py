"""Queries that clip, walk, split and check meshes, and on columns of points."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.operators import mesh, surface
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import _EXTRA, H, M, PLACED, extra, tri
from massif.plans.registry import query, rounded

BOX = g.box_planes((3.5, 2.25, 900.0), (20.25, 25.5, 1600.0))


def sql_clip(planes: list[tuple], out: str) -> str:
    """A polygon (a, b, c, s, x, y, z) of every placed triangle, cut by one plane after another."""
    steps = ["p0 AS (SELECT a, b, c, 1 AS s, ax AS x, ay AS y, az AS z FROM pl UNION ALL SELECT a, b, c, 2, bx, \"by\", bz FROM pl UNION ALL SELECT a, b, c, 3, cx, cy, cz FROM pl)"]
    for i, (nx, ny, nz, d) in enumerate(planes):
        nxt = ", ".join(f"coalesce(lead({v}) OVER w, first_value({v}) OVER w) AS q{v}" for v in "xyz")
        side = "{0}x * %r + {0}y * %r + {0}z * %r - %r" % (nx, ny, nz, d)
        steps.append(f"""n{i} AS (SELECT *, {side.format('')} AS d, {side.format('q')} AS e FROM (SELECT *, {nxt} FROM p{i} WINDOW w AS (PARTITION BY a, b, c ORDER BY s)))""")
        cross = ", ".join(f"{v} + d / (d - e) * (q{v} - {v})" for v in "xyz")
        steps.append(f"p{i + 1} AS (SELECT a, b, c, row_number() OVER (PARTITION BY a, b, c ORDER BY s, j) AS s, x, y, z FROM (SELECT a, b, c, s, 0 AS j, {cross} FROM n{i} WHERE (d >= 0) <> (e >= 0) UNION ALL SELECT a, b, c, s, 1, qx, qy, qz FROM n{i} WHERE e >= 0) t(a, b, c, s, j, x, y, z))")
    return ", ".join(steps) + f", {out} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY a, b, c) AS k FROM p{len(planes)}) WHERE k >= 3)"


def placed(spark, sf):
    return mesh.placed(tri(spark, sf), fx.vertices(spark, sf))


# Corners as a set, since a triangle left whole starts at another corner than one that was cut.
@query("clip_box", f"{PLACED}, {sql_clip(BOX, 'cl')} SELECT a, b, c, k AS corners, CAST(round(x, 6) + 0.0 AS DOUBLE) AS x, CAST(round(y, 6) + 0.0 AS DOUBLE) AS y, CAST(round(z, 6) + 0.0 AS DOUBLE) AS z FROM cl")
def _(spark, sf):
    cut = surface.clip_triangles(placed(spark, sf), BOX).withColumn("corners", F.size("polygon").cast("long"))
    rows = cut.select("a", "b", "c", "corners", F.explode("polygon").alias("p"))
    return rows.select("a", "b", "c", "corners", *[c.alias(n) for c, n in zip(rounded(*[F.col(f"p.{v}") for v in "xyz"]), "xyz", strict=True)])


@query("clip_polygon_2d", f"{PLACED}, {sql_clip([(0.5, 0.25, 0.0, 6.0)], 'cl')}, f AS (SELECT a, b, c, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS qx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS qy FROM cl WINDOW w AS (PARTITION BY a, b, c ORDER BY s)) SELECT a, b, c, round(sum(x * qy - qx * y) / 2, 6) + 0.0 AS area FROM f GROUP BY a, b, c")
def _(spark, sf):
    cut = surface.clip_triangles(placed(spark, sf), [(0.5, 0.25, 0.0, 6.0)])
    pieces = cut.select("a", "b", "c", F.explode(g.fan(F.col("polygon"))).alias("t"))
    area = F.sum(g.orient_2d(F.col("t")[0], F.col("t")[1], F.col("t")[2])) / 2
    return pieces.groupBy("a", "b", "c").agg(area.alias("s")).select("a", "b", "c", rounded(F.col("s"))[0].alias("area"))


@query("mesh_boundary_loops")
def _(spark, sf):
    found = surface.boundary_loops(tri(spark, sf))
    return found.select(F.col("loop.u").alias("loop_u"), F.col("loop.v").alias("loop_v"), "k", "u", "v")


_NEAR = "nb AS (SELECT u, v FROM he UNION SELECT v, u FROM he), s AS (SELECT min(u) AS vid FROM nb)"


@query("mesh_bfs", f"{H.replace('WITH', 'WITH RECURSIVE', 1)}, {_NEAR}, r AS (SELECT vid, CAST(0 AS BIGINT) AS depth FROM s UNION SELECT v, depth + 1 FROM r JOIN nb ON u = vid WHERE depth < 200), d AS (SELECT vid, min(depth) AS depth FROM r GROUP BY vid) SELECT d.vid, d.depth, (SELECT min(u) FROM nb JOIN d p ON p.vid = nb.u WHERE nb.v = d.vid AND p.depth = d.depth - 1) AS via FROM d")
def _(spark, sf):
    t = tri(spark, sf)
    return surface.breadth_first(t, mesh.degrees(t).agg(F.min("vid").alias("vid")).filter("vid IS NOT NULL"))


@query("split_cluster_parts", f"{M}, cl AS (SELECT (a // 32) // 4 * 8 + (a % 32) // 4 AS cluster, a, b, c, a * 1024 * 1024 + b * 1024 + c AS k FROM tri) SELECT cluster, a, b, c, CAST(ntile(3) OVER (PARTITION BY cluster ORDER BY k) - 1 AS BIGINT) AS part FROM cl")
def _(spark, sf):
    cluster = F.floor(F.floor(F.col("a") / 32) / 4) * 8 + F.floor((F.col("a") % 32) / 4)
    t = tri(spark, sf).select(cluster.alias("cluster"), "a", "b", "c", (F.col("a") * 1024 * 1024 + F.col("b") * 1024 + F.col("c")).alias("k"))
    return surface.split_parts(t, 3, "k").drop("k")


_H = "h AS (SELECT a AS u, b AS v FROM ex UNION ALL SELECT b, c FROM ex UNION ALL SELECT c, a FROM ex)"


@query("mesh_validate", f"""{M}, {fx.VERTS}, {_EXTRA}, {_H}
SELECT 'missing_vertex' AS rule, count(*) AS n FROM (SELECT unnest([a, b, c]) AS vid FROM ex) WHERE vid NOT IN (SELECT vid FROM vert)
UNION ALL SELECT 'degenerate', count(*) FROM ex WHERE a = b OR b = c OR a = c
UNION ALL SELECT 'duplicate', count(*) FROM (SELECT 1 FROM ex GROUP BY list_sort([a, b, c]) HAVING count(*) > 1)
UNION ALL SELECT 'isolated_vertex', count(*) FROM vert WHERE vid NOT IN (SELECT unnest([a, b, c]) FROM ex)
UNION ALL SELECT 'non_manifold_edge', count(*) FROM (SELECT 1 FROM h GROUP BY least(u, v), greatest(u, v) HAVING count(*) > 2)
UNION ALL SELECT 'inconsistent_edge', count(*) FROM (SELECT 1 FROM h GROUP BY u, v HAVING count(*) > 1)""")
def _(spark, sf):
    return surface.validate(fx.vertices(spark, sf), extra(spark, sf))


def corners():
    return [g.point(*[F.col(f"{k}{p}") for p in "xyz"]) for k in "abc"]


_W = "((bx - ax) * (cy - ay) - (\"by\" - ay) * (cx - ax))"


@query("triangle_winding", f"{PLACED} SELECT a, b, c, CAST(sign{_W} AS INTEGER) AS turn FROM pl")
def _(spark, sf):
    return placed(spark, sf).select("a", "b", "c", g.winding(*corners()).alias("turn"))


_BARY = f"{PLACED}, w AS (SELECT *, (bx + cx + 2 * ax) / 4 AS px, (\"by\" + cy + 2 * ay) / 4 AS py FROM pl), q AS (SELECT *, ((cx - bx) * (py - \"by\") - (cy - \"by\") * (px - bx)) / {_W} AS u, ((ax - cx) * (py - cy) - (ay - cy) * (px - cx)) / {_W} AS v FROM w)"


@query("barycentric_interpolate", f"{_BARY} SELECT a, b, c, round(u, 6) + 0.0 AS u, round(v, 6) + 0.0 AS v, round(u * az + v * bz + (1 - u - v) * cz, 4) + 0.0 AS z FROM q")
def _(spark, sf):
    p = g.point((F.col("bx") + F.col("cx") + 2 * F.col("ax")) / 4, (F.col("by") + F.col("cy") + 2 * F.col("ay")) / 4, F.lit(0.0))
    found = placed(spark, sf).withColumn("w", g.barycentric_2d(*corners(), p))
    u, v = rounded(F.col("w.u"), F.col("w.v"))
    return found.select("a", "b", "c", u.alias("u"), v.alias("v"), (F.round(g.interpolate(F.col("w"), F.col("az"), F.col("bz"), F.col("cz")), 4) + 0.0).alias("z"))


_T = "greatest(0.0, least(1.0, (x * 0.2 + y * 0.1 + z * -0.1 + 0.01) / 0.06))"


@query("segment_distance", f"WITH {fx.PT}, t AS (SELECT *, {_T} AS t FROM pt) SELECT id, round(sqrt((x + 0.05 - 0.2 * t) * (x + 0.05 - 0.2 * t) + (y - 0.1 * t) * (y - 0.1 * t) + (z + 0.1 * t) * (z + 0.1 * t)), 6) + 0.0 AS distance FROM t")
def _(spark, sf):
    a, b = (g.point(*[F.lit(v) for v in end]) for end in ((-0.05, 0.0, 0.0), (0.15, 0.1, -0.1)))
    d = g.segment_distance(g.point(F.col("x"), F.col("y"), F.col("z")), a, b)
    return fx.points(spark, sf).select("id", rounded(d)[0].alias("distance"))


@query("padded_bounds", f"WITH {fx.PT}, {fx.BOX} SELECT label, round(lo_x - (0.5 + (hi_x - lo_x) * 0.25), 6) + 0.0 AS lo_x, round(hi_x + (0.5 + (hi_x - lo_x) * 0.25), 6) + 0.0 AS hi_x FROM bx")
def _(spark, sf):
    lo, hi = rounded(*g.pad(F.col("lo_x"), F.col("hi_x"), absolute=0.5, relative=0.25))
    return fx.boxes(spark, sf).select("label", lo.alias("lo_x"), hi.alias("hi_x"))
