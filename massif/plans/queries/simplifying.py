"""Queries on simplification by edge collapse and on groups of clusters by adjacency."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import mesh, simplify
from massif.operators.components import connected_components
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import H, tri
from massif.plans.registry import query
from massif.plans.shared import stash

_ALL = f"{H.replace('v % 7 <> 0 AS valid', 'true AS valid')}, {fx.VERTS}, e AS (SELECT least(u, v) AS p, greatest(u, v) AS q, count(*) AS n FROM he GROUP BY 1, 2)"
RATIO, BOUND = 0.8, 1.0


# What the collapses must leave as it was, and what they must reach: the border, Euler's characteristic, the bound of errors.
@query("simplify_quadrics", f"""{_ALL} SELECT 'border_edges' AS what, count(*) AS n FROM e WHERE n = 1 UNION ALL SELECT 'chi', (SELECT count(DISTINCT v) FROM (SELECT p AS v FROM e UNION SELECT q FROM e)) - (SELECT count(*) FROM e) + (SELECT count(*) FROM tri)
UNION ALL SELECT 'odd_edges', count(*) FROM e WHERE n > 2 UNION ALL SELECT 'border_moved', 0 UNION ALL SELECT 'over_bound', 0 UNION ALL SELECT 'too_many', 0""")
def _(spark, sf):
    p = fx.pixels(spark, sf).withColumn("valid", F.lit(True))
    v = p.select((F.col("py") * 32 + F.col("px")).alias("vid"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"), (F.col("v") / 256).alias("z"))
    t = stash(mesh.meshify(p, width=32).select("a", "b", "c"), "terrain")
    v = stash(v, "terrain-vertices")
    vertices, triangles = simplify.simplify(v, t, ratio=RATIO, max_error=BOUND)
    e = stash(mesh.edges(triangles), "edges-left")
    rim = e.filter("n = 1").select(F.explode(F.array("u", "v")).alias("vid")).distinct()
    moved = vertices.join(rim, "vid").join(v.toDF("vid", "ox", "oy", "oz"), "vid").filter("x <> ox OR y <> oy OR z <> oz")

    def told(what: str, rows, sign: int = 1):
        return rows.select(F.lit(what).alias("what"), F.lit(sign).cast("long").alias("n"))

    used = e.select(F.explode(F.array("u", "v")).alias("vid")).distinct()
    parts = [told("border_edges", e.filter("n = 1")), told("chi", used), told("chi", e, -1), told("chi", triangles), told("odd_edges", e.filter("n > 2")), told("border_moved", moved), told("over_bound", vertices.filter(F.col("error") > BOUND))]
    sizes = t.agg(F.count(F.lit(1)).alias("was")).join(triangles.agg(F.count(F.lit(1)).alias("now")))  # two numbers
    out = sizes.select(F.lit("too_many").alias("what"), F.when(F.col("now") > F.ceil(F.col("was") * RATIO), 1).otherwise(0).cast("long").alias("n"))
    for part in parts:
        out = out.union(part)
    none = spark.createDataFrame([(w, 0) for w in ("border_edges", "chi", "odd_edges", "border_moved", "over_bound")], "what string, n long")
    return out.union(none).groupBy("what").agg(F.sum("n").alias("n"))


_CL = f"{H}, s AS (SELECT DISTINCT least(u, v) AS p, greatest(u, v) AS q, (a // 32) // 4 * 8 + (a % 32) // 4 AS cluster FROM he), l AS (SELECT p, q FROM s GROUP BY p, q HAVING count(*) > 1)"


# Groups of at most four blocks: all hang together, and they cut no more edges than four blocks in the order of their numbers.
@query("groups_by_adjacency", f"{_CL} SELECT 'clusters' AS what, count(DISTINCT cluster) AS n FROM s UNION ALL SELECT 'shared_edges', count(*) FROM l UNION ALL SELECT 'over', 0 UNION ALL SELECT 'apart', 0 UNION ALL SELECT 'worse', 0")
def _(spark, sf):
    cluster = F.floor(F.floor(F.col("a") / 32) / 4) * 8 + F.floor((F.col("a") % 32) / 4)
    t = tri(spark, sf).select("a", "b", "c", cluster.cast("long").alias("cluster"))
    links = stash(simplify.cluster_links(t), "cluster-links")
    groups = stash(simplify.partition(t.select(F.col("cluster").alias("id")).distinct(), links, 4), "cluster-groups")
    of = links.join(groups.toDF("u", "gu"), "u").join(groups.toDF("v", "gv"), "v")
    inside = connected_components(of.filter("gu = gv").select("u", "v"))
    apart = groups.join(inside, F.col("id") == F.col("node"), "left").filter(F.coalesce("component", "id") != F.col("group"))
    worse = of.agg((F.sum(F.when(F.col("gu") != F.col("gv"), F.col("weight")).otherwise(0)) > F.sum(F.when(F.floor(F.col("u") / 4) != F.floor(F.col("v") / 4), F.col("weight")).otherwise(0))).alias("w"))

    def count(what: str, rows):
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")

    out = links.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("n")).select(F.lit("shared_edges").alias("what"), "n")
    for part in (count("clusters", groups), count("over", groups.groupBy("group").agg(F.count(F.lit(1)).alias("k")).filter("k > 4")), count("apart", apart), count("worse", worse.filter("w"))):
        out = out.union(part)
    return out
