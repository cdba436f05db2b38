"""Mesh operators that walk or cut a surface: clipping, boundary loops, breadth-first search, splitting, validation."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.operators import mesh
from massif.operators.components import connected_components
from massif.plans.shared import stash


def clip_triangles(placed: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """(a, b, c, polygon): what half-spaces leave of each placed triangle (ax..cz); those with nothing left go. Triangles
    wholly inside, or outside of one plane, skip the cutting."""
    corners = [g.point(*[F.col(f"{k}{p}") for p in "xyz"]) for k in "abc"]

    def side(k: str, plane) -> Column:
        return sum((F.col(f"{k}{p}") * float(n) for p, n in zip("xyz", plane, strict=False)), F.lit(0.0)) - float(plane[3])

    inside, outside = F.lit(True), F.lit(False)
    for plane in planes:
        inside = inside & (F.least(*[side(k, plane) for k in "abc"]) >= 0)
        outside = outside | (F.greatest(*[side(k, plane) for k in "abc"]) < 0)
    whole = F.array(*corners).cast("array<struct<x:double,y:double,z:double>>")
    cut = F.when(inside, whole).otherwise(g.clip(F.array(*corners), planes))
    return placed.filter(~outside).select("a", "b", "c", cut.alias("polygon")).filter(F.size("polygon") >= 3)


def boundary_loops(triangles: DataFrame) -> DataFrame:
    """(loop, k, u, v): boundary half-edges in order; a loop is named by its smallest half-edge, a struct of u and v, which
    comes first.

    At a vertex that several fans share, a loop goes on in the fan it came by, so every half-edge has one successor.
    Triangles must be consistently oriented and edges have two triangles at most. Places are found by pointer doubling:
    rounds grow with the logarithm of the longest loop, and each is stored."""
    def edge(u: str, v: str) -> Column:
        return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))

    rim = mesh.boundary_edges(triangles).distinct()
    he = mesh.half_edges(triangles)
    third = F.col("a") + F.col("b") + F.col("c") - F.col("u") - F.col("v")
    fan = stash(connected_components(he.select(mesh.corner(F.col("v"), third).alias("u"), mesh.corner(F.col("v"), F.col("u")).alias("v"))), "fans")
    came = rim.select(edge("u", "v").alias("edge"), mesh.corner(F.col("v"), F.col("u")).alias("node")).join(fan, "node").select("edge", "component")
    goes = rim.select(edge("u", "v").alias("next"), mesh.corner(F.col("u"), F.col("v")).alias("node")).join(fan, "node").select("next", "component")
    ring = stash(came.join(goes, "component").select("edge", "next"), "successors")
    loops = connected_components(ring, u="edge", v="next").withColumnsRenamed({"node": "edge", "component": "loop"})
    jump = ring.join(loops, "edge").select("edge", "loop", F.when(F.col("next") != F.col("loop"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("loop"), 1).otherwise(0).cast("long").alias("left"))
    jump = stash(jump, "loop-jumps")
    while not jump.filter("to IS NOT NULL").isEmpty():
        ahead = jump.select(F.col("edge").alias("to"), F.col("to").alias("then"), F.col("left").alias("more"))
        jump = stash(jump.join(ahead, "to", "left").select("edge", "loop", F.col("then").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "loop-jumps")
    size = jump.groupBy("loop").agg((F.max("left")).alias("last"))
    return jump.join(size, "loop").select("loop", (F.col("last") - F.col("left")).alias("k"), "edge.u", "edge.v")


def breadth_first(triangles: DataFrame, sources: DataFrame) -> DataFrame:
    """(vid, depth, via): fewest edges from a vertex of `sources` (vid) to each vertex reached, and the smallest neighbour
    a step nearer (null at a source). One round a depth, each stored. A neighbour of a front is in it, in the front before
    or in the next, so a round looks back at two fronts only."""
    e = mesh.edges(triangles)
    near = stash(e.select(F.col("u").alias("at"), F.col("v").alias("vid")).union(e.select("v", "u")), "neighbours")
    front = stash(sources.select("vid").distinct().select("vid", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("via")), "front")
    found, seen = front, front.select("vid")
    for depth in count(1):
        if front.isEmpty():
            return found
        step = near.join(front.select(F.col("vid").alias("at")), "at").groupBy("vid").agg(F.min("at").alias("via"))
        after = stash(step.join(seen, "vid", "left_anti").select("vid", F.lit(depth).cast("long").alias("depth"), "via"), "front")
        found, seen, front = found.union(after), front.select("vid").union(after.select("vid")), after


def split_parts(clustered: DataFrame, n: int, order: str) -> DataFrame:
    """`clustered` (cluster, order, ...) with `part`: each cluster dealt into n parts of equal size, give or take one, along
    `order`. A cluster has 256 triangles at most."""
    return clustered.withColumn("part", F.ntile(n).over(Window.partitionBy("cluster").orderBy(order)).cast("long") - 1)


def validate(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(rule, n): how often a mesh breaks each rule."""
    corner = triangles.select(F.explode(F.array("a", "b", "c")).alias("vid"))
    bad = [
        ("missing_vertex", corner.join(vertices.select("vid"), "vid", "left_anti")),
        ("degenerate", triangles.filter("a = b OR b = c OR a = c")),
        ("duplicate", mesh.duplicates(triangles, orientation=False)),
        ("isolated_vertex", mesh.isolated(vertices, triangles)),
        ("non_manifold_edge", mesh.non_manifold_edges(triangles)),
        ("inconsistent_edge", mesh.inconsistent_edges(triangles)),
    ]
    out = None
    for rule, rows in bad:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out
