"""Simplification of meshes by edge collapse: each vertex carries the quadric of the planes around it, and every round
collapses a set of edges that don't touch each other's triangles, those of locally least error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.operators import mesh
from massif.plans.shared import stash

QUADRIC = [a + b for i, a in enumerate("xyzw") for b in "xyzw"[i:]]


def quadrics(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(vid, w, xx..ww): sums over the triangles at each vertex of the squared distance to their planes, as a symmetric form
    of (x, y, z, 1), weighted by area; w is the area. Triangles without area count for nothing."""
    n = mesh.normal()
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    plane = [F.when(size > 0, c / size).otherwise(0.0) for c in n]
    p = mesh.placed(triangles.select("a", "b", "c"), vertices).select("a", "b", "c", (size / 2).alias("w"), *[c.alias(f"_{k}") for c, k in zip(plane, "xyz", strict=True)], "ax", "ay", "az")
    p = p.withColumn("_w", -(F.col("_x") * F.col("ax") + F.col("_y") * F.col("ay") + F.col("_z") * F.col("az")))
    p = p.select(F.explode(F.array("a", "b", "c")).alias("vid"), "w", *[(F.col("w") * F.col(f"_{q[0]}") * F.col(f"_{q[1]}")).alias(q) for q in QUADRIC])
    return p.groupBy("vid").agg(*[F.sum(c).alias(c) for c in ("w", *QUADRIC)])


def _form(q: Column, p: Column) -> Column:
    """The value of a quadric at a point."""
    at = {k: p[k] for k in "xyz"} | {"w": F.lit(1.0)}
    return sum((q[k] * at[k[0]] * at[k[1]] * (1.0 if k[0] == k[1] else 2.0) for k in QUADRIC), F.lit(0.0))


def _lowest(q: Column) -> Column:
    """The point where a quadric is least; null where that is no single point."""
    a, b, c = [q["xx"], q["xy"], q["xz"]], [q["xy"], q["yy"], q["yz"]], [q["xz"], q["yz"], q["zz"]]
    d = [-q["xw"], -q["yw"], -q["zw"]]

    def det(u: list[Column], v: list[Column], w: list[Column]) -> Column:
        return u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])

    whole, size = det(a, b, c), q["xx"] + q["yy"] + q["zz"]
    solved = g.point(*[det(*[[d[r] if i == k else row[i] for i in range(3)] for r, row in enumerate((a, b, c))]) / whole for k in range(3)])
    return F.when(F.abs(whole) > size * size * size * 1e-6, solved)


def _candidates(state: DataFrame, triangles: DataFrame, max_error: float) -> DataFrame:
    """(u, v, error, to, q, w): edges that may collapse, the point that replaces both ends and its error: the root of the
    mean squared distance to the planes of both. Their ends aren't both locked, a locked one stays where it is, and they
    have two triangles and no common neighbours but these triangles' corners, so the surface keeps its topology."""
    edges = mesh.edges(triangles).filter("n = 2").select("u", "v")
    near = stash(mesh.adjacency(triangles), "simplify-neighbours")
    packed = state.select("vid", g.point(*[F.col(k) for k in "xyz"]).alias("p"), "locked", F.struct("w", *QUADRIC).alias("q")).join(near, "vid")
    e = edges.join(packed.select(*[F.col(c).alias(f"u_{c}") for c in packed.columns]), F.col("u") == F.col("u_vid")).join(packed.select(*[F.col(c).alias(f"v_{c}") for c in packed.columns]), F.col("v") == F.col("v_vid"))
    e = e.filter(~(F.col("u_locked") & F.col("v_locked")) & (F.size(F.array_intersect("u_near", "v_near")) == 2))
    e = e.withColumn("q", F.struct(*[(F.col(f"u_q.{c}") + F.col(f"v_q.{c}")).alias(c) for c in ("w", *QUADRIC)]))
    free = F.array_compact(F.array(F.col("u_p"), F.col("v_p"), g.along(F.col("u_p"), F.col("v_p"), F.lit(0.5)), _lowest(F.col("q"))))
    places = F.when(F.col("u_locked"), F.array("u_p")).when(F.col("v_locked"), F.array("v_p")).otherwise(free)
    best = F.array_min(F.transform(places, lambda p, i: F.struct(F.greatest(_form(F.col("q"), p), F.lit(0.0)).alias("cost"), i.alias("i"), p.alias("p"))))
    e = e.withColumn("best", best).withColumn("error", F.sqrt(F.col("best.cost") / F.greatest(F.col("q.w"), F.lit(1e-300))))
    return e.filter(F.col("error") <= max_error).select("u", "v", "error", F.col("best.p").alias("to"), "q", "u_locked", "v_locked")


def _apart(candidates: DataFrame, triangles: DataFrame) -> DataFrame:
    """Those of the candidates that are the least of all that share a triangle with one of theirs: none of two chosen
    edges changes a triangle that the other does."""
    key = F.struct("error", "u", "v")
    least = candidates.select(F.explode(F.array("u", "v")).alias("vid"), key.alias("k")).groupBy("vid").agg(F.min("k").alias("k"))
    t = triangles.select("a", "b", "c")
    for c in "abc":
        t = t.join(least.select(F.col("vid").alias(c), F.col("k").alias(f"k{c}")), c, "left")
    around = t.select(F.explode(F.array("a", "b", "c")).alias("vid"), F.least("ka", "kb", "kc").alias("k")).groupBy("vid").agg(F.min("k").alias("k"))
    c = candidates.withColumn("k", key)
    for end in "uv":
        c = c.join(around.select(F.col("vid").alias(end), F.col("k").alias(f"k{end}")), end)
    return c.filter("k = ku AND k = kv").drop("k", "ku", "kv")


def _turned(chosen: DataFrame, state: DataFrame, triangles: DataFrame, least: float) -> DataFrame:
    """(u, v) of chosen edges whose collapse would turn a triangle's normal by more than an angle of cosine `least`."""
    ends = chosen.select(F.explode(F.array("u", "v")).alias("vid"), "u", "v", "to")
    t = triangles.select("a", "b", "c", F.explode(F.array("a", "b", "c")).alias("vid")).join(ends, "vid").drop("vid")
    one = sum((F.when((F.col(k) == F.col("u")) | (F.col(k) == F.col("v")), 1).otherwise(0) for k in "abc"), F.lit(0))
    t = mesh.placed(t.filter(one == 1), state.select("vid", "x", "y", "z"))
    old = [g.point(*[F.col(f"{k}{p}") for p in "xyz"]) for k in "abc"]
    new = [F.when((F.col(k) == F.col("u")) | (F.col(k) == F.col("v")), F.col("to")).otherwise(p) for k, p in zip("abc", old, strict=True)]
    t = t.select("u", "v", *[g.cross(g.sub(p[1], p[0]), g.sub(p[2], p[0])).alias(name) for name, p in (("m", old), ("n", new))])
    m, n = F.col("m"), F.col("n")
    return t.filter(g.dot(m, n) <= least * F.sqrt(g.dot(m, m)) * F.sqrt(g.dot(n, n))).select("u", "v").distinct()


def simplify(vertices: DataFrame, triangles: DataFrame, *, ratio: float = 0.5, max_error: float = math.inf, locked: DataFrame | None = None, least_cosine: float = 0.2, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(vid, x, y, z, error) and (a, b, c) of a mesh with `ratio` of its triangles, or as few as collapses allow whose
    error is `max_error` or less; a vertex's error is the largest of the collapses that made it.

    Vertices on the border, at edges of more than two triangles, and those in `locked` (vid) stay, and all collapses keep
    the topology. A round settles an independent set of edges; where it has more than are needed, those of least error
    are taken. Edges whose collapse would turn a triangle over are left out from then on. Rounds grow with the logarithm of
    the reduction, and each is stored. Isolated vertices go; an empty mesh stays empty."""
    edges = mesh.edges(triangles)
    fixed = edges.filter("n <> 2").select(F.explode(F.array("u", "v")).alias("vid"))
    fixed = (fixed.union(locked.select("vid")) if locked is not None else fixed).distinct().withColumn("locked", F.lit(True))
    state = vertices.select("vid", *[F.col(k).cast("double").alias(k) for k in "xyz"]).join(quadrics(vertices, triangles), "vid").join(fixed, "vid", "left")
    state = stash(state.withColumn("locked", F.coalesce("locked", F.lit(False))).withColumn("error", F.lit(0.0)), "simplify-vertices")
    triangles = stash(triangles.select("a", "b", "c"), "simplify-triangles")
    left = triangles.count()
    target = math.ceil(left * ratio)
    barred: DataFrame | None = None
    for _ in range(rounds):
        if left <= target:
            break
        found = _candidates(state, triangles, max_error)
        if barred is not None:
            found = found.join(barred, ["u", "v"], "left_anti")
        found = stash(found, "collapses")
        chosen = stash(_apart(found, triangles), "chosen-collapses")
        bad = stash(_turned(chosen, state, triangles, least_cosine), "turned")
        if not bad.isEmpty():
            barred = bad if barred is None else barred.union(bad)
        good = chosen.join(bad, ["u", "v"], "left_anti").orderBy("error", "u", "v").limit((left - target + 1) // 2)
        good = stash(good.select(F.when(F.col("v_locked"), F.col("v")).otherwise(F.col("u")).alias("stays"), F.when(F.col("v_locked"), F.col("u")).otherwise(F.col("v")).alias("goes"), "error", "to", "q"), "good-collapses")
        if good.isEmpty():
            if bad.isEmpty():
                break
            continue
        both = good.select(F.explode(F.array("stays", "goes")).alias("vid"), "stays", F.col("error").alias("_e"), "to", "q")
        moved = state.join(both, "vid", "left")
        kept = moved.groupBy(F.coalesce("stays", "vid").alias("vid")).agg(
            *[F.first(F.coalesce(F.col(f"to.{k}"), F.col(k))).alias(k) for k in "xyz"], *[F.first(F.coalesce(F.col(f"q.{c}"), F.col(c))).alias(c) for c in ("w", *QUADRIC)],
            F.max("locked").alias("locked"), F.max(F.greatest("error", F.coalesce("_e", F.lit(0.0)))).alias("error"),
        )
        after = triangles
        for k in "abc":
            after = after.join(good.select(F.col("goes").alias(k), F.col("stays").alias(f"_{k}")), k, "left").withColumn(k, F.coalesce(f"_{k}", k)).drop(f"_{k}")
        state, triangles = stash(kept, "simplify-vertices"), stash(mesh.not_degenerate(after.select("a", "b", "c")), "simplify-triangles")
        left = triangles.count()
    return state.select("vid", "x", "y", "z", "error"), triangles


def partition(nodes: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """(id, group): nodes (id) in groups of at most `most` that hang together by links (u, v, weight), heavy ones inside.

    In each round every group looks for the link of greatest weight, of equals that to the least group, with which it would
    not grow too large; two that look at each other become one. Links between the same groups are then summed. Rounds go
    on until no link fits; a group is named by its smallest node. Links may point either way and repeat."""
    named = stash(nodes.select("id", F.col("id").alias("group"), F.lit(1).cast("long").alias("n")), "partition")
    ties = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("weight").cast("double").alias("weight")).filter("u <> v")
    while True:
        ties = stash(ties.groupBy("u", "v").agg(F.sum("weight").alias("weight")), "partition-links")
        sizes = named.select("group", "n").distinct()
        fit = ties.join(sizes.toDF("u", "nu"), "u").join(sizes.toDF("v", "nv"), "v").filter(F.col("nu") + F.col("nv") <= most)
        key = F.struct((-F.col("weight")).alias("w"), "u", "v")
        best = fit.select(F.explode(F.array("u", "v")).alias("at"), key.alias("k")).groupBy("at").agg(F.min("k").alias("k"))
        agreed = best.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c = 2").select(F.col("k.u").alias("u"), F.col("k.v").alias("v"))
        agreed = stash(agreed, "partition-merges")
        if agreed.isEmpty():
            return named.select("id", "group")
        into = agreed.select(F.col("v").alias("group"), F.col("u").alias("into"))
        moved = named.join(into, "group", "left").select("id", F.coalesce("into", "group").alias("group"))
        named = stash(moved.join(moved.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group").select("id", "group", "n"), "partition")
        for end in "uv":
            ties = ties.join(into.select(F.col("group").alias(end), F.col("into").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        ties = ties.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight")


def cluster_links(triangles: DataFrame) -> DataFrame:
    """(u, v, weight): clusters that share edges of the mesh (a, b, c, cluster), and how many."""
    e = triangles.select("cluster", F.explode(F.array(*[F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in ("ab", "bc", "ca")])).alias("e")).distinct()
    at = e.groupBy("e").agg(F.sort_array(F.collect_set("cluster")).alias("at")).filter("size(at) > 1")
    # An edge of a manifold mesh has two triangles, so at most two clusters; at others each is linked to the next.
    pairs = at.select(F.explode(F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("u"), F.slice("at", F.lit(2), F.size("at") - 1).alias("v"))).alias("l"))
    return pairs.groupBy("l.u", "l.v").agg(F.count(F.lit(1)).alias("weight"))
