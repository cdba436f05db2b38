"""Merging and cutting of two trees, masks, and welding of vertices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions import octree
from massif.operators import spatial, welding
from massif.operators.components import chained_components
from massif.operators.index import with_ancestors
from massif.plans.shared import stash

NODE_PADDING, CHILD_PADDING, LOCK_MARGIN, DAG_PADDING = 0.05, 0.125, 0.05, 0.5 - 1e-6  # shares of a node's size


def status_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(level, index, left_status, right_status) of two indexes; a key that one lacks is Missing there."""
    a, b = left.withColumnRenamed("status", "l"), right.withColumnRenamed("status", "r")
    j = a.join(b, ["level", "index"], "full_outer")
    return j.select("level", "index", F.coalesce("l", F.lit("Missing")).alias("left_status"), F.coalesce("r", F.lit("Missing")).alias("right_status"))


def simple_action(left: Column, right: Column) -> Column:
    """What a merge does with a node: take a side that the other lacks, weld two leaves, else go on below."""
    return F.when(right == "Missing", "Left").when(left == "Missing", "Right").when((left == "Leaf") & (right == "Leaf"), "Merge").otherwise("Recurse")


def simple_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each key of either index with its action. A key is visited only if all its ancestors are recursed into."""
    pairs = status_pairs(left, right)
    acted = pairs.withColumn("action", simple_action(F.col("left_status"), F.col("right_status")))
    closed = acted.filter("action <> 'Recurse'").select(F.col("level").alias("l"), F.col("index").alias("i"))
    above = with_ancestors(acted.select("level", "index", F.struct("level", "index").alias("at"))).filter("steps > 0")
    below = above.join(closed, (F.col("level") == F.col("l")) & (F.col("index") == F.col("i")), "left_semi").select("at.*").distinct()
    return acted.join(below, ["level", "index"], "left_anti")


def masked_action(left: Column, right: Column, cover: Column) -> Column:
    """`cover` says how the mask meets a node: none, part or all. Outside the mask the base (left) stays; inside, the new
    (right) terrain replaces it; leaves that the mask cuts are merged."""
    base = F.when(left == "Missing", "Ignore").otherwise("Left")
    new = F.when(right == "Missing", "Ignore").otherwise("Right")
    leaf = (left != "Virtual") & (right != "Virtual")
    mixed = F.when((left == "Missing") & (right == "Missing"), "Ignore").when(leaf, "Merge").otherwise("Recurse")
    return F.when(cover == "none", base).when(cover == "all", new).otherwise(mixed)


def ancestor_fallback(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Keys with the stored node, own or above, that their content comes from."""
    return spatial.nearest_ancestor(keys, stored)


def crossings(rings: DataFrame, points: DataFrame, pid: str = "id") -> DataFrame:
    """(id, component) of the components whose rings, holes included, hold a point: an odd number of edges of a component
    to the right. `rings` is (component, ring, seq, x, y), bounded like a mask and therefore broadcast only if it is
    under the session's broadcast limit; the join is on horizontal strips that edges and points share."""
    w = Window.partitionBy("component", "ring").orderBy("seq")
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lead(F.struct("x", "y")).over(w), first)
    edge = rings.select("component", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt.alias("n")).select("component", "x1", "y1", F.col("n.x").alias("x2"), F.col("n.y").alias("y2"))
    span = edge.agg((F.max("y1") - F.min("y1")).alias("h")).first()[0] or 1.0
    strip = float(span) / 16 or 1.0
    lo, hi = F.floor(F.least("y1", "y2") / strip), F.floor(F.greatest("y1", "y2") / strip)
    edge = edge.withColumn("strip", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    p = points.withColumn("strip", F.floor(F.col("y") / strip).cast("long"))
    over = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    right = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hits = p.join(edge, "strip").filter(over & right).groupBy(pid, "component").agg(F.count(F.lit(1)).alias("n"))
    return hits.filter("n % 2 = 1").select(pid, "component")


def in_mask(points: DataFrame, rings: DataFrame, *, keep_inside: bool = True, pid: str = "id") -> DataFrame:
    """Points inside the union of a mask's components, or outside all of them."""
    return points.join(crossings(rings, points, pid).select(pid).distinct(), pid, "left_semi" if keep_inside else "left_anti")


def ring_area(rings: DataFrame) -> DataFrame:
    """(component, ring, area): signed, positive for counter-clockwise rings."""
    w = Window.partitionBy("component", "ring").orderBy("seq")
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pair = rings.withColumn("n", F.coalesce(F.lead(F.struct("x", "y")).over(w), first))
    return pair.groupBy("component", "ring").agg((F.sum(F.col("x") * F.col("n.y") - F.col("n.x") * F.col("y")) / 2).alias("area"))


def normal_rings(rings: DataFrame) -> DataFrame:
    """Rings without repeated vertices or those of fewer than three, outer ones counter-clockwise, holes clockwise."""
    w = Window.partitionBy("component", "ring").orderBy("seq")
    prev = F.lag(F.struct("x", "y")).over(w)
    clean = rings.withColumn("p", prev).filter(F.col("p").isNull() | (F.col("p.x") != F.col("x")) | (F.col("p.y") != F.col("y"))).drop("p")
    n = F.count(F.lit(1)).over(Window.partitionBy("component", "ring"))
    clean = clean.withColumn("n", n).filter("n >= 3").drop("n")
    turned = clean.join(ring_area(clean), ["component", "ring"])
    wrong = (F.col("area") > 0) != F.col("is_outer")
    return turned.select("component", "ring", "is_outer", F.when(wrong, -F.col("seq")).otherwise(F.col("seq")).alias("seq"), "x", "y")


def weld_exact(points: DataFrame) -> DataFrame:
    """(id, merged): points of equal position take the smallest id among them."""
    least = points.groupBy("x", "y", "z").agg(F.min("id").alias("merged"))
    return points.join(least, ["x", "y", "z"]).select("id", "merged")


def weld_components(points: DataFrame, eps: float) -> DataFrame:
    """(id, merged): points joined through steps of at most eps take the smallest id of their component."""
    links = spatial.epsilon_join(points, points, eps).filter("id < r_id").select(F.col("id").alias("u"), F.col("r_id").alias("v"))
    found = chained_components(links)
    return points.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("merged"))


def weld_multipartite(points: DataFrame, eps: float) -> DataFrame:
    """(id, merged) with at most one point of each source (column source) in a group: in each eps-component, pairs of
    different sources are joined by distance, then ids, if their groups share no source.

    The order is sequential, but what a pair does depends on near ones only: tiles are welded side by side."""
    return welding.multipartite(points, eps)


def averaged(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """(merged, x, y, z): mean positions of welded points."""
    return points.join(mapping, "id").groupBy("merged").agg(*[F.avg(a).alias(a) for a in "xyz"])


def last_written(points: DataFrame, mapping: DataFrame) -> DataFrame:
    """(merged, x, y, z): the position of the last point written to each, by id."""
    best = F.max_by(F.struct("x", "y", "z"), "id")
    return points.join(mapping, "id").groupBy("merged").agg(best.alias("p")).select("merged", "p.*")


def cross_mesh_mapping(points: DataFrame, eps: float) -> DataFrame:
    """(mesh, id, to_mesh, to_id): each point's nearest point of an earlier mesh within eps, ties to the first by mesh and
    id. Points of one mesh are never joined.

    Of points at one position only the first by mesh and id is looked for. They are looked for in growing balls, as nearest()
    does, so that pairs grow with the points and not with their density. What a cell has of no earlier mesh is met there too,
    but goes no further."""
    points = points.select("mesh", "id", *spatial.XYZ).dropna(subset=["mesh", *spatial.XYZ])
    spots = stash(points.groupBy(*spatial.XYZ).agg(F.min(F.struct("mesh", "id")).alias("to"), F.max("mesh").alias("last")), "cross-spots")
    first, last = spots.agg(F.min("to.mesh"), F.max("last")).first()
    spots = spots.filter(F.col("to.mesh") < last).drop("last")
    rounds = max(0, math.ceil(math.log2(max(spots.count(), 1) / 8) / 3))
    rest, out = points.filter(F.col("mesh") > first), None
    for k in range(rounds, -1, -1):
        pairs = spatial.epsilon_join(spots, rest, eps / 2**k).filter("to.mesh < r_mesh")
        best = F.min(F.struct("d2", "to")).alias("b")
        found = pairs.groupBy(F.col("r_mesh").alias("mesh"), F.col("r_id").alias("id")).agg(best).select("mesh", "id", F.col("b.to.mesh").alias("to_mesh"), F.col("b.to.id").alias("to_id"))
        if k:
            found = stash(found, "cross-found")
            done = found.select(F.col("mesh").alias("_mesh"), F.col("id").alias("_id"))
            rest = stash(rest.join(done, (F.col("mesh") == F.col("_mesh")) & F.col("id").eqNullSafe(F.col("_id")), "left_anti"), "cross-rest")
        out = found if out is None else out.union(found)
    return out


def cut_leaves(leaves: DataFrame, space: octree.Space, low: tuple, high: tuple, level: int, *, keep_inside: bool) -> DataFrame:
    """Leaves on a level whose cell is inside a box, or outside it. Inside, ranges of the index reach the scan first."""
    b = octree.cell_bounds(space, F.col("level"), F.col("index"))
    meets = F.lit(True)
    for k in range(3):
        meets = meets & (b[k] < high[k]) & (b[k + 3] > low[k])
    if keep_inside:
        return leaves.filter(octree.in_ranges(F.col("index"), octree.morton_ranges(space, level, low, high))).filter(meets)
    return leaves.filter(~meets)


def weld_greedy(points: DataFrame, eps: float) -> DataFrame:
    """(id, merged): in the order of ids, a point that isn't welded yet takes to itself, of every other source (column
    source), the nearest point within eps that isn't welded either, ties to the smaller id. The order is sequential, but what
    a point does depends on near ones only: tiles are welded side by side."""
    return welding.greedy(points, eps)


MODES = ("GreedyLocal", "ConnectedComponents", "MultipartiteNearest", "ExactHashBased")


def weld_mode(mode: str, eps: float, sources: int, *, within: bool = False) -> str:
    """The mode that a weld runs in: what the asked one cannot do falls back to one that can."""
    if mode not in MODES:
        raise ValueError(f"InvalidInput: no mode {mode}")
    if mode == "MultipartiteNearest" and within:
        mode = "ConnectedComponents"
    if mode == "MultipartiteNearest" and sources > 64:
        mode = "GreedyLocal"
    if mode != "ExactHashBased" and eps == 0:
        mode = "ExactHashBased"
    return "GreedyLocal" if mode == "ExactHashBased" and eps else mode


def weld(points: DataFrame, eps: float, mode: str = "MultipartiteNearest", *, sources: int = 2, within: bool = False) -> DataFrame:
    """(id, merged) of points (id, source, x, y, z), by mode."""
    how = {"GreedyLocal": weld_greedy, "ConnectedComponents": weld_components, "MultipartiteNearest": weld_multipartite, "ExactHashBased": lambda p, _: weld_exact(p)}
    return how[weld_mode(mode, eps, sources, within=within)](points, eps)


def weld_meshes(vertices: DataFrame, triangles: DataFrame, eps: float, *, mode: str = "ConnectedComponents", average: bool = True) -> tuple[DataFrame, DataFrame]:
    """One mesh of several (vertices: id, source, x, y, z; triangles: a, b, c by id): welded vertices at their mean or at the
    position of the last, triangles without those that collapse or repeat."""
    from massif.operators import mesh

    mapping = weld(vertices, eps, mode)
    place = (averaged if average else last_written)(vertices, mapping)
    return place.withColumnRenamed("merged", "vid"), mesh.deduplicated(mesh.remap(triangles, mapping, "id", "merged"))


def edge_epsilon(triangles: DataFrame, vertices: DataFrame, share: float = 0.01) -> float:
    """A weld distance: a share of the shortest edge."""
    from massif.operators import mesh

    return (mesh.edge_lengths(triangles, vertices).agg(F.min("length")).first()[0] or 0.0) * share


def mapping_sources(mapping: DataFrame, vertices: DataFrame) -> DataFrame:
    """(merged, sources): a mapping read backwards: the (source, id) that each merged vertex was made of, in order."""
    s = F.sort_array(F.collect_list(F.struct("source", "id")))
    return mapping.join(vertices.select("id", "source"), "id").groupBy("merged").agg(s.alias("sources"))


def source_triangles(merged: DataFrame, mapping: DataFrame, triangles: DataFrame) -> DataFrame:
    """(a, b, c, source, sa, sb, sc): the triangles of the sources (source, a, b, c) that each merged triangle stands for."""
    t = triangles.select("source", *[F.col(k).alias(f"s{k}") for k in "abc"])
    for k in "abc":
        t = t.join(mapping.select(F.col("id").alias(f"s{k}"), F.col("merged").alias(k)), f"s{k}")
    form = F.sort_array(F.array("a", "b", "c"))
    return merged.withColumn("_f", form).join(t.select(form.alias("_f"), "source", "sa", "sb", "sc"), "_f").drop("_f")
