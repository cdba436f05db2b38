"""Masks as rings (component, ring, is_outer, seq, x, y): where they cover a tree, their triangles, cutting of meshes, and
merging of two datasets inside and outside of a mask."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree
from massif.operators import merge, spatial
from massif.operators.index import closure, with_ancestors
from massif.plans.shared import stash

PIECE = "component int, piece int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"


def edges(rings: DataFrame) -> DataFrame:
    """(component, ring, x1, y1, x2, y2): the sides of all rings."""
    w = Window.partitionBy("component", "ring").orderBy("seq")
    first = F.first(F.struct("x", "y")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    e = rings.select("component", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead(F.struct("x", "y")).over(w), first).alias("n"))
    return e.select("component", "ring", "x1", "y1", F.col("n.x").alias("x2"), F.col("n.y").alias("y2"))


def in_bounds(rings: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """(id, component): the components whose bounds meet each box (id, lo_x, lo_y, hi_x, hi_y). Both are dealt into square
    cells."""
    def dealt(d: DataFrame) -> DataFrame:
        for a in "xy":
            d = d.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / cell).cast("long"), F.floor(F.col(f"hi_{a}") / cell).cast("long"))))
        return d

    own = rings.groupBy("component").agg(*[f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xy"])
    m = dealt(own).withColumnsRenamed({f"{n}_{a}": f"m{n}_{a}" for n in ("lo", "hi") for a in "xy"})
    meets = F.lit(True)
    for a in "xy":
        meets = meets & (F.col(f"mlo_{a}") <= F.col(f"hi_{a}")) & (F.col(f"mhi_{a}") >= F.col(f"lo_{a}"))
    return dealt(boxes).join(m, ["cx", "cy"]).filter(meets).select("id", "component").distinct()


def cover(keys: DataFrame, rings: DataFrame, space: octree.Space) -> DataFrame:
    """`keys` (level, index, ...) with `cover`, how the mask meets the square below each cell: part if a side of a ring
    does, else all or none by its centre. Sides are dealt into the cells of their bounds on each level, so they meet keys
    by an equi-join; points on a border count as met."""
    b = octree.cell_bounds(space, F.col("level"), F.col("index"))
    at = octree.decode(F.col("index"))
    k = keys.withColumns({"_cx": at[0], "_cy": at[1], "_lo_x": b[0], "_lo_y": b[1], "_hi_x": b[3], "_hi_y": b[4]})
    squares = stash(k.select("level", "_cx", "_cy", "_lo_x", "_lo_y", "_hi_x", "_hi_y").distinct(), "mask-squares")
    levels = squares.select("level").distinct()
    e = edges(rings).join(levels.hint("broadcast"))  # a row a level: 22 at most
    size = octree.cell_size(space, F.col("level"))
    for a in "xy":
        lo, hi = F.floor((F.least(f"{a}1", f"{a}2") - space.low) / size), F.floor((F.greatest(f"{a}1", f"{a}2") - space.low) / size)
        e = e.withColumn(f"_c{a}", F.explode(F.sequence((lo - 1).cast("long"), hi.cast("long"))))
    meets = g.segment_meets_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "_lo_x", "_lo_y", "_hi_x", "_hi_y")])
    part = squares.join(e, ["level", "_cx", "_cy"]).filter(meets).select("level", "_cx", "_cy").distinct().withColumn("_part", F.lit(True))
    centres = squares.select(F.struct("level", "_cx", "_cy").alias("id"), ((F.col("_lo_x") + F.col("_hi_x")) / 2).alias("x"), ((F.col("_lo_y") + F.col("_hi_y")) / 2).alias("y"))
    inside = merge.crossings(rings, centres).select("id.*").distinct().withColumn("_all", F.lit(True))
    out = k.join(part, ["level", "_cx", "_cy"], "left").join(inside, ["level", "_cx", "_cy"], "left")
    return out.select(*keys.columns, F.when(F.col("_part"), "part").when(F.col("_all"), "all").otherwise("none").alias("cover"))


def masked_merge(left: DataFrame, right: DataFrame, rings: DataFrame, space: octree.Space) -> DataFrame:
    """(level, index, left_status, right_status, cover, action) of the keys that a merge of two sets of leaves visits: new
    terrain (right) inside the mask, the base (left) outside.

    A side that has no node at a key, but a leaf above it, is Coarser there and stands in with that leaf; where it does, all
    children of the other side's inner nodes are keys. A key is visited only if all its ancestors are recursed into."""
    def side(own: DataFrame, keys: DataFrame, name: str) -> DataFrame:
        ix = closure(own).withColumnRenamed("status", "own")
        found = spatial.nearest_ancestor(keys, own.select("level", "index"))
        coarser = F.when(F.col("found_level").isNotNull(), "Coarser").otherwise("Missing")
        return found.join(ix, ["level", "index"], "left").select("level", "index", F.coalesce("own", coarser).alias(name))

    def beside(own: DataFrame, other: DataFrame) -> DataFrame:
        """Children of `own` nodes that stand against a leaf of `other`, at their place or above."""
        inner = closure(own).filter("status = 'Virtual'").select("level", "index")
        against = spatial.nearest_ancestor(inner, other.select("level", "index")).filter("found_level is not null")
        child = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: octree.child(F.col("index"), i)))
        return against.select((F.col("level") + 1).alias("level"), child.alias("index"))

    keys = closure(left).select("level", "index").union(closure(right).select("level", "index")).union(beside(left, right)).union(beside(right, left))
    keys = stash(keys.distinct(), "merge-keys")
    pairs = cover(side(left, keys, "left_status").join(side(right, keys, "right_status"), ["level", "index"]), rings, space)
    acted = stash(pairs.withColumn("action", merge.masked_action(F.col("left_status"), F.col("right_status"), F.col("cover"))), "merge-actions")
    closed = acted.filter("action <> 'Recurse'").select(F.col("level").alias("l"), F.col("index").alias("i"))
    above = with_ancestors(acted.select("level", "index", F.struct("level", "index").alias("at"))).filter("steps > 0")
    below = above.join(closed, (F.col("level") == F.col("l")) & (F.col("index") == F.col("i")), "left_semi").select("at.*").distinct()
    return acted.join(below, ["level", "index"], "left_anti")


def ears(outer: np.ndarray, holes: list[np.ndarray]) -> list[np.ndarray]:
    """Triangles of a polygon with holes: holes are joined to the outline by bridges to the nearest visible corner, then
    ears are cut off. The outline turns counter-clockwise, holes clockwise."""
    def turn(a, b, c) -> float:
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def crosses(a, b, c, d) -> bool:
        return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0

    ring = [tuple(p) for p in outer]
    waiting = sorted(([tuple(p) for p in h] for h in holes), key=lambda h: -max(p[0] for p in h))
    while waiting:
        hole = waiting.pop(0)
        sides = [list(zip(r, r[1:] + r[:1], strict=True)) for r in (ring, hole, *waiting)]
        choices = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, i, j) for i, p in enumerate(ring) for j, q in enumerate(hole))
        i, j = next((i, j) for _, i, j in choices if not any(crosses(ring[i], hole[j], a, b) for s in sides for a, b in s))
        ring = ring[: i + 1] + hole[j:] + hole[: j + 1] + ring[i:]
    out, left = [], list(range(len(ring)))
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = (ring[left[(k + d) % len(left)]] for d in (-1, 0, 1))
            if turn(a, b, c) > 0 and not any(p not in (a, b, c) and min(turn(a, b, p), turn(b, c, p), turn(c, a, p)) >= 0 for p in (ring[i] for i in left)):
                out.append(np.array([a, b, c]))
                del left[k]
                break
        else:  # only corners without area are left
            k = min(range(len(left)), key=lambda k: abs(turn(*(ring[left[(k + d) % len(left)]] for d in (-1, 0, 1)))))
            del left[k]
    last = [ring[i] for i in left]
    return out + ([np.array(last)] if turn(*last) > 0 else [])


def triangulate(rings: DataFrame) -> DataFrame:
    """(component, piece, x0..y2): triangles, counter-clockwise, that together are a component. A component is handled as a
    whole, as ears are cut one after another; its rings should be normal_rings()."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(bool(r["is_outer"].iloc[0]), r.sort_values("seq")[["x", "y"]].to_numpy()) for _, r in pdf.groupby("ring")]
        outer = next(p for o, p in parts if o)
        found = ears(outer, [p for o, p in parts if not o])
        rows = [(int(pdf["component"].iloc[0]), k, *t.ravel()) for k, t in enumerate(found)]
        return pd.DataFrame(rows, columns=["component", "piece", "x0", "y0", "x1", "y1", "x2", "y2"]).astype({"component": "int32", "piece": "int32"})

    return rings.groupBy("component").applyInPandas(run, PIECE)


def is_planar(polygon: Column, tolerance: float) -> Column:
    """Whether all corners of a polygon lie within a tolerance of the plane of its first three."""
    def flat(frame: Column) -> Column:
        return F.forall(polygon, lambda p: F.abs(g.project(frame, p)["z"]) <= tolerance)

    return octree.let(g.plane_frame(polygon[0], polygon[1], polygon[2]), flat)


def cut(polygons: DataFrame, pieces: DataFrame, cell: float, *, keep_inside: bool) -> DataFrame:
    """`polygons` (id, polygon, ...; convex) cut by a mask's pieces: (id, ..., polygon) of every part inside the mask, or
    outside. What no piece comes near passes as it is, or goes.

    Inside, each piece keeps its part, and parts of pieces of one component don't overlap. Outside, the pieces are taken
    away one after another: the parts outside each edge and inside the edges before it go on. Polygons meet pieces in
    square cells; `cell` should be near their size."""
    rest = [c for c in polygons.columns if c != "polygon"]
    xs, ys = (F.transform("polygon", _axis(a)) for a in "xy")
    boxed = polygons.withColumns({"_lx": F.array_min(xs), "_hx": F.array_max(xs), "_ly": F.array_min(ys), "_hy": F.array_max(ys)})
    p = pieces.withColumns({f"_p{n}{a}": f(*[F.col(f"{a}{k}") for k in range(3)]) for n, f in (("l", F.least), ("h", F.greatest)) for a in "xy"})

    def dealt(d: DataFrame, lo: str, hi: str) -> DataFrame:
        for a in "xy":
            d = d.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"{lo}{a}") / cell).cast("long"), F.floor(F.col(f"{hi}{a}") / cell).cast("long"))))
        return d

    near = F.lit(True)
    for a in "xy":
        near = near & (F.col(f"_pl{a}") <= F.col(f"_h{a}")) & (F.col(f"_ph{a}") >= F.col(f"_l{a}"))
    corners = [g.point(F.col(f"t.x{k}"), F.col(f"t.y{k}"), F.lit(0.0)) for k in range(3)]
    met = dealt(boxed, "_l", "_h").join(dealt(p, "_pl", "_ph"), ["_cx", "_cy"]).filter(near).select(*rest, "polygon", F.struct("component", "piece", *[f"{a}{k}" for k in range(3) for a in "xy"]).alias("t")).distinct()
    if keep_inside:
        parts = met.select(*rest, F.col("t.component").alias("component"), g.clip_by(F.col("polygon"), g.edge_planes(corners)).alias("polygon"))
        return parts.filter(F.size("polygon") >= 3).select(*rest, "polygon")

    def planes(t: Column, k: int) -> Column:
        return g.edge_planes([g.point(t[f"x{i}"], t[f"y{i}"], F.lit(0.0)) for i in range(3)], outside=k)

    def take_away(parts: Column, t: Column) -> Column:
        left = F.flatten(F.transform(parts, lambda q: F.array(*[g.clip_by(q, planes(t, k)) for k in range(3)])))
        return F.filter(left, lambda q: F.size(q) >= 3)

    alone = polygons.join(met.select("id").distinct(), "id", "left_anti").select(*rest, "polygon")
    grouped = met.groupBy(*rest, "polygon").agg(F.sort_array(F.collect_set("t")).alias("ts"))
    start = F.array(F.col("polygon").cast("array<struct<x:double,y:double,z:double>>"))
    cutaway = grouped.select(*rest, F.explode(F.aggregate("ts", start, take_away)).alias("polygon"))
    return alone.unionByName(cutaway)


def _axis(a: str):
    return lambda p: p[a]


def node_content(nodes: DataFrame, keys: DataFrame, space: octree.Space) -> DataFrame:
    """(level, index, id, polygon) of what a dataset (level, index, id, polygon) has at each key: its own polygons, or those
    of the nearest stored ancestor clipped to the key's cell."""
    found = spatial.nearest_ancestor(keys.select("level", "index"), nodes.select("level", "index").distinct()).filter("found_level is not null")
    n = nodes.select(F.col("level").alias("found_level"), F.col("index").alias("found_index"), "id", "polygon")
    return in_cells(found.join(n, ["found_level", "found_index"]), space)


def in_cells(rows: DataFrame, space: octree.Space) -> DataFrame:
    """(level, index, id, polygon) of rows (level, index, found_level, id, polygon): polygons that come from a node above the
    key are clipped to the key's cell."""
    b = octree.cell_bounds(space, F.col("level"), F.col("index"))
    unit = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    walls = [F.struct(*[F.lit(s * c).alias(m) for c, m in zip(u, ("nx", "ny", "nz"), strict=True)], (s * b[i + 3 * (s < 0)]).alias("d")) for s in (1.0, -1.0) for i, u in enumerate(unit)]
    clipped = F.when(F.col("level") == F.col("found_level"), F.col("polygon").cast("array<struct<x:double,y:double,z:double>>")).otherwise(g.clip_by(F.col("polygon"), F.array(*walls)))
    return rows.select("level", "index", "id", clipped.alias("polygon")).filter(F.size("polygon") >= 3)


def merge_datasets(left: DataFrame, right: DataFrame, rings: DataFrame, space: octree.Space, cell: float) -> DataFrame:
    """(level, index, side, id, polygon): the merge of two datasets (level, index, id, polygon; leaves): right inside the
    mask, left outside. Nodes of one side are taken as they are; in nodes that the mask cuts, both sides are."""
    leaf = [d.select("level", "index").distinct() for d in (left, right)]
    acted = stash(masked_merge(*leaf, rings, space).select("level", "index", "action"), "merge-plan")
    pieces, out = stash(triangulate(merge.normal_rings(rings)), "mask-pieces"), None
    for name, nodes in (("Left", left), ("Right", right)):
        below = acted.filter(F.col("action") == name).select(F.col("level").alias("al"), F.col("index").alias("ai"))
        own = with_ancestors(nodes.select("level", "index").distinct().withColumn("at", F.struct("level", "index"))).select(F.col("level").alias("al"), F.col("index").alias("ai"), "at").join(below, ["al", "ai"]).select("at.*")
        stand = acted.filter(F.col("action") == name).select("level", "index")
        keys = stand.join(with_ancestors(nodes.select("level", "index").distinct()).select("level", "index").distinct(), ["level", "index"], "left_anti").union(own).distinct()
        whole = node_content(nodes, keys, space)
        mixed = node_content(nodes, acted.filter("action = 'Merge'").select("level", "index"), space)
        mixed = stash(mixed.withColumn("id", F.struct("level", "index", "id")), "merge-mixed")
        parts = cut(mixed, pieces, cell, keep_inside=name == "Right").select("level", "index", F.col("id.id").alias("id"), "polygon")
        both = whole.select("level", "index", "id", "polygon").union(parts).select("level", "index", F.lit(name.lower()).alias("side"), "id", "polygon")
        out = both if out is None else out.union(both)
    return out


def subdivide(rings: DataFrame, place, tolerance: float, rounds: int = 32) -> DataFrame:
    """Rings in another system (`place` of x and y) with as many vertices as keep every side within `tolerance` of the
    transformed straight one: sides whose transformed middle is further off are halved, round by round, each stored."""
    e = edges(rings).join(rings.select("component", "ring", "is_outer", "seq", F.col("x").alias("x1"), F.col("y").alias("y1")), ["component", "ring", "x1", "y1"])
    e = e.select("component", "ring", "is_outer", F.col("seq").cast("double").alias("at"), F.lit(1.0).alias("step"), "x1", "y1", "x2", "y2")
    done = None
    for _ in range(rounds):
        a, b, m = (place(F.col(f"x{k}"), F.col(f"y{k}")) for k in "12m")
        off = F.sqrt(sum((F.pow(m[i] - (a[i] + b[i]) / 2, 2) for i in (0, 1)), F.lit(0.0)))
        e = stash(e.withColumns({"xm": (F.col("x1") + F.col("x2")) / 2, "ym": (F.col("y1") + F.col("y2")) / 2}).withColumn("off", off), "mask-sides")
        good = e.filter(F.col("off") <= tolerance)
        done = good if done is None else done.union(good)
        far = e.filter(F.col("off") > tolerance)
        if far.isEmpty():
            break
        halves = F.explode(F.array(F.struct(F.col("at"), F.col("x1"), F.col("y1"), F.col("xm").alias("x2"), F.col("ym").alias("y2")), F.struct((F.col("at") + F.col("step") / 2).alias("at"), F.col("xm").alias("x1"), F.col("ym").alias("y1"), F.col("x2"), F.col("y2")))).alias("h")
        e = far.select("component", "ring", "is_outer", (F.col("step") / 2).alias("step"), halves).select("component", "ring", "is_outer", "h.at", "step", "h.x1", "h.y1", "h.x2", "h.y2")
    x, y = place(F.col("x1"), F.col("y1"))
    seq = F.row_number().over(Window.partitionBy("component", "ring").orderBy("at")) - 1
    return done.select("component", "ring", "is_outer", "at", x.alias("x"), y.alias("y")).withColumn("seq", seq).select("component", "ring", "is_outer", "seq", "x", "y")
