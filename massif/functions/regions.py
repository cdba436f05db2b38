"""Regions given as texts: values, tiles or nodes, as Column functions that give bounds or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from massif.functions import octree, quadtree


def _numbers(text: Column, kind: str, most: int) -> tuple[Column, list[Column], list[Column]]:
    """How many parts a text has, the first of them as numbers, null where they are none, and for each whether it is a number
    or isn't there. Without functions over arrays, these stay in generated code."""
    parts = F.split(text, ",")
    n = F.size(parts)
    v = [F.trim(F.get(parts, F.lit(k))).try_cast(kind) for k in range(most)]
    return n, v, [x.isNotNull() | (n <= k) for k, x in enumerate(v)]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def bounds_of_values(text: Column) -> Column:
    """Bounds of "x,width,y,height" or "x,width,y,height,z,depth"; without heights they are open. Null for anything else."""
    n, v, fine = _numbers(text, "double", 6)
    inf = F.lit(float("inf"))
    z = F.when(n == 6, v[4]).otherwise(-inf), F.when(n == 6, v[4] + v[5]).otherwise(inf)
    return F.when(n.isin(4, 6) & _all(fine), F.struct(v[0].alias("lo_x"), v[2].alias("lo_y"), z[0].alias("lo_z"), (v[0] + v[1]).alias("hi_x"), (v[2] + v[3]).alias("hi_y"), z[1].alias("hi_z")))


def bounds_of_tile(text: Column) -> Column:
    """Web Mercator bounds of "zoom,x,y"; null for anything else or a tile that doesn't exist."""
    n, v, fine = _numbers(text, "long", 3)
    b = quadtree.tile_bounds(v[0], v[1], v[2])
    good = (n == 3) & _all(fine)
    return F.when(F.when(good, quadtree.valid(v[0], v[1], v[2])), F.struct(*[c.alias(n) for c, n in zip(b, ("lo_x", "lo_y", "hi_x", "hi_y"), strict=True)]))


def node_of(text: Column) -> Column:
    """(level, index) of "level,index" or "level,x,y,z"; null for anything else or a key that doesn't exist."""
    n, v, fine = _numbers(text, "long", 4)
    index = F.when(n == 2, v[1]).when(n == 4, octree.encode(*v[1:]))
    side = octree.cells_on(F.least(v[0], F.lit(octree.MAX_LEVEL)))
    inside = _all([(c >= 0) & (c < side) for c in v[1:]])
    good = n.isin(2, 4) & _all(fine)
    return F.when(F.when(good, octree.valid(v[0], index) & ((n == 2) | inside)), F.struct(v[0].alias("level"), index.alias("index")))
