"""Spatial joins. Points are dealt into cells and joined on them, so no join compares all with all."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions import octree
from massif.plans.shared import stash

XYZ = ("x", "y", "z")


def bucket(p: Column, eps: float) -> Column:
    return F.floor(p / eps).cast("long")


def distance2(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    d = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        d = d + (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
    return d


def dealt(df: DataFrame, eps: float, axes: tuple[str, ...], prefix: str) -> DataFrame:
    """Rows with `_cell`, once for each cell of side 3 eps that their reach of `eps` meets, known by a hash."""
    ends = []
    for a in axes:
        at = F.col(f"{prefix}{a}")
        reach = F.abs(at) * 1e-15 + eps * (1 + 1e-9)  # what rounding may add to a distance
        ends.append((bucket(at - reach, 3 * eps), bucket(at + reach, 3 * eps)))
    return df.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.xxhash64(*c) for c in product(*ends)]))))


def epsilon_join(left: DataFrame, right: DataFrame, eps: float, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Pairs of rows within `eps`, inclusive: columns of left as they are, of right with the prefix r_, and d2.

    A right row goes to the cells of side 3 eps that its reach meets: five in the mean, eight at most, where cells of side
    eps would take 27. It goes once to each hash of a cell, so a pair is met once even if two hashes are equal. No cap on
    neighbours. Null coordinates join nothing."""
    r = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns}).dropna(subset=[f"r_{a}" for a in axes])
    l = left.dropna(subset=list(axes)).withColumn("_cell", F.xxhash64(*[bucket(F.col(a), 3 * eps) for a in axes]))
    d2 = distance2(axes, tuple(f"r_{a}" for a in axes))
    return l.join(dealt(r, eps, axes, "r_"), "_cell").drop("_cell").withColumn("d2", d2).filter(F.col("d2") <= eps * eps)


def nearest(left: DataFrame, right: DataFrame, eps: float, *, left_id: str = "id", right_id: str = "id", axes: tuple[str, ...] = XYZ) -> DataFrame:
    """The nearest right row of each left row within `eps`, ties to the smallest right id; min_by combines before its
    shuffle, where a window would sort all pairs.

    Right rows of one position count once. Many of them are looked for in growing balls: the first is so small that, were
    all within one ball of `eps`, it would hold 8 if they lay evenly; left rows that find none go on with twice the
    radius. So pairs grow with the rows and not with their density."""
    right = stash(right.dropna(subset=list(axes)).groupBy(*axes).agg(F.min(right_id).alias(right_id)), "nearest-right")
    rounds = max(0, math.ceil(math.log2(max(right.count(), 1) / 8) / len(axes)))
    out, rest = None, left.select(left_id, *axes).dropna(subset=list(axes)).distinct()
    rest = stash(rest, "nearest-left") if rounds else rest
    for k in range(rounds, -1, -1):
        radius = eps / 2**k
        pairs = epsilon_join(rest, right, radius, axes).filter(F.col("d2") < radius * radius)
        best = F.min(F.struct("d2", F.col(f"r_{right_id}").alias("near")))
        found = pairs.groupBy(left_id).agg(best.alias("b")).select(left_id, "b.near", "b.d2")
        if k:
            found = stash(found, "nearest-found")
            rest = stash(rest.join(found.select(left_id), left_id, "left_anti"), "nearest-left")
        out = found if out is None else out.union(found)
    return out


def exact_join(left: DataFrame, right: DataFrame, axes: tuple[str, ...] = XYZ) -> DataFrame:
    """Rows of equal position."""
    return left.join(right.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in axes}), list(axes))


def on_sphere(df: DataFrame, radius: float) -> DataFrame:
    """Positions projected onto a sphere, for joins that ignore height."""
    n = F.sqrt(sum((F.col(a) * F.col(a) for a in XYZ), F.lit(0.0)))
    return df.withColumns({a: F.col(a) * radius / n for a in XYZ})


def nearest_ancestor(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """Each key with the deepest stored key that is itself or an ancestor (found_level, found_index); keys without one
    have none. Only the levels that hold something are looked at."""
    levels = sorted(r[0] for r in stored.select("level").distinct().collect())  # 22 at most
    above = F.filter(F.array(*[F.lit(v) for v in levels]).cast("array<long>"), lambda v: v <= F.col("level"))
    k = keys.select("level", "index", F.explode(above).alias("al")).withColumn("ai", octree.up(F.col("index"), F.col("level") - F.col("al")))
    s = stored.select(F.col("level").alias("al"), F.col("index").alias("ai"))
    hits = k.join(s, ["al", "ai"]).groupBy("level", "index").agg(F.max_by(F.struct("al", "ai"), "al").alias("a"))
    return keys.join(hits, ["level", "index"], "left").select("level", "index", F.col("a.al").alias("found_level"), F.col("a.ai").alias("found_index"))


def box_join(left: DataFrame, right: DataFrame, space: octree.Space, level: int) -> DataFrame:
    """Pairs of boxes (id, lo_x..hi_z) that meet, faces included: (l_id, r_id). Boxes are dealt over the cells of `level`
    they cover, joined on cells, and each pair is kept only in the cell of the low corner of what both cover."""
    size = space.extent / 2**level

    def dealt(df: DataFrame, p: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
        for a in XYZ:
            lo, hi = F.floor((F.col(f"{p}_lo_{a}") - space.low) / size), F.floor((F.col(f"{p}_hi_{a}") - space.low) / size)
            df = df.withColumn(f"c_{a}", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
        return df

    both = dealt(left, "l").join(dealt(right, "r"), [f"c_{a}" for a in XYZ])
    keep = F.lit(True)
    for a in XYZ:
        low = F.greatest(F.col(f"l_lo_{a}"), F.col(f"r_lo_{a}"))
        keep = keep & (low <= F.least(F.col(f"l_hi_{a}"), F.col(f"r_hi_{a}"))) & (F.floor((low - space.low) / size) == F.col(f"c_{a}"))
    return both.filter(keep).select("l_id", "r_id")


def region_filter(points: DataFrame, include: list[tuple], exclude: list[tuple]) -> DataFrame:
    """Points in any included box and in no excluded one; an empty list is no constraint. Boxes are (low, high) triples,
    low faces inside."""
    def inside(box) -> Column:
        c = F.lit(True)
        for a, lo, hi in zip(XYZ, *box, strict=True):
            c = c & (F.col(a) >= lo) & (F.col(a) < hi)
        return c

    def any_of(boxes) -> Column:
        c = F.lit(False)
        for b in boxes:
            c = c | inside(b)
        return c

    keep = (any_of(include) if include else F.lit(True)) & ~any_of(exclude)
    return points.filter(keep)


def octant(centre: tuple[float, float, float]) -> Column:
    """0..7: bit 0, 1, 2 set where x, y, z is at the centre or beyond."""
    o = F.lit(0)
    for k, (a, c) in enumerate(zip(XYZ, centre, strict=True)):
        o = o + F.when(F.col(a) >= c, 1 << k).otherwise(0)
    return o


def longitude_parts(low: Column, high: Column) -> Column:
    """A longitude range as one or two ranges within -180..180."""
    width = high - low
    a = F.pmod(low + 180.0, F.lit(360.0)) - 180.0
    whole = F.array(F.struct(F.lit(-180.0).alias("lo"), F.lit(180.0).alias("hi")))
    one = F.array(F.struct(a.alias("lo"), (a + width).alias("hi")))
    two = F.array(F.struct(a.alias("lo"), F.lit(180.0).alias("hi")), F.struct(F.lit(-180.0).alias("lo"), (a + width - 360.0).alias("hi")))
    return F.when(width >= 360.0, whole).when(a + width > 180.0, two).otherwise(one)


def tile_cover(tiles: DataFrame, depth: int) -> DataFrame:
    """The tiles (zoom, x, y) to paint, coarse first: a tile is left out if its children, themselves or through theirs,
    cover it. Bottom-up, one small aggregation a level."""
    covered = tiles.filter(F.col("zoom") == depth).select("zoom", "x", "y")
    needed = covered
    for zoom in range(depth - 1, -1, -1):
        full = covered.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.count(F.lit(1)).alias("n")).filter("n = 4").select("x", "y")
        own = tiles.filter(F.col("zoom") == zoom).select("x", "y")
        needed = needed.union(own.join(full, ["x", "y"], "left_anti").select(F.lit(zoom).cast("long").alias("zoom"), "x", "y"))
        covered = own.union(full).distinct().select(F.lit(zoom).cast("long").alias("zoom"), "x", "y")
    return needed


def rank_by_distance(df: DataFrame, eye: tuple[float, ...], n: int) -> DataFrame:
    """The n nearest rows to a point."""
    d = F.lit(0.0)
    for a, e in zip(XYZ, eye, strict=True):
        d = d + F.pow(F.col(a) - e, 2)
    return df.withColumn("d2", d).orderBy("d2", "id").limit(n)


def first_by(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
