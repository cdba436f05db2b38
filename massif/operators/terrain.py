"""Terrain: cells that a dataset covers, windows to read for them, bounds in other systems, and meshes of patches."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree, srs
from massif.operators import raster, spatial
from massif.operators.index import with_ancestors

SAMPLES = 257  # along each side of bounds that are transformed


def covered_cells(boxes: DataFrame, space: octree.Space, deepest: int) -> DataFrame:
    """(level, index) of all cells down to a level that a dataset's boxes (lo_x..hi_z) meet: a descent from the root into the
    cells that are met, written as the deepest cells and their ancestors."""
    cover = octree.box_cover(space, F.lit(deepest), [F.col(f"lo_{a}") for a in "xyz"], [F.col(f"hi_{a}") for a in "xyz"], clip=True)
    cells = boxes.select(F.lit(deepest).cast("long").alias("level"), F.explode(cover).alias("index")).distinct()
    return with_ancestors(cells).select("level", "index").distinct()


def transformed_bounds(boxes: DataFrame, place: Callable[[Column, Column], tuple[Column, Column]], keys: list[str]) -> DataFrame:
    """(keys, lo_x, lo_y, hi_x, hi_y) of two-dimensional bounds in another system: of samples along all sides, widened by
    what a side may bend between two of them, one interval of the result."""
    k = F.explode(F.sequence(F.lit(0), F.lit(4 * SAMPLES - 1))).alias("k")
    t, side = (F.col("k") % SAMPLES) / (SAMPLES - 1), F.floor(F.col("k") / SAMPLES)
    w, h = F.col("hi_x") - F.col("lo_x"), F.col("hi_y") - F.col("lo_y")
    x = F.when(side == 0, F.col("lo_x")).when(side == 1, F.col("hi_x")).otherwise(F.col("lo_x") + w * t)
    y = F.when(side == 2, F.col("lo_y")).when(side == 3, F.col("hi_y")).otherwise(F.col("lo_y") + h * t)
    s = boxes.select(*keys, "lo_x", "lo_y", "hi_x", "hi_y", k).select(*keys, x.alias("_x"), y.alias("_y"))
    x, y = place(F.col("_x"), F.col("_y"))
    b = s.select(*keys, x.alias("x"), y.alias("y")).groupBy(*keys).agg(*[f(a).alias(f"{n}_{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in "xy"])
    by = {a: (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / (SAMPLES - 1) for a in "xy"}
    return b.select(*keys, *[(F.col(f"lo_{a}") - by[a]).alias(f"lo_{a}") for a in "xy"], *[(F.col(f"hi_{a}") + by[a]).alias(f"hi_{a}") for a in "xy"])


def geographic_coverage(boxes: DataFrame, keys: list[str], margin: float = 0.0) -> DataFrame:
    """(keys, lo_lon, hi_lon, lo_lat, hi_lat): longitudes and (spherical) latitudes of geocentric boxes (lo_x..hi_z), in
    degrees, widened by a margin. A box around the axis has all longitudes; one across the antimeridian has a high end over
    180."""
    z = [F.col("lo_z"), F.col("hi_z")]
    xs, ys = [F.col("lo_x"), F.col("hi_x")], [F.col("lo_y"), F.col("hi_y")]
    axis = (xs[0] <= 0) & (xs[1] >= 0) & (ys[0] <= 0) & (ys[1] >= 0)
    lon = [F.degrees(F.atan2(y, x)) for x in xs for y in ys]
    across = (ys[0] < 0) & (ys[1] >= 0) & (xs[1] < 0)  # beyond the antimeridian angles jump by a turn
    lon = [F.when(across & (v < 0), v + 360.0).otherwise(v) for v in lon]
    near = [F.when((a[0] <= 0) & (a[1] >= 0), 0.0).otherwise(F.least(F.abs(a[0]), F.abs(a[1]))) for a in (xs, ys)]
    far = [F.greatest(F.abs(a[0]), F.abs(a[1])) for a in (xs, ys)]
    radii = [F.sqrt(r[0] * r[0] + r[1] * r[1]) for r in (near, far)]
    lat = [F.degrees(F.atan2(v, r)) for v in z for r in radii]
    lo_lon, hi_lon = F.when(axis, -180.0).otherwise(F.least(*lon) - margin), F.when(axis, 180.0).otherwise(F.greatest(*lon) + margin)
    lo_lat, hi_lat = F.greatest(F.least(*lat) - margin, F.lit(-90.0)), F.least(F.greatest(*lat) + margin, F.lit(90.0))
    return boxes.select(*keys, lo_lon.alias("lo_lon"), hi_lon.alias("hi_lon"), lo_lat.alias("lo_lat"), hi_lat.alias("hi_lat"))


def mercator_coverage(geographic: DataFrame, keys: list[str]) -> DataFrame:
    """Web Mercator bounds of geographic ones, cut to the square of the map."""
    edge = math.degrees(math.atan(math.sinh(math.pi)))
    out = []
    for n in ("lo", "hi"):
        lat = F.least(F.greatest(F.col(f"{n}_lat"), F.lit(-edge)), F.lit(edge))
        x, y = srs.to_mercator(F.col(f"{n}_lon"), lat)
        out += [x.alias(f"{n}_x"), y.alias(f"{n}_y")]
    return geographic.select(*keys, *out)


def read_windows(coverage: DataFrame, datasets: DataFrame) -> DataFrame:
    """(id, dataset, lo_lon, hi_lon, lo_lat, hi_lat): what of each dataset (dataset and the same bounds, within -180..180) a
    cell's geographic coverage (id, ...) needs; longitudes wrap, so that a cell may have two windows. Both are dealt into
    cells of ten degrees."""
    def strips(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / 10).cast("long"), F.floor(hi / 10).cast("long")))

    c = coverage.select("id", F.explode(spatial.longitude_parts(F.col("lo_lon"), F.col("hi_lon"))).alias("p"), "lo_lat", "hi_lat")
    c = c.select("id", F.col("p.lo").alias("a"), F.col("p.hi").alias("b"), F.col("lo_lat").alias("c"), F.col("hi_lat").alias("d"))
    c = c.withColumn("cx", strips(F.col("a"), F.col("b"))).withColumn("cy", strips(F.col("c"), F.col("d")))
    d = datasets.withColumn("cx", strips(F.col("lo_lon"), F.col("hi_lon"))).withColumn("cy", strips(F.col("lo_lat"), F.col("hi_lat")))
    out = c.join(d, ["cx", "cy"]).select(
        "id", "dataset", F.greatest("a", "lo_lon").alias("lo_lon"), F.least("b", "hi_lon").alias("hi_lon"), F.greatest("c", "lo_lat").alias("lo_lat"), F.least("d", "hi_lat").alias("hi_lat"),
    )
    return out.filter("lo_lon < hi_lon and lo_lat < hi_lat").distinct()


def build_patches(pixels: DataFrame, windows: DataFrame, affine: tuple[float, ...], place: Callable[[Column, Column, Column], tuple[Column, ...]], *, value: str = "v", valid: str = "valid") -> DataFrame:
    """(id, x, y, a, b, c, u, polygon): the mesh of each patch. `windows` (id, px0, py0, px1, py1: half-open pixel windows;
    lo_x..hi_z: the patch's bounds) may overlap.

    A pixel goes to every window that has it, its quad's corners meet there, and valid quads make triangles whose corners
    are pixel centres, with uv over the window, taken through `affine` and `place` and cut to the bounds; triangles of no
    area go. Windows are joined on blocks of 32 by 32 pixels."""
    def blocks(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / 32).cast("long"), F.floor((hi - 1) / 32).cast("long")))

    w = windows.withColumn("_bx", blocks(F.col("px0"), F.col("px1"))).withColumn("_by", blocks(F.col("py0"), F.col("py1")))
    p = pixels.filter(valid).select("px", "py", F.col(value).cast("double").alias("_v")).withColumns({"_bx": F.floor(F.col("px") / 32).cast("long"), "_by": F.floor(F.col("py") / 32).cast("long")})
    own = p.join(w, ["_bx", "_by"]).filter((F.col("px") >= F.col("px0")) & (F.col("px") < F.col("px1")) & (F.col("py") >= F.col("py0")) & (F.col("py") < F.col("py1")))
    steps = ((0, 0), (1, 0), (1, 1), (0, 1))
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(steps)])).alias("o")
    sent = own.select(*windows.columns, "px", "py", "_v", corner)
    sent = sent.select(*windows.columns, (F.col("px") - F.col("o.dx")).alias("x"), (F.col("py") - F.col("o.dy")).alias("y"), F.col("o.k").alias("k"), "_v")
    quads = sent.groupBy(*windows.columns, "x", "y").agg(*[F.max(F.when(F.col("k") == i, F.col("_v"))).alias(f"v{i}") for i in range(4)])

    def at(i: int) -> Column:
        px, py = F.col("x") + steps[i][0] + 0.5, F.col("y") + steps[i][1] + 0.5
        x, y = raster.to_srs(px, py, affine)
        u = F.struct(((px - F.col("px0")) / (F.col("px1") - F.col("px0"))).alias("u"), ((py - F.col("py0")) / (F.col("py1") - F.col("py0"))).alias("v"))
        return F.struct(g.point(*place(x, y, F.col(f"v{i}"))).alias("p"), u.alias("uv"))

    def tri(i: int) -> Column:
        return F.array(*[at((i + j) % 4) for j in range(3)])

    def has(*k: int) -> Column:
        c = F.lit(True)
        for i in k:
            c = c & F.col(f"v{i}").isNotNull()
        return c

    none = F.slice(F.array(tri(0)), 1, 0)
    shape = F.when(has(0, 1, 2, 3), F.array(tri(0), tri(2))).when(has(0, 1, 2), F.array(tri(0))).when(has(1, 2, 3), F.array(tri(1))).when(has(2, 3, 0), F.array(tri(2))).when(has(3, 0, 1), F.array(tri(3))).otherwise(none)
    t = quads.select(*windows.columns, "x", "y", F.posexplode(shape).alias("k", "t"))
    walls = [F.struct(*[F.lit(s if a == m else 0.0).alias(f"n{m}") for m in "xyz"], (s * F.col(f"{'lo' if s > 0 else 'hi'}_{a}")).alias("d")) for s in (1.0, -1.0) for a in "xyz"]
    # Most triangles lie within their bounds whole: told without the functions over arrays that clipping takes.
    whole = F.lit(True)
    for i in range(3):
        for a in "xyz":
            whole = whole & F.col("t")[i]["p"][a].between(F.col(f"lo_{a}"), F.col(f"hi_{a}"))
    cut = F.when(whole, F.col("t.p").cast("array<struct<x:double,y:double,z:double>>")).otherwise(g.clip_by(F.col("t.p"), F.array(*walls)))
    out = t.select("id", "x", "y", F.col("k").cast("int").alias("k"), F.col("t.uv").alias("uv"), cut.alias("polygon"))
    return out.filter(F.size("polygon") >= 3)


def patch_meshes(patches: DataFrame) -> DataFrame:
    """(id, triangles, vertices): how many triangles and distinct corners each patch has after its polygons are fanned."""
    t = patches.select("id", F.explode(g.fan(F.col("polygon"))).alias("t"))
    n = t.groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    v = t.select("id", F.explode("t").alias("p")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("vertices"))
    return n.join(v, "id")
