"""Raster algebra on pixel tables (px, py, value columns)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AT = ["px", "py"]


def pixel_map(df: DataFrame, **cells: Column) -> DataFrame:
    return df.withColumns(cells)


def zip_with(*rasters: DataFrame) -> DataFrame:
    """Pixels of equal place side by side; a place that one raster lacks is an error of size, which shows as a null."""
    out = rasters[0]
    for r in rasters[1:]:
        out = out.join(r, AT, "full_outer")
    return out


def fold(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold of a row-major array."""
    return F.aggregate(values, start, step)


def rows_of(df: DataFrame, value: str = "v") -> DataFrame:
    """(py, values) with the values of each row in order."""
    return df.groupBy("py").agg(F.transform(F.sort_array(F.collect_list(F.struct("px", value))), lambda s: s[value]).alias("values"))


def window(df: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of a half-open window; the comparisons reach the scan."""
    return df.filter((F.col("px") >= x0) & (F.col("px") < x1) & (F.col("py") >= y0) & (F.col("py") < y1))


def strided(df: DataFrame, step: int) -> DataFrame:
    """Every step-th sample on each axis."""
    return df.filter((F.col("px") % step == 0) & (F.col("py") % step == 0)).withColumns({c: F.floor(F.col(c) / step).cast("long") for c in AT})


def encode_linear(value: Column, kind: str, low: float | None = None, high: float | None = None) -> Column:
    """Round half away from zero, clamp, cast."""
    v = F.round(value)
    if low is not None:
        v = F.least(F.greatest(v, F.lit(low)), F.lit(high))
    return v.cast(kind)


def decode_srgb(v: Column) -> Column:
    s = v / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4))


def encode_srgb(v: Column) -> Column:
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055)
    return encode_linear(s * 255.0, "long", 0.0, 255.0)


def _quads(df: DataFrame, x: Column, y: Column):
    return df.groupBy(F.floor(x / 2).cast("long").alias("px"), F.floor(y / 2).cast("long").alias("py"))


def place() -> Column:
    """Position of a sample in its block of four: (0,0), (1,0), (0,1), (1,1)."""
    return (F.col("py") % 2) * 2 + F.col("px") % 2


def reduce_min(v: Column) -> Column:
    return F.min(v)


def reduce_max(v: Column) -> Column:
    return F.max(v)


def reduce_mean(v: Column) -> Column:
    """Box average, rounded half away from zero for integers."""
    return F.round(F.avg(v)).cast("long")


def reduce_median(v: Column) -> Column:
    """Midpoint of the two middle of four values, half away from zero."""
    s = F.sort_array(F.collect_list(v))
    return F.round((s[1] + s[2]) / 2).cast("long")


def reduce_first(v: Column) -> Column:
    """The sample at the block's corner, which decimation keeps."""
    return F.min_by(v, place())


def halve(df: DataFrame, levels: int = 1, **reducers: Callable[[Column], Column]) -> DataFrame:
    """Blocks of 2 by 2 reduced, level by level: each level is encoded before the next, as integer rounding doesn't
    compose. `reducers` name the columns kept."""
    for _ in range(levels):
        df = _quads(df, F.col("px"), F.col("py")).agg(*[r(F.col(c)).alias(c) for c, r in reducers.items()])
    return df


def mode_of_block(df: DataFrame, column: str) -> DataFrame:
    """(px, py, column): the most frequent value of each block of four, the first of equals in row order."""
    counted = df.groupBy(F.floor(F.col("px") / 2).cast("long").alias("_x"), F.floor(F.col("py") / 2).cast("long").alias("_y"), column)
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.min(place()).alias("first"))
    best = counted.groupBy("_x", "_y").agg(F.max_by(column, F.struct("n", -F.col("first"))).alias(column))
    return best.withColumnsRenamed({"_x": "px", "_y": "py"})


def require_divisible(width: int, height: int, levels: int) -> None:
    if width % 2**levels or height % 2**levels:
        raise ValueError("InvalidInput: the interior isn't divisible by two to the number of levels")


def halo(method_taps: int, levels: int, *, down: bool = True) -> int:
    """Pixels needed beyond a window."""
    return (2 * method_taps - 1) * (2**levels - 1) if down else method_taps


def gaussian_kernel(size: int) -> list[float]:
    """Normalised weights for an odd size, with sigma a quarter of size - 1."""
    sigma, mid = (size - 1) / 4, size // 2
    w = [math.exp(-((i - mid) ** 2) / (2 * sigma * sigma)) if sigma else 1.0 for i in range(size)]
    return [x / sum(w) for x in w]


def lanczos(d: float, a: int) -> float:
    def sinc(x: float) -> float:
        return 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)

    return sinc(d) * sinc(d / a) if abs(d) < a else 0.0


def lanczos_down_kernel(a: int) -> list[float]:
    """4a weights of a halving of cell centres, normalised; the first tap is 2a - 1 before the block."""
    w = [lanczos((k - (2 * a - 1) - 0.5) / 2, a) for k in range(4 * a)]
    return [x / sum(w) for x in w]


def upscale_taps(factor: int, radius: int) -> list[list[tuple[int, float]]]:
    """(offset, weight) of the taps of each phase for cell centres: nearest for radius 0, linear for 1, else Lanczos."""
    out = []
    for r in range(factor):
        if radius == 0:
            out.append([(0, 1.0)])
            continue
        phase = (r + 0.5) / factor - 0.5
        base, f = (-1, phase + 1) if phase < 0 else (0, phase)
        at = range(1 - radius, radius + 1)
        w = [max(0.0, 1 - abs(i - f)) if radius == 1 else lanczos(i - f, radius) for i in at]
        out.append([(base + i, x / sum(w)) for i, x in zip(at, w, strict=True)])
    return out


def stencil(df: DataFrame, kernel: list[tuple[int, int, float]], width: int, height: int, value: str = "v", *, clamp: bool = False, stride: int = 1) -> DataFrame:
    """(px, py, value): the sum of the weighted values under a kernel of (dx, dy, weight).

    Each pixel is sent to the places it contributes to, and contributions are summed before the shuffle: no self-join.
    With `clamp` the border is replicated; without, only complete windows are kept, whose first offset is (0, 0)."""
    if clamp:
        taps = _clamped(df, kernel, width, height, value)
    else:
        offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(w)).alias("w")) for dx, dy, w in kernel])
        taps = df.select("px", "py", value, F.explode(offsets).alias("k")).select((F.col("px") - F.col("k.dx")).alias("px"), (F.col("py") - F.col("k.dy")).alias("py"), (F.col(value) * F.col("k.w")).alias(value))
        kx, ky = max(k[0] for k in kernel), max(k[1] for k in kernel)
        taps = taps.filter(F.col("px").between(0, width - 1 - kx) & F.col("py").between(0, height - 1 - ky) & (F.col("px") % stride == 0) & (F.col("py") % stride == 0))
    out = taps.groupBy("px", "py").agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(kernel)).drop("_n")
    return out if clamp or stride == 1 else out.withColumns({c: F.floor(F.col(c) / stride).cast("long") for c in AT})


def _clamped(df: DataFrame, kernel, width: int, height: int, value: str) -> DataFrame:
    """Contributions with edge replication. Axis by axis, the places that read a pixel are those at its offset and, at a
    border, all those whose offset leads beyond it."""
    def readers(c: Column, d: Column, size: int) -> Column:
        """Places p with min(max(p + d, 0), size - 1) = c."""
        low = F.when(c == 0, F.lit(0)).otherwise(F.greatest(c - d, F.lit(0)))
        high = F.when(c == size - 1, F.lit(size - 1)).otherwise(F.least(c - d, F.lit(size - 1)))
        return F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>"))

    offsets = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy"), F.lit(float(w)).alias("w")) for dx, dy, w in kernel])
    rows = df.select("px", "py", value, F.explode(offsets).alias("k"))
    rows = rows.select(readers(F.col("px"), F.col("k.dx"), width).alias("xs"), readers(F.col("py"), F.col("k.dy"), height).alias("ys"), (F.col(value) * F.col("k.w")).alias(value))
    return rows.select(F.explode("xs").alias("px"), "ys", value).select("px", F.explode("ys").alias("py"), value)


def separable(df: DataFrame, taps: list[tuple[int, float]], width: int, height: int, value: str = "v") -> DataFrame:
    """A clamped separable filter: across, then down."""
    across = stencil(df, [(d, 0, w) for d, w in taps], width, height, value, clamp=True)
    return stencil(across, [(0, d, w) for d, w in taps], width, height, value, clamp=True)


def lanczos_down(df: DataFrame, a: int, width: int, height: int, value: str = "v") -> DataFrame:
    """Halving with Lanczos weights, borders replicated."""
    taps = [(k - (2 * a - 1), w) for k, w in enumerate(lanczos_down_kernel(a))]
    return strided(separable(df.select("px", "py", F.col(value).cast("double").alias(value)), taps, width, height, value), 2)


def upscale(df: DataFrame, factor: int, radius: int, width: int, height: int, value: str = "v") -> DataFrame:
    """Upscaling of cell centres by a factor: nearest, linear or Lanczos by radius, borders replicated."""
    def along(d: DataFrame, axis: str, w: int, h: int) -> DataFrame:
        parts = []
        for r, taps in enumerate(upscale_taps(factor, radius)):
            merged = [(o, 0, x) if axis == "px" else (0, o, x) for o, x in taps]
            parts.append(stencil(d, merged, w, h, value, clamp=True).withColumn(axis, F.col(axis) * factor + r))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    df = df.select("px", "py", F.col(value).cast("double").alias(value))
    return along(along(df, "px", width, height), "py", width * factor, height)


def upscale_nodes(df: DataFrame, value: str = "v") -> DataFrame:
    """Linear doubling of grid nodes: retained nodes are copied, the ones between are means of two neighbours on an axis.
    2n - 1 nodes from n."""
    def along(d: DataFrame, axis: str) -> DataFrame:
        other = "py" if axis == "px" else "px"
        following = F.lead(value).over(Window.partitionBy(other).orderBy(axis))
        pair = d.withColumn("_next", following)
        kept = pair.select(other, (F.col(axis) * 2).alias(axis), value)
        between = pair.filter("_next is not null").select(other, (F.col(axis) * 2 + 1).alias(axis), ((F.col(value) + F.col("_next")) / 2).alias(value))
        return kept.unionByName(between)

    return along(along(df.select("px", "py", F.col(value).cast("double").alias(value)), "px"), "py")


def dilate(df: DataFrame, width: int, height: int, value: str = "v", covered: str = "valid", rounds: int = 1) -> DataFrame:
    """Uncovered pixels take the mean of the covered ones around them; rounds are synchronous."""
    for _ in range(rounds):
        near = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])).alias("k")
        given = df.filter(covered).select("px", "py", value, near).select((F.col("px") + F.col("k.dx")).alias("px"), (F.col("py") + F.col("k.dy")).alias("py"), F.col(value).alias("_g"))
        mean = given.groupBy("px", "py").agg(F.avg("_g").alias("_m"))
        joined = df.join(mean, AT, "left")
        df = joined.select("px", "py", F.when(F.col(covered), F.col(value).cast("double")).otherwise(F.coalesce("_m", F.col(value).cast("double"))).alias(value), (F.col(covered) | F.col("_m").isNotNull()).alias(covered))
    return df


def replace_invalid(value: Column, valid: Column, default: Column) -> Column:
    v = value.cast("double")
    return F.when(valid & ~F.isnan(v) & (F.abs(v) != float("inf")), value).otherwise(default)


def to_srs(px: Column, py: Column, g: tuple[float, ...]) -> tuple[Column, Column]:
    """Affine pixel to map coordinates from six coefficients."""
    return g[0] + px * g[1] + py * g[2], g[3] + px * g[4] + py * g[5]


def to_pixel(x: Column, y: Column, g: tuple[float, ...]) -> tuple[Column, Column]:
    det = g[1] * g[5] - g[2] * g[4]
    dx, dy = x - g[0], y - g[3]
    return (dx * g[5] - dy * g[2]) / det, (dy * g[1] - dx * g[4]) / det


def srs_window(df: DataFrame, low: tuple[float, float], high: tuple[float, float], g: tuple[float, ...]) -> DataFrame:
    """Pixels under map bounds, rounded outwards: computed on the driver, so that plain comparisons reach the scan."""
    det = g[1] * g[5] - g[2] * g[4]
    corners = [((x - g[0]) * g[5] - (y - g[3]) * g[2], (y - g[3]) * g[1] - (x - g[0]) * g[4]) for x in (low[0], high[0]) for y in (low[1], high[1])]
    xs, ys = [c[0] / det for c in corners], [c[1] / det for c in corners]
    return window(df, math.floor(min(xs)), math.floor(min(ys)), math.ceil(max(xs)), math.ceil(max(ys)))


def clamped_window(df: DataFrame, x0: int, y0: int, x1: int, y1: int, width: int, height: int) -> DataFrame:
    """window() with both corners first clamped to the last pixel: as the high corner is outside, the last row and column
    are reached by window() alone."""
    x0, x1 = (min(max(v, 0), width - 1) for v in (x0, x1))
    y0, y1 = (min(max(v, 0), height - 1) for v in (y0, y1))
    return window(df, x0, y0, x1, y1)


def describe(df: DataFrame, valid: str = "valid", value: str = "v") -> DataFrame:
    """One row: bounds in pixels, bounds of the valid values, pixels, valid pixels."""
    v = F.when(F.col(valid), F.col(value))
    return df.agg(
        *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in AT], F.min(v).alias("lo_v"), F.max(v).alias("hi_v"),
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col(valid)).alias("valid_pixels"),
    )


def all_valid(*masks: Column) -> Column:
    """Validity of a pixel of several bands: where every band's mask is set; a null mask sets all."""
    return F.least(*[F.coalesce(m.cast("int"), F.lit(255)) for m in masks]) > 0


def not_known_empty(targets: DataFrame, sources: DataFrame, margin: float) -> DataFrame:
    """Targets (lo_x, lo_y, hi_x, hi_y) that a source tile of the same columns, side at most one unit, may reach when they are
    widened by a share of their size: others need no warping. Equal targets count once. Both sides are dealt into cells of
    one unit; boxes that many rows share are compared once, however many there are."""
    def cells(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo).cast("long"), F.floor(hi).cast("long")))

    box = [f"{p}_{a}" for p in ("lo", "hi") for a in "xy"]
    t = targets.select(*box).distinct()
    for a in "xy":
        by = (F.col(f"hi_{a}") - F.col(f"lo_{a}")) * margin
        t = t.withColumns({f"_lo_{a}": F.col(f"lo_{a}") - by, f"_hi_{a}": F.col(f"hi_{a}") + by})
    t = t.withColumn("_cx", cells(F.col("_lo_x"), F.col("_hi_x"))).withColumn("_cy", cells(F.col("_lo_y"), F.col("_hi_y")))
    s = sources.select(*[F.col(f"{p}_{a}").alias(f"_s{p}_{a}") for p in ("lo", "hi") for a in "xy"]).distinct()
    s = s.withColumn("_cx", cells(F.col("_slo_x"), F.col("_shi_x"))).withColumn("_cy", cells(F.col("_slo_y"), F.col("_shi_y")))
    meets = F.lit(True)
    for a in "xy":
        meets = meets & (F.col(f"_slo_{a}") <= F.col(f"_hi_{a}")) & (F.col(f"_shi_{a}") >= F.col(f"_lo_{a}"))
    reached = t.join(s, ["_cx", "_cy"]).filter(meets).select(*box).distinct()
    return targets.distinct().join(reached, box, "left_semi").select(*targets.columns)


def warp(source: DataFrame, target: DataFrame, sx: Column, sy: Column, value: str = "v", valid: str = "valid") -> DataFrame:
    """(px, py, value, valid) of `target` pixels (px, py, ...), sampled from `source` at the source place (sx, sy, in pixels
    whose centres are at one half) of each: bilinear over the valid ones of four neighbours; a pixel is valid if any has a
    weight, else its value is zero. Every output pixel asks for four source pixels by their keys; nothing is collected."""
    fx, fy = F.floor(F.col("_sx") - 0.5), F.floor(F.col("_sy") - 0.5)
    t = target.withColumns({"_sx": sx, "_sy": sy}).withColumns({"_fx": fx, "_fy": fy}).withColumns({"_wx": F.col("_sx") - 0.5 - F.col("_fx"), "_wy": F.col("_sy") - 0.5 - F.col("_fy")})
    taps = F.array(*[
        F.struct((F.col("_fx") + i).cast("long").alias("x"), (F.col("_fy") + j).cast("long").alias("y"), ((F.col("_wx") if i else 1 - F.col("_wx")) * (F.col("_wy") if j else 1 - F.col("_wy"))).alias("w"))
        for i in (0, 1) for j in (0, 1)
    ])
    asked = t.select("px", "py", F.explode(taps).alias("t")).select("px", "py", "t.x", "t.y", "t.w")
    s = source.filter(valid).select(F.col("px").alias("x"), F.col("py").alias("y"), F.col(value).cast("double").alias("_v"))
    met = asked.join(s, ["x", "y"], "left").groupBy("px", "py").agg(F.sum(F.when(F.col("_v").isNotNull(), F.col("w"))).alias("_w"), F.sum(F.col("_v") * F.col("w")).alias("_s"))
    good = F.coalesce(F.col("_w") > 0, F.lit(False))
    return met.select("px", "py", F.when(good, F.col("_s") / F.col("_w")).otherwise(0.0).alias(value), good.alias(valid))


def native_pixel_size(boxes: DataFrame, place: Callable[[Column, Column], tuple[Column, Column]], step: float = 1e-3, samples: int = 5) -> DataFrame:
    """(id, size): the least size, in map units, of a source pixel within bounds (id, lo_x, lo_y, hi_x, hi_y): at a grid of
    samples, one over the summed changes of the source place (`place` of x and y) with x and y."""
    k = F.explode(F.sequence(F.lit(0), F.lit(samples * samples - 1))).alias("k")
    at = boxes.select("*", k).withColumns({
        "_x": F.col("lo_x") + (F.col("hi_x") - F.col("lo_x")) * ((F.col("k") % samples) / (samples - 1)), "_y": F.col("lo_y") + (F.col("hi_y") - F.col("lo_y")) * (F.floor(F.col("k") / samples) / (samples - 1)),
    })
    x, y = F.col("_x"), F.col("_y")
    here, right, above = place(x, y), place(x + step, y), place(x, y + step)
    change = sum((F.abs(p - q) for other in (right, above) for p, q in zip(other, here, strict=True)), F.lit(0.0)) / step
    return at.groupBy("id").agg(F.min(1 / change).alias("size"))


def lanczos_node_kernel(a: int) -> list[float]:
    """4a - 1 weights of a halving of grid nodes, whose retained nodes are samples themselves: a half-band filter."""
    w = [lanczos(k / 2, a) for k in range(1 - 2 * a, 2 * a)]
    return [x / sum(w) for x in w]


def lanczos_nodes_down(df: DataFrame, a: int, width: int, height: int, value: str = "v") -> DataFrame:
    """(n + 1) / 2 grid nodes from n on each axis."""
    taps = [(k - (2 * a - 1), w) for k, w in enumerate(lanczos_node_kernel(a))]
    return strided(separable(df.select("px", "py", F.col(value).cast("double").alias(value)), taps, width, height, value), 2)


def source_window(low: int, size: int, levels: int, taps: int, whole: int) -> tuple[int, int]:
    """First and last-but-one source pixel that `size` pixels from `low`, after `levels` halvings, depend on: each level
    reaches 2 * taps - 1 further, and a window begins at a multiple of two to the number of levels."""
    a, b = low << levels, (low + size) << levels
    reach, unit = halo(taps, levels), 1 << levels
    return max(0, (a - reach) // unit * unit), min(whole, -(-(b + reach) // unit) * unit)


def lanczos_window(df: DataFrame, a: int, levels: int, low: tuple[int, int], size: tuple[int, int], width: int, height: int, value: str = "v") -> DataFrame:
    """A window of the pixels that lanczos_down() gives after some levels, from the source pixels it depends on: their
    bounds reach the scan."""
    (x0, x1), (y0, y1) = (source_window(low[k], size[k], levels, a, (width, height)[k]) for k in (0, 1))
    part = window(df, x0, y0, x1, y1).select((F.col("px") - x0).alias("px"), (F.col("py") - y0).alias("py"), value)
    w, h = x1 - x0, y1 - y0
    require_divisible(w, h, levels)
    for _ in range(levels):
        part, w, h = lanczos_down(part, a, w, h, value), w // 2, h // 2
    part = part.select((F.col("px") + (x0 >> levels)).alias("px"), (F.col("py") + (y0 >> levels)).alias("py"), value)
    return window(part, low[0], low[1], low[0] + size[0], low[1] + size[1])


def window_function(df: DataFrame, side: int, f: Callable[[Column], Column], width: int, height: int, value: str = "v") -> DataFrame:
    """(px, py, value): f of the row-major array of each complete window of side by side pixels, named by its first one."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in range(side) for i in range(side)])).alias("s")
    sent = df.select("px", "py", value, steps).select((F.col("px") - F.col("s.i")).alias("px"), (F.col("py") - F.col("s.j")).alias("py"), F.struct(F.col("s.j").alias("j"), F.col("s.i").alias("i"), F.col(value).alias("v")).alias("c"))
    inside = sent.filter(F.col("px").between(0, width - side) & F.col("py").between(0, height - side))
    cells = inside.groupBy("px", "py").agg(F.sort_array(F.collect_list("c")).alias("c")).filter(F.size("c") == side * side)
    return cells.select("px", "py", f(F.transform("c", lambda c: c["v"])).alias(value))


def converted(reduce: Callable[[Column], Column], decode: Callable[[Column], Column], encode: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A reducer that works on decoded samples."""
    return lambda v: encode(reduce(decode(v)))


def pixel_type(sample: str, bands: int = 1) -> str:
    """The name of a pixel type: of a sample, or of a vector of them."""
    if sample not in ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64", "float32", "float64") or not 1 <= bands <= 4:
        raise ValueError(f"no pixel type of {bands} {sample}")
    return sample if bands == 1 else f"vec{bands}<{sample}>"
