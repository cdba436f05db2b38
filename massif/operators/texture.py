"""Textures as tables: deduplication, sharing, atlas plans, and painting of tiles."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def deduplicate(textures: DataFrame, content: str, order: str) -> DataFrame:
    """(content, texture_id): dense ids of distinct contents in the order of their first use. Contents are compared by a
    digest; the numbering sees one row a distinct content."""
    first = textures.groupBy(F.sha2(F.col(content).cast("string"), 256).alias("_d")).agg(F.min(order).alias("_first"), F.first(content).alias(content))
    return first.withColumn("texture_id", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long")).select(content, "texture_id")


def shared(assigned: DataFrame, group: str, texture: str) -> DataFrame:
    """(group, texture) of groups that use one texture only, which can be inherited."""
    found = assigned.groupBy(group).agg(F.min(texture).alias("_a"), F.max(texture).alias("_b"), F.count(F.lit(1)).alias("_n"), F.count(texture).alias("_k"))
    return found.filter("_a = _b and _n = _k").select(group, F.col("_a").alias(texture))


def strip_plan(images: DataFrame, node: str, order: str) -> DataFrame:
    """`images` (w, h) with their place x in a horizontal strip for each node, and the strip's width and height."""
    w = Window.partitionBy(node)
    before = F.sum("w").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("w")
    return images.withColumns({"x": before, "atlas_w": F.sum("w").over(w), "atlas_h": F.max("h").over(w)})


def remap_uv(df: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Texture coordinates of an image as those of its strip."""
    return df.withColumns({u: (F.col("x") + F.col(u) * F.col("w")) / F.col("atlas_w"), v: F.col(v) * F.col("h") / F.col("atlas_h")})


def splat(tiles: DataFrame, target_zoom: int, value: str) -> DataFrame:
    """(x, y, value) of every pixel of the target zoom that a tile covers: finer tiles paint over coarser ones. Painted in
    one aggregation, as the finest tile is all that is seen."""
    d = F.lit(target_zoom) - F.col("zoom")
    side = F.call_function("shiftleft", F.lit(1).cast("long"), d.cast("int"))

    def span(c: str):
        return F.sequence(F.col(c) * side, (F.col(c) + 1) * side - 1)

    px = tiles.filter(F.col("zoom") <= target_zoom).select("zoom", value, F.explode(span("x")).alias("_x"), span("y").alias("_ys")).select("zoom", value, "_x", F.explode("_ys").alias("_y"))
    return px.groupBy(F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.max_by(value, "zoom").alias(value))

class _Skyline:
    """Free space above a row of segments (x, y, width) in a square of a fixed side."""

    def __init__(self, side: int):
        self.side, self.line = side, [(0, 0, side)]

    def lowest(self, w: int, h: int) -> tuple[int, int] | None:
        """(y, x) of the lowest, then leftmost, place for a rectangle; None if there is none."""
        best = None
        for i, (x, _, _) in enumerate(self.line):
            if x + w > self.side:
                break
            y, j = 0, i
            while j < len(self.line) and self.line[j][0] < x + w:
                y, j = max(y, self.line[j][1]), j + 1
            if y + h <= self.side and (best is None or (y, x) < best):
                best = (y, x)
        return best

    def put(self, x: int, y: int, w: int, h: int) -> None:
        after = [(x, y + h, w)]
        for sx, sy, sw in self.line:
            for lo, hi in ((sx, min(sx + sw, x)), (max(sx, x + w), sx + sw)):
                if lo < hi:
                    after.append((lo, sy, hi - lo))
        self.line = sorted(after)


def pack_rectangles(sizes: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int, int]:
    """Places (x, y) of rectangles (w, h) that don't overlap, unturned, and the width and height they take. They go, the
    tallest first, to the lowest place of a square that grows by a twentieth until all fit. Rectangles without area lie at
    the origin."""
    order = sorted((i for i, (w, h) in enumerate(sizes) if w > 0 and h > 0), key=lambda i: (-sizes[i][1], -sizes[i][0], i))
    places = [(0, 0)] * len(sizes)
    if not order:
        return places, 0, 0
    side = max(math.isqrt(sum(sizes[i][0] * sizes[i][1] for i in order)), *[max(sizes[i]) for i in order])
    while True:
        sky = _Skyline(side)
        for i in order:
            at = sky.lowest(*sizes[i])
            if at is None:
                break
            places[i] = (at[1], at[0])
            sky.put(at[1], at[0], *sizes[i])
        else:
            return places, max(places[i][0] + sizes[i][0] for i in order), max(places[i][1] + sizes[i][1] for i in order)
        side += max(1, side // 20)


def square_plan(images: DataFrame, node: str, order: str) -> DataFrame:
    """`images` (w, h) with their place x, y in a near-square atlas for each node, and its width and height. A null or
    negative size counts as zero. A node holds the images of one tile's clusters, a few hundred at most; nodes are packed
    apart, in Arrow batches."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        places, w, h = pack_rectangles([(int(a), int(b)) for a, b in zip(pdf["_w"], pdf["_h"], strict=True)])
        return pdf.drop(columns=["_w", "_h"]).assign(x=[p[0] for p in places], y=[p[1] for p in places], atlas_w=w, atlas_h=h)

    kept = [c for c in images.columns if c not in ("x", "y", "atlas_w", "atlas_h")]
    sized = images.select(*kept, *[F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(f"_{c}") for c in "wh"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema if f.name in kept)
    return sized.groupBy(node).applyInPandas(plan, f"{schema}, x long, y long, atlas_w long, atlas_h long")
