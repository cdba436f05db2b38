"""Queries on textures made anew for a coarser mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.operators import bake
from massif.plans import fixtures as fx
from massif.plans.registry import query
from massif.plans.shared import stash

SCALE = 2  # texels of the new texture along a pixel of the old one
SIDE = 2  # pixels along a block


def _two(x: Column, y: Column, side: int, key: Column) -> list[tuple[Column, list[tuple[Column, Column]]]]:
    """The two triangles of a square, with numbers."""
    p = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [(key * 2, [p[0], p[1], p[2]]), (key * 2 + 1, [p[2], p[3], p[0]])]


def _rows(squares: DataFrame, key: str, side: int, scale: float, *rest: str) -> DataFrame:
    """Triangles (key, rest, ax..cz, u0..v2) of squares (x, y, _k) that lie on a slope, their textures `scale` as fine."""
    out = [
        F.struct(n.alias(key), *[c.cast("double").alias(f"{k}{a}") for k, (x, y) in zip("abc", p, strict=True) for a, c in (("x", x), ("y", y), ("z", x * 0.5 + y * 0.25))], *[(c * scale).cast("double").alias(f"{a}{i}") for i, (x, y) in enumerate(p) for a, c in (("u", x), ("v", y))])
        for n, p in _two(F.col("x"), F.col("y"), side, F.col("_k"))
    ]
    return squares.select(*rest, F.explode(F.array(*out)).alias("t")).select(*rest, "t.*")


# A texel's centre is half a pixel's half from its border, so its place lies in one pixel; a block is two triangles.
@query("texture_bake", f"WITH {fx.GROWN_PX}, b AS (SELECT DISTINCT px // {SIDE} AS bx, py // {SIDE} AS by_ FROM px WHERE valid), d AS (SELECT unnest(range({SIDE * SCALE})) AS d), t AS (SELECT bx * {SIDE * SCALE} + i.d AS tx, by_ * {SIDE * SCALE} + j.d AS ty FROM b, d i, d j) SELECT CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, px.v AS value FROM t JOIN px ON px.px = tx // {SCALE} AND px.py = ty // {SCALE} AND px.valid")
def _(spark, sf):
    """The values of valid pixels, baked from triangles of their own into those of blocks; what no pixel covers is left out."""
    p = stash(fx.grown_pixels(spark, sf).filter("valid"), "bake-pixels")
    block = [F.floor(F.col(c) / SIDE).cast("long").alias(n) for c, n in (("px", "_bx"), ("py", "_by"))]
    images = p.select(F.lit(0).alias("image"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("v").alias("value"))
    fine = p.select(F.col("px").alias("x"), F.col("py").alias("y"), (F.col("py") * 256 + F.col("px")).alias("_k"), *block, F.lit(0).alias("image"))
    sources = stash(_rows(fine, "sid", 1, 1.0, "_bx", "_by", "image"), "bake-sources")
    blocks = p.select(*block).distinct().select((F.col("_bx") * SIDE).alias("x"), (F.col("_by") * SIDE).alias("y"), (F.col("_by") * 256 + F.col("_bx")).alias("_k"), "_bx", "_by")
    targets = stash(_rows(blocks, "tid", SIDE, float(SCALE), "_bx", "_by"), "bake-targets")
    pairs = targets.select("tid", "_bx", "_by").join(sources.select("sid", "_bx", "_by"), ["_bx", "_by"]).select("tid", "sid")
    # Sources of a block don't cover it where pixels are missing: there the nearest one is another pixel, and isn't asked for.
    made = bake.bake(targets, sources, pairs, images)
    whole = p.select(F.col("px"), F.col("py"))
    at = [F.floor(F.col(c) / SCALE).cast("long").alias(n) for c, n in (("tx", "px"), ("ty", "py"))]
    return made.select("tx", "ty", "value", *at).join(whole, ["px", "py"], "left_semi").select("tx", "ty", "value")
