"""Textures made anew for a mesh from those of the meshes it was made of: texels of the new texture are found triangle by
triangle, each looks for the nearest point of the old surface, and takes its colour there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions import geometry as g


def rasterise(triangles: DataFrame, *keep: str) -> DataFrame:
    """(tid, tx, ty, w0, w1, w2, *keep): the texels whose centres a triangle (tid, u0, v0, u1, v1, u2, v2; in texels) holds,
    its border included, with their barycentric weights. Rows of texels come first and then each row's own span, so only
    texels near the triangle are made; triangles without area hold none."""
    corners = [g.point(F.col(f"u{k}"), F.col(f"v{k}"), F.lit(0.0)) for k in range(3)]
    v = [F.col(f"v{k}") for k in range(3)]
    t = triangles.filter(g.orient_2d(*corners) != 0)
    low, high = F.ceil(F.least(*v) - 0.5), F.floor(F.greatest(*v) - 0.5)
    t = t.filter(low <= high).withColumn("ty", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    at, ends = F.col("ty") + 0.5, []
    for i in range(3):
        a, b = i, (i + 1) % 3
        va, vb, ua, ub = F.col(f"v{a}"), F.col(f"v{b}"), F.col(f"u{a}"), F.col(f"u{b}")
        meets = (F.least(va, vb) <= at) & (F.greatest(va, vb) >= at)
        cross = ua + (at - va) / F.nullif(vb - va, F.lit(0.0)) * (ub - ua)
        ends += [F.when(meets, F.coalesce(cross, ua)), F.when(meets, F.coalesce(cross, ub))]
    # One texel more on both sides: rounding must not lose one on the border; the weights decide.
    left, right = (F.floor(F.least(*ends) - 0.5)).cast("long"), F.ceil(F.greatest(*ends) - 0.5).cast("long")
    t = t.withColumn("tx", F.explode(F.sequence(left, right)))
    w = t.withColumn("_w", g.barycentric_2d(*corners, g.point(F.col("tx") + 0.5, F.col("ty") + 0.5, F.lit(0.0))))
    inside = F.least("_w.u", "_w.v", "_w.w") >= -1e-12
    return w.filter(inside).select("tid", "tx", "ty", F.col("_w.u").alias("w0"), F.col("_w.v").alias("w1"), F.col("_w.w").alias("w2"), *keep)


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tid, tx, ty, sid, image, x, y, z, ax..cz, u0..v2) with the distance of the place x, y, z to the triangle, and where
    in its image the nearest point of it is; of rows of one texel that come together only the nearest is kept."""
    def dot(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p * q).sum(axis=0)

    def cross(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.stack([p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]])

    def along(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distance to a side."""
        size = dot(b - a, b - a)
        d = p - a - np.where(size > 0, np.clip(dot(p - a, b - a) / size, 0.0, 1.0), 0.0) * (b - a)
        return np.sqrt(dot(d, d))

    for batch in batches:
        own = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "image"}
        p, a, b, c = (np.stack([own[f"{k}{e}"] for e in "xyz"]) for k in ("", "a", "b", "c"))
        with np.errstate(divide="ignore", invalid="ignore"):
            n = cross(b - a, c - a)
            size = dot(n, n)
            inside = (size > 0) & np.logical_and.reduce([dot(cross(w - v, p - v), n) >= 0 for v, w in ((a, b), (b, c), (c, a))])
            far = np.where(inside, np.abs(dot(p - a, n)) / np.sqrt(size), np.minimum(np.minimum(along(p, a, b), along(p, b, c)), along(p, c, a)))
            u, v = dot(n, cross(c - b, p - b)) / size, dot(n, cross(a - c, p - c)) / size
            w = np.maximum(np.stack([u, v, 1 - u - v]), 0.0)
            w = np.where(size > 0, w / w.sum(axis=0), np.array([[1.0], [0.0], [0.0]]))  # without area: its first corner
        far = np.round(far, 9)
        order = np.lexsort((own["sid"], far, own["ty"], own["tx"], own["tid"]))
        texel = np.stack([own[k][order] for k in ("tid", "tx", "ty")])
        first = order[np.concatenate([[True], (texel[:, 1:] != texel[:, :-1]).any(axis=0)])[: len(order)]]
        out = [pa.array(own[k][first]) for k in ("tid", "tx", "ty", "sid")] + [batch.column("image").take(pa.array(first)), pa.array(far[first])]
        out += [pa.array(sum(w[i] * own[f"{x}{i}"] for i in range(3))[first]) for x in "uv"]
        yield pa.RecordBatch.from_arrays(out, names=["tid", "tx", "ty", "sid", "image", "far", "su", "sv"])


def nearest_source(texels: DataFrame, targets: DataFrame, sources: DataFrame, pairs: DataFrame) -> DataFrame:
    """(tid, tx, ty, sid, image, su, sv): for each texel of rasterise() the triangle of `sources` (sid, image, ax..cz, u0..v2)
    that is nearest to its place on its own triangle of `targets` (tid, ax..cz), and where in that one's image it is. Only
    `pairs` (tid, sid) are compared, which correspondence of the two meshes gives; of equally near ones the first by sid
    is taken. Texels without a pair go. Pairs take their triangles along to the texels' own, so what is shuffled is a row for
    each texel and each pair, not for each texel's pair: those are compared where they are joined."""
    corner = [g.point(*[F.col(f"{k}{p}") for p in "xyz"]) for k in "abc"]
    t = texels.join(targets.select("tid", *[c.alias(f"_{k}") for c, k in zip(corner, "abc", strict=True)]), "tid")
    place = [sum((F.col(f"w{i}") * F.col(f"_{k}.{p}") for i, k in enumerate("abc")), F.lit(0.0)).alias(p) for p in "xyz"]
    s = sources.select("sid", "image", *[F.col(f"{k}{p}").cast("double").alias(f"{k}{p}") for k in "abc" for p in "xyz"], *[F.col(f"{x}{i}").cast("double").alias(f"{x}{i}") for i in range(3) for x in "uv"])
    met = t.select("tid", "tx", "ty", *place).join(pairs.select("tid", "sid").distinct().join(s, "sid"), "tid")
    kind = {f.name: f.dataType.simpleString() for f in met.schema}
    found = met.mapInArrow(_nearest, ", ".join(f"{n} {kind.get(n, 'double')}" for n in ("tid", "tx", "ty", "sid", "image", "far", "su", "sv")))
    best = found.groupBy("tid", "tx", "ty").agg(F.min(F.struct("far", "sid", "image", "su", "sv")).alias("b"))
    return best.select("tid", "tx", "ty", "b.sid", "b.image", "b.su", "b.sv")


def sample(places: DataFrame, images: DataFrame, *, smooth: bool = False) -> DataFrame:
    """`places` (tx, ty, image, su, sv, ...) with value: the texel of `images` (image, x, y, value) that holds each place, or,
    smooth, the mean of the four nearest by their closeness, over those that are there. Places are in texels; those with
    no texel have a null value."""
    rest = [c for c in places.columns if c not in ("su", "sv")]
    if not smooth:
        at = places.withColumns({"_x": F.floor("su").cast("long"), "_y": F.floor("sv").cast("long")})
        texel = images.select("image", F.col("x").alias("_x"), F.col("y").alias("_y"), "value")
        return at.join(texel, ["image", "_x", "_y"], "left").select(*rest, "value")
    x, y = F.floor(F.col("su") - 0.5), F.floor(F.col("sv") - 0.5)
    fx, fy = F.col("su") - 0.5 - x, F.col("sv") - 0.5 - y
    taps = F.explode(F.array(*[F.struct((x + dx).cast("long").alias("_x"), (y + dy).cast("long").alias("_y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("_w")) for dx in (0, 1) for dy in (0, 1)])).alias("t")
    texel = images.select("image", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("value").cast("double").alias("value"))
    met = places.select(*rest, taps).select(*rest, "t.*").join(texel, ["image", "_x", "_y"], "left")
    there = F.sum(F.when(F.col("value").isNotNull(), F.col("_w")))
    return met.groupBy(*rest).agg((F.sum(F.col("_w") * F.col("value")) / F.nullif(there, F.lit(0.0))).alias("value"))


def bake(targets: DataFrame, sources: DataFrame, pairs: DataFrame, images: DataFrame, *, smooth: bool = False) -> DataFrame:
    """(tx, ty, tid, value): a texture for `targets` (tid, ax..cz, u0..v2 in its own texels) from the images of `sources`.
    A texel whose centre lies in several triangles belongs to the first by tid; those in none aren't made, and are what
    dilation fills."""
    texels = rasterise(targets)
    own = texels.groupBy("tx", "ty").agg(F.min(F.struct("tid", "w0", "w1", "w2")).alias("o")).select("tx", "ty", "o.*")
    return sample(nearest_source(own, targets, sources, pairs).drop("sid"), images, smooth=smooth).select("tx", "ty", "tid", "value")
