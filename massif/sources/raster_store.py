"""Raster stores: pyramids of tiles, kept as rows of subtiles, with an index of tiles and their hashes, a manifest and an
attribution table. A store is made as an attempt and published whole."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.errors import CorruptData, InvalidInput, NotFound
from massif.operators import raster
from massif.sources import store

SCHEMA = "raster-store/1"


@dataclass(frozen=True)
class Options:
    """How a store is cut: pixels along a tile, along a subtile, pixel type, zoom of the finest tiles."""

    tile: int = 256
    subtile: int = 64
    pixel: str = "int64"
    zoom: int = 0


def create(spark: SparkSession, final: str, options: Options) -> str:
    """An attempt at a store, with its manifest."""
    if options.tile % options.subtile:
        raise InvalidInput("a tile is a whole number of subtiles")
    attempt = store.create_attempt(final)
    _write_text(spark, f"{attempt}/manifest", json.dumps({"schema": SCHEMA, **asdict(options)}, sort_keys=True))
    return attempt


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(path)


def manifest(spark: SparkSession, path: str) -> Options:
    """The options of a store; another schema is an error, read before any tile."""
    head = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if head.pop("schema", None) != SCHEMA:
        raise CorruptData(f"{path} is no {SCHEMA}")
    return Options(**head)


def to_subtiles(pixels: DataFrame, options: Options, zoom: int) -> DataFrame:
    """(zoom, tx, ty, sx, sy, w, data, hash): pixels of a level as row-major arrays of one subtile each; cells that no pixel
    fills are null."""
    n, t = options.subtile, options.tile
    place = (F.col("py") % n) * n + F.col("px") % n
    at = [F.floor(F.col("px") / t).cast("long").alias("tx"), F.floor(F.col("py") / t).cast("long").alias("ty"), F.floor(F.col("px") % t / n).cast("long").alias("sx"), F.floor(F.col("py") % t / n).cast("long").alias("sy")]
    cells = pixels.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(place.cast("int").alias("k"), F.col("v")))).alias("m"))
    # Each value is followed by as many nulls as are missing up to the next one: a pass over the list, whatever its length.
    after = F.concat(F.slice(F.transform("m", lambda e: e["k"]), 2, n * n), F.array(F.lit(n * n)))
    none = F.lit(None).cast(pixels.schema["v"].dataType)
    runs = F.zip_with("m", after, lambda e, k: F.concat(F.array(e["v"]), F.array_repeat(none, k - e["k"] - 1)))
    data = F.concat(F.array_repeat(none, F.col("m")[0]["k"]), F.flatten(runs))
    data = F.when(F.size(data) == n * n, data).otherwise(F.raise_error(F.lit("a subtile has two values for a pixel")))
    return cells.select(F.lit(zoom).cast("long").alias("zoom"), "tx", "ty", "sx", "sy", data.alias("data")).withColumn("hash", F.xxhash64("data"))


def write_level(pixels: DataFrame, attempt: str, options: Options, zoom: int) -> None:
    """Write a level of the pyramid: a folder a zoom, rows in the order of their tiles, so that readers skip files and row
    groups by statistics. The level's tiles and hashes are its checkpoint in the index: a level with one is whole."""
    at = f"{attempt}/tiles/zoom={zoom}"
    to_subtiles(pixels, options, zoom).drop("zoom").repartitionByRange("ty", "tx").sortWithinPartitions("ty", "tx", "sy", "sx").write.mode("error").parquet(at)
    rows = pixels.sparkSession.read.parquet(at).groupBy("tx", "ty").agg(F.bit_xor(F.xxhash64("sx", "sy", "hash")).alias("hash"), F.count(F.lit(1)).alias("subtiles"))
    rows.repartitionByRange("ty", "tx").sortWithinPartitions("ty", "tx").write.mode("error").parquet(f"{attempt}/index/zoom={zoom}")


def inputs(pixels: DataFrame, options: Options, reducer=raster.reduce_max) -> dict:
    """The record of what a store is made from: pixels, options and the reducer's name."""
    return store.input_record(pixels.select("px", "py", "v"), schema=SCHEMA, **asdict(options), reducer=f"{reducer.__module__}.{reducer.__qualname__}")


def build(pixels: DataFrame, final: str, options: Options, *, reducer=raster.reduce_max) -> None:
    """A published store of pixels and of all coarser levels, each reduced from the stored one below it.

    An attempt left behind is gone on with if its record tells that it was made from the same pixels in the same way; its
    whole levels aren't made again. Others, those without a record among them, are passed over, and go once the store is
    published."""
    spark = pixels.sparkSession
    record = inputs(pixels, options, reducer)
    attempt = next((a for a in reversed(store.attempts(spark, final)) if store.matches_record(spark, a, record)), None)
    if attempt is None:
        attempt = create(spark, final, options)
        store.write_record(spark, attempt, record)
    for zoom in range(options.zoom, -1, -1):
        if not store.exists(spark, f"{attempt}/index/zoom={zoom}/_SUCCESS"):
            for part in ("tiles", "index"):
                store.delete(spark, f"{attempt}/{part}/zoom={zoom}")
            level = pixels if zoom == options.zoom else raster.halve(read_level(spark, attempt, options, zoom + 1), 1, v=reducer)
            write_level(level, attempt, options, zoom)
    store.publish(spark, attempt, final)


def _pixels(rows: DataFrame, options: Options) -> DataFrame:
    n, t = options.subtile, options.tile
    cells = rows.select("tx", "ty", "sx", "sy", F.posexplode("data").alias("k", "v")).filter("v IS NOT NULL")
    return cells.select((F.col("tx") * t + F.col("sx") * n + F.col("k") % n).alias("px"), (F.col("ty") * t + F.col("sy") * n + F.floor(F.col("k") / n)).alias("py"), "v")


def read_level(spark: SparkSession, path: str, options: Options, zoom: int) -> DataFrame:
    return _pixels(spark.read.parquet(f"{path}/tiles/zoom={zoom}"), options)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(zoom, tx, ty, hash, subtiles) of all stored tiles."""
    return spark.read.parquet(f"{path}/index")


def read_tile(spark: SparkSession, path: str, zoom: int, x: int, y: int, expected: int | None = None) -> DataFrame:
    """Pixels of one tile. Its content is hashed again; another hash than the index has, or than `expected`, is an error."""
    here = (F.col("tx") == x) & (F.col("ty") == y)
    rows = spark.read.parquet(f"{path}/tiles/zoom={zoom}").filter(here)
    found = rows.agg(F.bit_xor(F.xxhash64("sx", "sy", F.xxhash64("data")))).first()[0]
    known = index(spark, path).filter(here & (F.col("zoom") == zoom)).select("hash").first()
    if known is None:
        raise NotFound(f"tile {zoom}/{x}/{y}")
    if found != known[0] or expected not in (None, found):
        raise CorruptData(f"tile {zoom}/{x}/{y} does not have its hash")
    return _pixels(rows, manifest(spark, path))


def read_region(spark: SparkSession, path: str, zoom: int, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of a half-open region: only the subtiles it meets are read, by filters on tiles that reach the scan."""
    o = manifest(spark, path)

    def span(c: str, s: str, a: int, b: int) -> Column:
        at = F.col(c) * (o.tile // o.subtile) + F.col(s)
        return F.col(c).between(a // o.tile, (b - 1) // o.tile) & at.between(a // o.subtile, (b - 1) // o.subtile)

    rows = spark.read.parquet(f"{path}/tiles/zoom={zoom}").filter(span("tx", "sx", x0, x1) & span("ty", "sy", y0, y1))
    return raster.window(_pixels(rows, o), x0, y0, x1, y1)


def copy_attribution(spark: SparkSession, source_index: str, target: str) -> None:
    """The attribution table nearest to a source index, written beside another one."""
    rows = store.read_attribution(spark, source_index).orderBy("idx").drop("idx").toJSON().collect()  # 65535 at most
    _write_bytes(spark, f"{target}/source_attribution_table.json", f"[{','.join(rows)}]".encode())


def _write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = store._fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(data))
    out.close()


def mark_complete(tiles: DataFrame) -> DataFrame:
    """(zoom, x, y, status) of downloaded tiles (zoom, x, y, pending children): a tile is complete when all its stored
    children are, pending otherwise; tiles without children are complete. Settled from the deepest level up, as sums of
    what is pending below each tile."""
    below = tiles.filter(F.col("pending")).select("zoom", "x", "y", F.explode(F.sequence(F.lit(0), F.col("zoom").cast("int"))).alias("k"))
    up = below.select((F.col("zoom") - F.col("k")).alias("zoom"), *[F.call_function("shiftright", c, F.col("k")).alias(c) for c in "xy"]).distinct()
    return tiles.join(up.withColumn("_open", F.lit(True)), ["zoom", "x", "y"], "left").select("zoom", "x", "y", F.when(F.col("_open"), "children pending").otherwise("complete").alias("status"))
