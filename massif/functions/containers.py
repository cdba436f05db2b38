"""Containers as tables and arrays: offset tables, segmented arrays, pair maps, visited sets and bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 32  # bits of a bitmap word, so that words stay positive longs


def offsets(sizes: DataFrame, *, segment: str = "segment", size: str = "n") -> DataFrame:
    """`sizes` with `first`, the flat index at which a segment begins; sums are made per block of segments and set one after
    another. Segments are numbered from zero."""
    blk = F.floor(F.col(segment) / 4096)
    d = sizes.withColumn("_blk", blk)
    within = F.sum(size).over(Window.partitionBy("_blk").orderBy(segment)) - F.col(size)
    base = d.groupBy("_blk").agg(F.sum(size).alias("_n")).select("_blk", (F.sum("_n").over(Window.orderBy("_blk")) - F.col("_n")).alias("_base"))  # one row a block
    return d.withColumn("_in", within).join(base, "_blk").withColumn("first", F.col("_base") + F.col("_in")).drop("_blk", "_in", "_base")


def locate(flat: DataFrame, table: DataFrame, *, index: str = "i", segment: str = "segment", size: str = "n", cell: int = 1024) -> DataFrame:
    """`flat` (index, ...) with the segment it lies in and its place there (local). Segments are dealt into the cells of
    flat indexes they cover, so the range join is an equi-join."""
    t = table.filter(F.col(size) > 0).select(F.col(segment).alias("_s"), F.col("first").alias("_f"), (F.col("first") + F.col(size)).alias("_e"))
    t = t.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_f") / cell), F.floor((F.col("_e") - 1) / cell))))
    j = flat.withColumn("_c", F.floor(F.col(index) / cell)).join(t, "_c").filter((F.col(index) >= F.col("_f")) & (F.col(index) < F.col("_e")))
    return j.select(*flat.columns, F.col("_s").alias("segment"), (F.col(index) - F.col("_f")).alias("local"))


def push_last(segments: Column, value: Column) -> Column:
    """An array of arrays with a value more in the last one; the first value makes the first segment."""
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.slice(F.array(value), 1, 0))
    return F.concat(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), F.array(F.array_append(last, value)))


def drop_empty(segments: Column) -> Column:
    return F.filter(segments, lambda s: F.size(s) > 0)


def pair_lookup(pairs: DataFrame, map_: DataFrame, *, default: Column) -> DataFrame:
    """`pairs` (i, j, ...) with the value of a map (i, j, value), or a default."""
    return pairs.join(map_.select("i", "j", "value"), ["i", "j"], "left").withColumn("value", F.coalesce("value", default))


def unvisited(rows: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(visited.select(*keys), keys, "left_anti")


def bitmap(rows: DataFrame, index: str, *by: str) -> DataFrame:
    """(by, word, bits) of the set bits at an index, WORD bits a word."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(index) % WORD).cast("int"))
    return rows.groupBy(*by, F.floor(F.col(index) / WORD).cast("long").alias("word")).agg(F.bit_or(bit).alias("bits"))


def bit_is_set(bits: Column, place: Column) -> Column:
    return F.call_function("shiftright", bits, (place % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1


def dedup_sorted(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def index_of(values: Column, value: Column) -> Column:
    """Place of the first equal value, from zero; null if there is none."""
    at = F.array_position(values, value)
    return F.when(at > 0, at - 1)


def find_single(values: Column, test) -> Column:
    """The one value that passes a test; null if none or several do."""
    found = F.filter(values, test)
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)))
