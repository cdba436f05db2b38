"""Ingestion of arriving keys as a stream: files are read once, and the counts of all hierarchy levels kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

KEYS = T.StructType([T.StructField("level", T.LongType()), T.StructField("index", T.LongType()), T.StructField("ts", T.TimestampType())])


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(KEYS).parquet(folder)


def ancestor_counts(keys: DataFrame, *, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Arrivals by window, level and cell, for each cell and its ancestors; keys later than `late` are dropped."""
    k = keys.withWatermark("ts", late).withColumn("steps", F.explode(F.sequence(F.lit(0), F.col("level").cast("int"))))
    up = F.call_function("shiftright", F.col("index"), (3 * F.col("steps")).cast("int"))
    return k.groupBy(F.window("ts", every), (F.col("level") - F.col("steps")).alias("level"), up.alias("index")).agg(F.count(F.lit(1)).alias("n"))


def append_new(keys: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append arriving keys to a table, each file once; stops when what is there has been read."""
    return keys.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
