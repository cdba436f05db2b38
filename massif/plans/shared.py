"""Shared storage: tables that cut lineage and survive the loss of an executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent, a local session uses a folder of its own; a cluster session is an error, since a
    machine-local folder would lose rows there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"{tempfile.gettempdir()}/massif-checkpoints"
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/massif/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and return it reread: later steps neither recompute it nor depend
    on executors that held it."""
    path = fresh_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark takes it: one without is of the file system that the session names by default."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def arrow_uri(path: str) -> str:
    """A path with a scheme as Arrow takes it."""
    return re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", path))


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system; nothing happens if it is absent."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Delete what this application has stashed; call it when no stashed table is needed any more."""
    drop_path(spark, f"{shared_dir(spark)}/massif/{spark.sparkContext.applicationId}")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
