"""Token counts with a digest cache.

A cache is a Parquet table (content_digest binary, tokenizer_digest string, n_tokens long). Contents are joined to it by
digest; only distinct contents it lacks are encoded, and their counts are appended."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm.tokens import arrow_chunks, encoder, small_batches
from massif.plans.shared import shuffle_width, stash

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: counts of another version are never reused."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of normalised content. Null stands for the empty text; nothing else is folded, as any other change could
    change the count."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    if not _path_exists(spark, path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _first_of_digest(batches):
    """Rows whose digest this task has not met: copies within a task never reach the shuffle."""
    met: set[bytes] = set()
    for batch in batches:
        digests = batch.column(0).to_pylist()
        keep = []
        for i, d in enumerate(digests):
            if d not in met:
                met.add(d)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int32()))


def encode_misses(texts: DataFrame, cache: DataFrame, tokenizer_path: str, version: str) -> DataFrame:
    """(content_digest, tokenizer_digest, n_tokens) of each distinct content of `texts` (content_digest, text) that
    `cache` lacks. Copies meet in one partition by digest, after each map task has dropped its own."""
    spark = texts.sparkSession
    small_batches(spark)

    def count(batches):
        met: set[bytes] = set()
        enc = encoder(tokenizer_path)
        for part in arrow_chunks(batches):
            new = []
            digests = part.column(0).to_pylist()
            for i, d in enumerate(digests):
                if d not in met:
                    met.add(d)
                    new.append(i)
            counts = [len(b) // 4 for b in enc.encode(part.column(1).take(pa.array(new, pa.int32())).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digests[i] for i in new], pa.binary()), pa.array([version] * len(new), pa.string()), pa.array(counts, pa.int64())],
                ["content_digest", "tokenizer_digest", "n_tokens"],
            )

    dealt = texts.mapInArrow(_first_of_digest, "content_digest binary, text string")
    dealt = dealt.repartition(shuffle_width(spark), "content_digest")
    known = cache.filter(F.col("tokenizer_digest") == version).select("content_digest")
    return dealt.join(known, "content_digest", "left_anti").mapInArrow(count, CACHE_SCHEMA)


def warm(docs: DataFrame, tokenizer_path: str, cache_path: str, *, text_col: str = "text") -> DataFrame:
    """Append the counts of the texts of `docs` that the cache at `cache_path` lacks, and return them (content_digest,
    tokenizer_digest, n_tokens). Each call appends to a folder of its own, so a retried or concurrent one never touches
    another's files; counts that two calls append both are the same."""
    spark, append = docs.sparkSession, f"{cache_path}/append={uuid.uuid4().hex}"
    contents = docs.select(content_digest(F.col(f"`{text_col}`")).alias("content_digest"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    encode_misses(contents, read_cache(spark, cache_path), tokenizer_path, tokenizer_version(tokenizer_path)).write.parquet(append)
    return spark.read.schema(CACHE_SCHEMA).parquet(append)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, text_col: str = "text") -> DataFrame:
    """`docs` with n_bytes and n_tokens of each whole text and cached (whether the cache at `cache_path` had the count
    before), appending what the cache lacked.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are all kept and share one count; an empty table gives
    an empty result. A column of `docs` named like an output gives way to it; all others are kept, whatever their names."""
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    known = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens", F.lit(True).alias("cached"))
    new = warm(docs, tokenizer_path, cache_path, text_col=text_col).select("content_digest", "n_tokens", F.lit(False).alias("cached"))
    counts = known.union(new).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"), F.max("cached").alias("cached"))
    # Stored, so that the join reads an exchange of it on either side and can split the rows of one digest over tasks.
    counts = stash(counts, "token-counts").toDF("d", "n", "c")
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "cached")]
    names = {c: f"_{i}" for i, c in enumerate(keep)}
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.octet_length(text).cast("long").alias("n_bytes"), content_digest(F.col(f"`{text_col}`")).alias("of"))
    joined = keyed.join(counts, F.col("of") == F.col("d"))
    return joined.select(*[F.col(n).alias(c) for c, n in names.items()], "n_bytes", F.col("n").alias("n_tokens"), F.col("c").alias("cached"))
