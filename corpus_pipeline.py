"""A training-corpus pipeline over `documents`: language, quality, near-duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what its operator leaves of docs, in the columns of documents; the last
returns packed pieces. Columns that docs has beyond those, whatever their names, are kept by all stages but the last; very
long texts are read whole by every stage, in the memory of one task; a row is judged by itself, so repeated rows and repeated or null ids are rows like any other, except that near-duplicates
leave one; empty tables give empty tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm import decontaminate, jaccard, language_id, line_quality, packing, simhash
from massif.plans.shared import stash

TOKENIZER = "byte_bpe_50k.json"
# The least rank-order score of a text in a language that was learnt was 0.384 of 256410 documents; prose in Finnish,
# Turkish, Polish, Italian or Dutch had 0.37 or less. Where held-out documents score lower, the bound follows them down.
MIN_SCORE, MARGIN = 0.375, 0.85


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no known language: without letters, or unlike every profile. Profiles are learnt from the
    documents that are not held out; those held out set the bound where their scores are low. Null and empty texts go; of
    languages at equal distance the first by name is taken; without labelled documents nothing can be told, and all go."""
    profiles = language_id.learn(docs.filter(~language_id.held_out()))
    low = language_id.low_score(docs.filter(language_id.held_out()), profiles)
    bound = MIN_SCORE if low is None else min(MIN_SCORE, MARGIN * low)
    named = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # outputs never clash with columns of docs
    found = language_id.identify(docs.withColumnsRenamed(named), profiles, text_col=named["text"])
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= bound))
    return kept.select(*[F.col(n).alias(c) for c, n in named.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are common to a host and drops documents that fail a rule or are depleted: under 50 words, over
    half of them repeated, or under 30 % of them left. Null texts go; documents without a source share one host."""
    return line_quality.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component, that of the smallest doc_id; five-word shingles, Jaccard
    similarity 0.8 or more, checked on whole sets. SimHash, met in the middle, proposes the pairs within two bits; for
    those further off there are MinHash bands. Null texts and texts without words are alike; a null id comes after all
    others; rows equal in id and text leave one; very long texts are compared whole."""
    return simhash.deduplicate(docs, near=jaccard.near_duplicates, similarity=0.8, words=5, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window. Null texts hold none; an empty benchmark drops nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents left into sequences of at most 1024 tokens. A null text is its end token alone; pieces of equal
    length are placed by id, piece and ids."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
# Language profiles, fingerprints and token ids are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over `documents`; each but the last is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
