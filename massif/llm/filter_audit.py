"""Which of several document filters removes what, in every order in which they could be applied.

Each document becomes a mask of the filters it fails, and masks are counted by part. What a set of filters keeps follows
from these counts, so no order is run over the documents. Duplicates are found by partition refinement: documents are split
by their number of code points, then by the hash of one block of their text after another, and those alone in their class
drop out; full texts are compared only for what is left at the end."""

from __future__ import annotations

import re
from itertools import count, permutations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.llm.simhash import few
from massif.llm.tokens import arrow_chunks, release, small_batches
from massif.plans.shared import stash

FILTERS = "ABCDE"
FIRST_BLOCK, GROWTH = 256, 8  # bytes in the first block; each further block is so many times as long
FEW_MARKS = 1 << 18  # rows of an id and a digest that are broadcast; more are joined by a merge
_CAPITALS, _SIGNS = re.compile(rb"[A-Z]+"), re.compile(rb"[#$%&*|]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_STRETCH = 1 << 22


def word_counts(text: bytes) -> tuple[int, int]:
    """Words of a text and distinct ones; long texts are cut into words a stretch at a time."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        end = _SPACE.search(text, at + _STRETCH)
        end = end.start() if end else len(text)
        words = text[at:end].split()
        n, at = n + len(words), end
        distinct.update(words)
    return n, len(distinct)


def failures(text: bytes, length: int) -> int:
    """Bits of the filters that a text fails by itself: under 50 words, under 65 % distinct words, over 5 % capitals, any
    of the signs."""
    n, distinct = word_counts(text)
    capitals = len(text) - len(_CAPITALS.sub(b"", text))
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * capitals > 5 * length) << 2 | (_SIGNS.search(text) is not None) << 3


def block_hashes(text: bytes) -> list[int]:
    """Signed 64-bit hashes of successive blocks, each longer than the one before, so that there are few."""
    out, at, size = [], 0, FIRST_BLOCK
    while at < len(text):
        out.append(xxhash.xxh3_64_intdigest(memoryview(text)[at : at + size]))
        at, size = at + size, size * GROWTH
    return [h - (1 << 64) if h >> 63 else h for h in out]


def profiles(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_id, part, mask, length, digest, blocks) of each document; a null text is empty, a null part the empty string."""

    def run(batches):
        for rows in arrow_chunks(batches):
            texts = rows.column(2)
            lengths = pc.utf8_length(texts).to_pylist()
            texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
            masks, digests, blocks = [], [], []
            for i, length in enumerate(lengths):
                text = texts[i].as_py()
                masks.append(failures(text, length))
                digests.append(xxhash.xxh3_128_digest(text))
                blocks.append(block_hashes(text))
            columns = [rows.column(0), rows.column(1), pa.array(masks, pa.int32()), pa.array(lengths, pa.int64()), pa.array(digests, pa.binary()), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "part", "mask", "length", "digest", "blocks"])
        release()

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    return read.mapInArrow(run, f"_id {kind}, part string, mask int, length long, digest binary, blocks array<long>")


def without_singletons(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs more than once."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    return rows.join(few(stash(often, "classes"), FEW_MARKS), key, "left_semi")


def refined(profiled: DataFrame) -> DataFrame:
    """(_id, digest, length, class) of the documents that share their class with others once all blocks are looked at.

    Every round splits the classes left by one more block and is stored; there are as many as blocks in the longest text
    that still shares its class. Documents without an id take no part."""
    live = profiled.filter("_id IS NOT NULL").select("_id", "digest", "length", "blocks", F.col("length").alias("class"))
    done: DataFrame | None = None
    for k in count():
        live = stash(without_singletons(live, "class"), "refined")
        ended = live.filter(F.size("blocks") <= k).select("_id", "digest", "length", "class")
        done = ended if done is None else done.union(ended)
        live = live.filter(F.size("blocks") > k)
        if live.isEmpty():
            return done
        live = live.withColumn("class", F.xxhash64("class", F.col("blocks")[k]))


def later_copies(docs: DataFrame, profiled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, digest), distinct, of the documents whose text a smaller id has too.

    Texts are read again for the suspects only and compared whole: one aggregation tells each class's texts, combined
    before its shuffle, and the smallest id of each. A class that hashes alone keep together has several texts; its
    documents are then told apart by text."""
    suspects = stash(refined(profiled).distinct(), "suspects")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text")).withColumn("length", F.char_length("_text").cast("long"))
    read = read.join(few(suspects, FEW_MARKS), ["_id", "length"])
    same = stash(read.groupBy("class", "_text").agg(F.min("_id").alias("_first")), "same-texts")
    classes = stash(same.groupBy("class").agg(F.count(F.lit(1)).alias("_texts"), F.min("_first").alias("_first")), "class-texts")
    found = suspects.join(few(classes, FEW_MARKS), "class").filter("_texts = 1 AND _id > _first").select("_id", "digest")
    mixed = stash(classes.filter("_texts > 1").select("class"), "mixed-classes")
    if mixed.isEmpty():
        return found.distinct()
    apart = read.join(mixed, "class").join(same, ["class", "_text"]).filter(F.col("_id") > F.col("_first")).select("_id", "digest")
    return found.union(apart).distinct()


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(_id, part, mask) of each document: bit i is set if it fails the i-th of FILTERS.

    The last filter is that of copies: a document fails it if a smaller id has the same text. A null id has none smaller and
    is none that others are compared with. Two rows of one id whose different texts agree in length and in a 128-bit
    digest would be marked together."""
    profiled = stash(profiles(docs, id_col=id_col, text_col=text_col, part_col=part_col), "profiles")
    copies = stash(later_copies(docs, profiled, id_col=id_col, text_col=text_col), "later-copies").withColumn("_copy", F.lit(1 << 4))
    joined = profiled.join(few(copies, FEW_MARKS), ["_id", "digest"], "left")
    return joined.select("_id", "part", F.col("mask").bitwiseOR(F.coalesce("_copy", F.lit(0))).alias("mask"))


def counted(masked: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and how many of them a label calls good or toxic. Of
    several labels of one id any will do."""
    flags = labels.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    told = masked.join(stash(flags, "label-flags"), "_id", "left")
    return told.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part,
    every order of the filters and every step of it, from (part, mask, n, good, toxic).

    Kept by a set of filters are the masks that miss it; all figures of a step are differences of what two sets keep. A
    document that fails m filters is removed by each of them in 1/m of all orders, which gives shapley."""
    subsets = 1 << len(filters)
    orders = ["".join(p) for p in permutations(filters)]

    def keeps(column: str) -> Column:
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(column)).otherwise(0)) for s in range(subsets)])

    def turns(i: int) -> Column:
        share = F.element_at(F.lit([0, *(len(orders) // m for m in range(1, len(filters) + 1))]), F.bit_count("mask") + 1)
        return F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.col("n") * share).otherwise(0))

    by_part = counts.groupBy("part").agg(*[keeps(c).alias(f"_{c}") for c in ("n", "good", "toxic")], F.array(*[turns(i) for i in range(len(filters))]).alias("_turns"))
    steps = by_part.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(filters)), F.lit(0))

    steps = steps.withColumn("_before", bits(F.expr("left(filter_order, step - 1)"))).withColumn("_own", bits(F.expr("substring(filter_order, step, 1)")))
    before, own = F.col("_before"), F.col("_own")
    after, others = before.bitwiseOR(own), F.lit(subsets - 1) - own

    def kept(name: str, chosen: Column) -> Column:
        return F.get(F.col(name), chosen)

    removed = kept("_n", before) - kept("_n", after)
    return steps.select(
        "part", "filter_order", "step", kept("_n", after).cast("long").alias("kept"), removed.cast("long").alias("removed"),
        (kept("_n", F.lit(0)) - kept("_n", own) - removed).cast("long").alias("redundant"),
        (kept("_n", others) - kept("_n", F.lit(subsets - 1))).cast("long").alias("unique_fails"),
        *[(kept(f"_{c}", before) - kept(f"_{c}", after)).cast("long").alias(f"{c}_lost") for c in ("good", "toxic")],
        F.get("_turns", F.instr(F.lit(filters), F.expr("substring(filter_order, step, 1)")) - 1).cast("long").alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of five filters over `docs`, whole texts: under 50 words (A), under 65 % distinct words (B), over 5 %
    capitals (C), signs (D), copies of a smaller id (E).

    Null texts are empty, null parts the empty string; empty texts fail A alone, and E where a smaller id is empty too. A
    null id has no labels and no copies. Repeated rows of an id count each, and none of them is a copy of another.
    Repeated labels count once. Very long texts are cut into words a stretch at a time, and only distinct words are
    held. An empty table gives an empty result. Columns may have any names; only id, text and part are read."""
    masked = masks(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    return audit(stash(counted(masked, labels), "mask-counts"))
