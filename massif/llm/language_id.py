"""Language identification by rank-order profiles: a document's most frequent character n-grams, by rank, against each
language's, by out-of-place distance."""

from __future__ import annotations

import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.llm.tokens import arrow_chunks, small_batches

TOP = 400  # n-grams in a profile
FIT_DOCS = 2000  # documents of one language that its profile is learnt from, about
MAX_LANGUAGES = 2000  # profiles are broadcast: at most this many times TOP n-grams


def _word_characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it stands in words (letters and marks), whether it is a letter. Kept between tasks."""
    store = sys.modules.setdefault("_massif_worker_store", types.ModuleType("_massif_worker_store")).__dict__
    if "letters" not in store:
        kinds = np.array([ord(unicodedata.category(chr(i))[0]) for i in range(sys.maxunicode + 1)], np.uint8)
        store["letters"] = ((kinds == ord("L")) | (kinds == ord("M")), kinds == ord("L"))
    return store["letters"]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one to three characters of a text's lower-cased words, with a space at a word's ends, as codes of
    21 bits a character, and their counts. Nothing for a text without letters."""
    word, letter = _word_characters()
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    if not letter[c].any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.concatenate([[32], np.where(word[c], c, 32), [32]]).astype(np.int64)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(c), 1 << 20):  # long texts in stretches, of which each but the first repeats two characters
        part = c[max(0, at - 2) : at + (1 << 20)]
        two, three = part[:-1] << 21 | part[1:], part[:-2] << 42 | part[1:-1] << 21 | part[2:]
        one = part[2 if at else 0 :]
        found = np.sort(np.concatenate([one[one != 32], two[1 if at else 0 :], three[part[1:-1] != 32]]))
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        codes, counts = merge(codes, counts, found[first], np.diff(np.append(first, len(found))))
    return codes, counts


def merge(codes, counts, more_codes, more_counts):
    if not len(codes):
        return more_codes, more_counts
    every, back = np.unique(np.concatenate([codes, more_codes]), return_inverse=True)
    return every, np.bincount(back, weights=np.concatenate([counts, more_counts])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order of frequency, ties by code."""
    if len(codes) > top:
        often = counts >= np.partition(counts, -top)[-top]
        codes, counts = codes[often], counts[often]
    return codes[np.lexsort((codes, -counts))][:top]


class Profiles:
    """Ranks of every profile's n-grams, for all languages at once."""

    def __init__(self, ranked_codes: dict[str, list[int]], top: int):
        self.languages, self.top = sorted(ranked_codes), top
        self.codes = np.unique(np.array([c for v in ranked_codes.values() for c in v], np.int64))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)
        for i, lang in enumerate(self.languages):
            self.ranks[i, np.searchsorted(self.codes, np.array(ranked_codes[lang], np.int64))] = np.arange(len(ranked_codes[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language at the least out-of-place distance (the first by name of equals) and one minus that distance over
        the largest possible; `und` and 0 without letters or profiles."""
        codes = ranked(*ngrams(text), self.top)
        if not len(codes) or not self.languages:
            return "und", 0.0
        at = np.searchsorted(self.codes, codes)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == codes, at, len(self.codes))
        theirs = self.ranks[:, at]
        off = np.where(theirs < 0, self.top, np.abs(theirs - np.arange(len(codes)))).sum(axis=1)
        best = int(np.argmin(off))
        return self.languages[best], float(1 - off[best] / (self.top * len(codes)))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text is divisible by 5. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = TOP, fit_docs: int = FIT_DOCS) -> Profiles:
    """Profiles of the languages of `docs`, from about `fit_docs` documents of each, chosen by a hash of their ids.

    More than MAX_LANGUAGES are an error. Rows with null text or language teach nothing, nor do rows labelled `und`, which is the answer for texts without letters
    and therefore no language. Equal ids are chosen together; an empty table gives no profiles."""
    small_batches(docs.sparkSession)
    train = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(lang_col) != "und"))
    sizes = {r[0]: r[1] for r in train.groupBy(lang_col).count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Profiles({}, top)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, fit_docs / n))])
    chosen = train.filter(F.pmod(F.xxhash64(id_col, F.lit(8)), F.lit(1 << 20)) < share[F.col(lang_col)] * (1 << 20))

    def count(batches):
        total: dict[str, tuple] = {}
        for part in arrow_chunks(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                total[lang] = merge(*total.get(lang, (np.zeros(0, np.int64),) * 2), *ngrams(text))
        for lang, (codes, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

    counted = chosen.select(lang_col, text_col).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counted.withColumn("rank", first).filter(F.col("rank") <= top).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r["lang"], []).append(r["code"])
    return Profiles(found, top)


def identify(docs: DataFrame, profiles: Profiles, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """`keep` (default: all) columns of docs with lang_pred and score, from each whole text and nothing else.

    Null texts and texts without a letter are `und` with score 0. Repeated rows are judged each; an empty table gives an
    empty result. Columns of `docs` named like an output are left out."""
    columns = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    small_batches(docs.sparkSession)

    def run(batches):
        for part in arrow_chunks(batches):
            found = [profiles.predict(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*columns, "lang_pred", "score"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)
    return docs.select(F.col(text_col).alias("_text"), *[F.col(f"`{c}`") for c in columns]).mapInArrow(run, f"{kinds}lang_pred string, score double")


def low_score(docs: DataFrame, profiles: Profiles, *, quantile: float = 0.01, text_col: str = "text", lang_col: str = "lang") -> float | None:
    """The score below which lies this share of the documents labelled with a learnt language, from all of them. None
    without such documents."""
    known = docs.filter(F.col(lang_col).isin(profiles.languages) & F.col(text_col).isNotNull())
    return identify(known.select(F.col(text_col).alias("text")), profiles, keep=[]).filter("lang_pred != 'und'").agg(F.percentile("score", F.lit(quantile))).first()[0]
