"""Quality rules: figures of each text, and lines that too many documents of a host share.

Only DataFrame functions are used. A lambda never refers to a computed array except as another lambda's variable (`let`),
so no array is computed anew for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.plans.shared import stash

_SPACE = "[\\x20\\x09-\\x0D]+"
MIN_DOCS = 20  # a line must be in more distinct documents of its host than this,
MAX_SHARE = 0.01  # and in more than this share of them, to be removed
MIN_LEFT = 0.3  # documents keep this share of their words at least
FEW_TEXTS = 1 << 18  # texts with removed lines that are broadcast, by count; more are merged


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of `size` words that occur twice or more, the first occurrence included."""

    def windows(w: Column, make: Callable[[Column, Column], Column]) -> Column:
        at = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: make(F.xxhash64(*[w[i + k] for k in range(size)]), i))

    def twice(hashes: Column) -> Column:
        return F.exists(F.zip_with(hashes, F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)

    def places(rows: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            return F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))

        return F.sort_array(F.array_distinct(F.flatten(F.zip_with(rows, F.slice(rows, 2, F.size(rows)), equal))))

    def covered(p: Column) -> Column:
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.lit(size), F.coalesce(b - a, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def count(w: Column) -> Column:
        rows = F.sort_array(windows(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        exact = let(rows, lambda r: let(places(r), covered))
        return F.when(let(F.sort_array(windows(w, lambda h, i: h)), twice), exact).otherwise(F.lit(0))

    return let(words, count)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def normalised(line: Column) -> Column:
    """Lower case, with white space runs as single spaces and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, _SPACE, " ")))


def text_figures(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    figures = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words"),
    ))
    symbols = F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long")
    doubled = let(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return [figures.alias("_f"), symbols.alias("n_symbols"), doubled.alias("n_dup_lines")]


def _host(docs: DataFrame, host_col: str) -> Column:
    return F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")) if host_col in docs.columns else F.lit("")


def document_lines(docs: DataFrame, *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(host, content, pos, line, n, copies): the normalised lines, hashed, and their words, of each distinct text of a
    host, and in how many rows it is."""
    def row(x: Column) -> Column:
        return F.struct(F.xxhash64(normalised(x)).alias("line"), F.size(words_of(x)).alias("n"))

    text = F.col(f"`{text_col}`")
    lines = F.transform(lines_with_words(F.coalesce(text, F.lit(""))), row)
    rows = docs.select(_host(docs, host_col).alias("host"), F.xxhash64(text).alias("content"), F.posexplode(lines).alias("pos", "_l"))
    return rows.groupBy("host", "content", "pos", "_l.line", "_l.n").agg(F.count(F.lit(1)).alias("copies"))


def common_lines(lines: DataFrame, *, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, count_copies: bool = False) -> DataFrame:
    """(host, line) of lines in more documents of their host than the limits allow. Equal texts are one document, so that
    copies make no line frequent; with `count_copies` each row is one. Counts are summed in two steps, so that a line or
    host of a third of all rows is no task's burden."""
    one = F.max("copies") if count_copies else F.max(F.lit(1))
    per_doc = lines.groupBy("host", "line", "content").agg(one.alias("_one"))
    counts = per_doc.groupBy("host", "line").agg(F.sum("_one").alias("docs")).filter(F.col("docs") > min_docs)
    sizes = stash(lines.groupBy("host", "content").agg(one.alias("_one")).groupBy("host").agg(F.sum("_one").alias("all")), "host-sizes")
    return counts.join(sizes, "host").filter(F.col("docs") > max_share * F.col("all")).select("host", "line")


def judge(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, count_copies: bool = False, few_texts: int = FEW_TEXTS) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words (words in
    lines common to their host), removed_lines (their hashes) and kept.

    A document is kept unless it has fewer than 50 words, more than half of them in repeated windows, or fewer than
    `min_left` of them left when common lines are removed. A null text has no words and fails; a null host is the empty
    host, as are all where there is no such column; very long texts are judged whole, each in the memory of one task;
    repeated rows are judged each; an empty table gives an empty result. A
    column of `docs` named like an output gives way to it; all others are kept, whatever their names.

    Up to `few_texts` texts with removed lines (they are counted) are broadcast, so that documents are not shuffled;
    beyond that they are merged."""
    outputs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "removed_lines", "kept")
    names = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in outputs}
    columns = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    lines = stash(document_lines(docs, text_col=text_col, host_col=host_col), "lines")
    common = stash(common_lines(lines, min_docs=min_docs, max_share=max_share, count_copies=count_copies), "common-lines")
    removed = lines.join(common, ["host", "line"]).groupBy("host", "content").agg(F.sum("n").alias("n_removed_words"), F.collect_set("line").alias("removed_lines"))
    removed = stash(removed.withColumnsRenamed({"host": "_h", "content": "_c"}), "removed-lines")
    removed = F.broadcast(removed) if removed.count() <= few_texts else removed.hint("merge")
    text = F.col(f"`{text_col}`")
    base = docs.select(*columns, _host(docs, host_col).alias("_host"), F.xxhash64(text).alias("_content"), *text_figures(text))
    joined = base.join(removed, (F.col("_host") == F.col("_h")) & (F.col("_content") == F.col("_c")), "left")
    n, rep = F.col("_f.n_words"), F.col("_f.n_repeat_words")
    out = joined.select(
        *[F.col(n).alias(c) for c, n in names.items()], n.alias("n_words"), F.col("_f.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", rep.alias("n_repeat_words"),
        ((n < 50) | (100 * rep > 50 * n)).alias("base_failed"), F.coalesce("n_removed_words", F.lit(0)).alias("n_removed_words"), "removed_lines",
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_left * F.col("n_words")))


def clean(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", length_col: str = "n_chars", **how) -> DataFrame:
    """The kept documents without their common lines, in the columns of `docs`, whatever these are named; `length_col`, if
    there, is brought up to date. Documents without common lines keep their text as it is. Nulls, repeated rows, a missing
    host column and empty tables are as in judge()."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # outputs never clash with columns of docs
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    judged = judge(named, text_col=at[text_col], host_col=at.get(host_col, host_col), **how).filter("kept")
    text = F.col(at[text_col])
    stays = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("removed_lines"), F.xxhash64(normalised(x))))
    text = F.when(F.col("removed_lines").isNull(), text).otherwise(F.array_join(stays, "\n"))
    cells = {c: F.col(n) for c, n in at.items()} | {text_col: text}
    if length_col in cells and dict(docs.dtypes)[length_col] in ("int", "bigint"):
        cells[length_col] = F.when(F.col("removed_lines").isNull(), cells[length_col]).otherwise(F.char_length(text)).cast(docs.schema[length_col].dataType)
    return judged.select(*[v.alias(c) for c, v in cells.items()])
