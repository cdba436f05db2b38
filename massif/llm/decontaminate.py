"""Benchmark decontamination with suffix arrays over the training text.

Documents are handled in shards. Each shard's words become numbers of the benchmark's vocabulary; only runs of known words
that are long enough to hold a window can match, so the shard's suffix array covers those runs and nothing that matters is
left out. Every benchmark suffix is binary-searched in it, word by word, which gives its longest verbatim match and all
its places."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.llm.tokens import release, small_batches
from massif.plans.shared import stash

# A-Z become a-z; of ASCII, other characters than letters and digits become spaces.
_FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
BLOCK_BYTES = 16 << 20  # benchmark text that one pass over the documents searches for
SHARD_WORDS = 1 << 18  # words of one suffix array


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class TestSet:
    """Benchmark items as numbered words, each item ending in 0."""

    __test__ = False

    def __init__(self, items: list[tuple], window: int):
        self.ids = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        lengths = np.array([len(t) for t in texts], np.int64)
        self.text = np.zeros(int(lengths.sum()) + len(texts), np.int32)
        starts = np.cumsum(lengths + 1) - lengths - 1 if len(texts) else lengths
        self.starts = starts
        for s, t in zip(starts.tolist(), texts, strict=True):
            self.text[s : s + len(t)] = [self.vocabulary[w] for w in t]
        self.longest = int(lengths.max(initial=0))
        # Every place in an item: the item, the words from there to its end, and the words a window from there has.
        self.item = np.repeat(np.arange(len(texts)), lengths)
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.suffix = np.repeat(starts, lengths) + at
        self.left = np.repeat(lengths, lengths) - at
        whole = np.repeat(lengths, lengths)
        self.need = np.where(whole >= window, np.where(self.left >= window, window, 0), np.where(at == 0, whole, 0))
        self.least = int(self.need[self.need > 0].min(initial=window))
        named = sorted(range(len(self.ids)), key=lambda i: str(self.ids[i]))
        self.order = np.zeros(len(named), np.int64)  # of items by id as text, for ties
        self.order[named] = np.arange(len(named))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` in the order of their suffixes, compared over `depth` words at least (0 ends a run)."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, order, k = rank.astype(np.int64), np.argsort(text, kind="stable"), 1
    while k < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        both = rank * (n + 2) + ahead
        order = np.argsort(both, kind="stable")
        ranked = both[order]
        step = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank[order] = step
        if step[-1] == n - 1:
            break
        k *= 2
    return order


def _bounds(text, order, lo, hi, depth, word):
    """Within each range of suffixes that agree on `depth` words: those whose next word is `word`."""
    out = []
    for above in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            got = text[order[np.where(open_, mid, 0)] + depth]
            right = (got <= word) if above else (got < word)
            a = np.where(open_ & right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        out.append(a)
    return out


def search(test: TestSet, text: np.ndarray, order: np.ndarray):
    """For every benchmark suffix: its longest match in words, the range of the suffix array that holds it, and the range
    that holds its window (empty where the window doesn't occur)."""
    n = len(test.suffix)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    longest = np.zeros(n, np.int64)
    best = np.stack([lo, lo], axis=1)
    window = np.zeros((n, 2), np.int64)
    alive = np.arange(n)
    padded = np.concatenate([text, np.zeros(test.longest + 1, np.int32)])
    for depth in range(test.longest):
        alive = alive[test.left[alive] > depth]
        if not len(alive) or not len(order):
            break
        a, b = _bounds(padded, order, lo[alive], hi[alive], depth, test.text[test.suffix[alive] + depth])
        good = a < b
        alive, a, b = alive[good], a[good], b[good]
        lo[alive], hi[alive], longest[alive] = a, b, depth + 1
        best[alive] = np.stack([a, b], axis=1)
        full = test.need[alive] == depth + 1
        window[alive[full]] = np.stack([a[full], b[full]], axis=1)
    return longest, best, window


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    sizes = hi - lo
    return np.repeat(hi - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))


class Shard:
    """The words of some documents, and the suffix array of their runs of known words."""

    def __init__(self, test: TestSet, texts: list[str | None], least: int | None = None):
        words = [words_of(t) for t in texts]
        self.lengths = np.array([len(w) for w in words], np.int64)
        get = test.vocabulary.get
        numbers = np.zeros(int(self.lengths.sum()) + len(words), np.int32)
        at = 0
        for w in words:
            numbers[at : at + len(w)] = [get(x, 0) for x in w]
            at += len(w) + 1
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.numbers = numbers
        known = np.concatenate([[False], numbers > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        first, last = edges[::2], edges[1::2]
        long_enough = last - first >= (test.least if least is None else least)
        first, last = first[long_enough], last[long_enough]
        self.places = _ranges(first, last + 1)  # a run's places and the one after it, whose word ends it
        self.text = numbers[np.minimum(self.places, len(numbers) - 1)] if len(numbers) else numbers
        order = suffix_array(self.text, test.longest) if len(self.text) else np.zeros(0, np.int64)
        self.order = order[self.text[order] > 0]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _shards(batches, size: int):
    """Arrow batches cut so that a shard's text stays near `size` words (five bytes each), one document at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()  # no text becomes a Python object yet
        begin = total = 0
        for i, n in enumerate(lengths):
            if total and total + n > 5 * size:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(lengths):
            yield batch.slice(begin)
        release()


def benchmark_blocks(benchmark: DataFrame, window: int, *, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about `block_bytes`, one in the driver's memory at a time: a larger benchmark is dealt
    over more blocks, each searched in a pass of its own. Gives at least one block, which may be empty."""
    text = F.coalesce(F.octet_length(text_col), F.lit(0)) + 64
    n = max(1, -(-int(benchmark.agg(F.sum(text)).first()[0] or 0) // block_bytes))
    for b in range(n):
        rows = benchmark.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == b).select(id_col, text_col).distinct().collect()
        yield TestSet(sorted(((r[0], r[1]) for r in rows), key=str), window)


def matches(test: TestSet, shard: Shard, suffix: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest verbatim matches among places where a benchmark suffix has its window: those that can't be extended to
    the left (suffix, place), and their words, extended to the right as far as they go."""
    numbers = np.concatenate([shard.numbers, np.zeros(test.longest + 1, np.int32)])
    before = np.where(place > 0, numbers[place - 1], 0)
    first = (before == 0) | (suffix == 0) | (before != test.text[suffix - 1])
    suffix, place = suffix[first], place[first]
    length, alive = np.zeros(len(suffix), np.int64), np.arange(len(suffix))
    while len(alive):
        word = test.text[suffix[alive] + length[alive]]
        alive = alive[(word > 0) & (word == numbers[place[alive] + length[alive]])]
        length[alive] += 1
    return suffix, place, length


_MATCH = "longest_words long, longest_start long, longest_item string, longest_item_word long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, item_text, item_word, n_words, id, start_word): for every benchmark suffix its longest verbatim match in all
    of `docs`, of `least` words or more, and every place of it. item_text tells texts of one item id apart.

    Each shard gives its own longest matches; only those as long as the longest of any shard stay. Null texts match
    nothing; repeated rows give their places each; without documents or items the result is empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    small_batches(docs.sparkSession)
    for number, test in enumerate(benchmark_blocks(benchmark, 10, id_col=item_col, block_bytes=block_bytes)):

        def run(batches, test=test, number=number):
            begins = test.suffix - test.starts[test.item]
            for part in _shards(batches, SHARD_WORDS):
                shard = Shard(test, part.column(1).to_pylist(), least)
                longest, best, _ = search(test, shard.text, shard.order)
                use = np.flatnonzero(longest >= least)
                sizes = best[use, 1] - best[use, 0]
                places = shard.places[shard.order[_ranges(best[use, 0], best[use, 1])]]
                who, doc = np.repeat(use, sizes), shard.document(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([str(test.ids[i]) for i in test.item[who]], pa.string()), pa.array(test.item[who] + (number << 32)), pa.array(begins[who]), pa.array(longest[who]), part.column(0).take(pa.array(doc)), pa.array(places - shard.starts[doc])],
                    ["item", "item_text", "item_word", "n_words", id_col, "start_word"],
                )

        found = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"item string, item_text long, item_word long, n_words long, `{id_col}` {kind}, start_word long")
        found = stash(found, "shard-matches")
        out = found if out is None else out.union(found)
    most = out.groupBy(F.col("item_text").alias("_t"), F.col("item_word").alias("_w")).agg(F.max("n_words").alias("_n"))
    at = (F.col("item_text") == F.col("_t")) & (F.col("item_word") == F.col("_w")) & (F.col("n_words") == F.col("_n"))
    return out.join(most, at).drop("_t", "_w", "_n")


def _better(old: tuple, new: tuple) -> tuple:
    """Of two (words, start, item, item word) the longer match; of equals the first by start, item and word."""
    return old if (-old[0], *old[1:]) <= (-new[0], *new[1:]) else new


def _search_block(docs: DataFrame, test: TestSet, columns: list[str], text_col: str) -> DataFrame:
    """`columns` of docs with n_words, n_hit, hit (bitmap of hit words, null if none), items and longest match, those of
    earlier blocks included where docs has them."""
    earlier = {"hit", "items"} <= set(docs.columns)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in columns)

    def run(batches):
        for part in _shards(batches, SHARD_WORDS):
            shard = Shard(test, part.column(1).to_pylist())
            n = len(shard.lengths)
            _, _, window = search(test, shard.text, shard.order)
            use = np.flatnonzero(window[:, 0] < window[:, 1])
            sizes = window[use, 1] - window[use, 0]
            places = shard.places[shard.order[_ranges(window[use, 0], window[use, 1])]]
            who = np.repeat(use, sizes)
            need, item, doc = test.need[who], test.item[who], shard.document(places)
            width = int(shard.lengths.sum()) + n + 1
            cover = np.bincount(places, minlength=width)[:width] - np.bincount(places + need, minlength=width)[:width]
            hit = np.cumsum(cover) > 0
            pairs = np.unique(doc * (len(test.ids) + 1) + item)
            hits: list = [set() for _ in range(n)]  # items of one id and several texts count once
            for d, i in zip((pairs // (len(test.ids) + 1)).tolist(), (pairs % (len(test.ids) + 1)).tolist(), strict=True):
                hits[d].add(str(test.ids[i]))
            found = [sorted(h) for h in hits]
            best: list = [None] * n
            suffix, at, length = matches(test, shard, test.suffix[who], places)
            who = np.searchsorted(test.suffix, suffix)
            d, begin, item = shard.document(at), at - shard.starts[shard.document(at)], test.item[who]
            word = suffix - test.starts[item]
            order = np.lexsort((word, test.order[item], begin, -length, d))
            for k in order[np.flatnonzero(np.diff(d[order], prepend=-1))].tolist():
                best[d[k]] = (int(length[k]), int(begin[k]), str(test.ids[item[k]]), int(word[k]))
            bounds = list(zip(shard.starts.tolist(), shard.lengths.tolist(), strict=True))
            if earlier:
                before = zip(*(part.column(c).to_pylist() for c in range(2, 8)), strict=True)
                for d, (old, more, *match) in enumerate(before):
                    if old:
                        s, k = bounds[d]
                        hit[s : s + k] |= np.unpackbits(np.frombuffer(old, np.uint8), count=k).astype(bool)
                        found[d] = sorted({*found[d], *more})
                        best[d] = _better(tuple(match), best[d]) if best[d] else tuple(match)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[shard.starts + shard.lengths] - total[shard.starts]
            bits = [np.packbits(hit[s : s + k]).tobytes() if f else None for (s, k), f in zip(bounds, found, strict=True)]
            told = [pa.array([(b or (0, None, None, None))[c] for b in best], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[8:], pa.array(shard.lengths), pa.array(n_hit), pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string())), *told],
                [*columns, "n_words", "n_hit", "hit", "items", *LONGEST],
            )

    none = {"hit": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")} | {c: F.lit(None).cast("string" if c == "longest_item" else "long") for c in LONGEST}
    before = [(F.col(c) if earlier else v).alias(f"_{c}") for c, v in none.items()]
    ordered = docs.select(F.lit(0).alias("_pad"), F.col(f"`{text_col}`").alias("_text"), *before, *[F.col(f"`{c}`") for c in columns])
    return ordered.mapInArrow(run, f"{kinds}n_words long, n_hit long, hit binary, items array<string>, {_MATCH}")


LONGEST = ("longest_words", "longest_start", "longest_item", "longest_item_word")
OUTPUTS = {"n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated", "hit", *LONGEST}


def scan(docs: DataFrame, benchmark: DataFrame, *, keep: list[str] | None = None, window: int = 10, text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`keep` (default: all) columns of docs with n_words, n_hit (words inside an occurrence of a window), n_items,
    items_sha256, contaminated, items (those whose windows occur, sorted as strings), hit (bitmap of hit words, most
    significant bit first, null if none), and the document's longest verbatim match of a window or more: longest_words,
    longest_start, longest_item, longest_item_word (0 and nulls if none; of equals the first by start, item and word).

    A window is `window` consecutive words of an item; an item of fewer words is one window. Null texts have no words;
    repeated rows are judged each; repeated items and texts of one item id count once; without documents or items nothing
    is hit. A very long text is a shard of its own, searched whole. A column of `docs` named like an output gives way to
    it."""
    columns = [c for c in (keep or docs.columns) if c not in OUTPUTS]
    found, carried = docs.drop(*OUTPUTS - {text_col}), [*dict.fromkeys([*columns, text_col])]
    held = None
    small_batches(docs.sparkSession)
    for test in benchmark_blocks(benchmark, window, id_col=item_col, text_col="text", block_bytes=block_bytes):
        if held is not None:
            found = stash(_search_block(found, held, carried, text_col), "decontaminated")
        held = test
    found = _search_block(found, held, columns, text_col)
    items = F.array_sort("items")
    return found.select(
        *[F.col(f"`{c}`") for c in columns], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *LONGEST, items.alias("items"), "hit",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """`docs` without the affected documents, in their own columns, whatever these are named; nulls, repeated rows and
    empty tables are as in scan()."""
    names = [f"_{i}" for i in range(len(docs.columns))]  # outputs never clash with columns of docs
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text = names[docs.columns.index(how.pop("text_col", "text"))]
    found = scan(kept, benchmark, keep=names, text_col=text, **how).filter(~F.col("contaminated"))
    return found.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
