"""Language-model scores by a probabilistic suffix tree over words.

A state is a context of one to three words. Candidates are contexts that make up a given share of all tokens, as in the
published method, so there are at most 1/share of each length whatever the corpus; a candidate stays if its next-symbol
distribution diverges from that of its suffix by more than its parameters cost, and its suffixes stay with it. Each word
is scored in the longest state that its context ends in, with distributions interpolated down to word frequencies.

All training texts are counted: words by one aggregation, n-grams level by level, where a level counts only n-grams both
of whose shorter parts were frequent. Words below the share, whose number grows with the corpus, are never collected:
documents meet their counts in a join."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.llm.tokens import arrow_chunks, release, small_batches
from massif.plans.shared import stash

SHARE = 2.0**-19  # of all tokens: the least frequency of words and n-grams in the tree
DEPTH = 3  # words in the longest context
PULL = 8.0  # how many occurrences the next shorter context's distribution counts for
BLOCK_TOKENS = 1 << 19  # tokens that are worked on at once
_STRETCH = 1 << 21  # bytes of a text that are cut into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
END = xxhash.xxh64_intdigest(b"\n")  # no word has white space


class _Hashes(dict):
    """XXH64 of words, remembered for the words seen last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _runs(text: str | None, hashes: _Hashes):
    """Keys of a text's tokens, a stretch of it at a time; the last run ends with the end token."""
    data, at = (text or "").encode().lower(), 0
    while True:
        cut = _SPACE.search(data, at + _STRETCH)
        stop = cut.start() if cut else len(data)
        words = data[at:stop].split()
        keys = np.empty(len(words) + (cut is None), np.uint64)
        keys[: len(words)] = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        if cut is None:
            keys[-1] = END
            yield keys
            return
        yield keys
        at = stop


@dataclass
class Block:
    """Tokens of several documents one after another: their keys, documents, places in the document, and whether they are
    here for themselves or only as context of the next."""

    keys: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    own: np.ndarray

    def grams(self, depth: int):
        """For each length up to depth + 1 the keys of the n-grams that end at each token, and whether they lie within
        the document."""
        gram = self.keys
        yield gram, np.ones(len(gram), bool)
        for n in range(1, depth + 1):
            earlier = np.concatenate([np.zeros(1, np.uint64), gram[:-1]])
            mixed = (earlier ^ (earlier >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + self.keys
            gram = mixed ^ (mixed >> np.uint64(32))
            yield gram, self.places >= n


def blocks(batches, depth: int, text_column: int = 0):
    """(batch, Block) over Arrow batches: rows of a block are rows of the batch. A long document goes through several
    blocks, each repeating the last words of the one before as context."""
    hashes = _Hashes()
    for batch in arrow_chunks(batches):
        held, size = [], 0
        for row, text in enumerate(batch.column(text_column).to_pylist()):
            done, tail = 0, np.zeros(0, np.uint64)
            for keys in _runs(text, hashes):
                joined = np.concatenate([tail, keys])
                places = np.arange(done - len(tail), done + len(keys))
                held.append((joined, np.full(len(joined), row), places, places >= done))
                done, size, tail = done + len(keys), size + len(keys), joined[len(joined) - depth :] if len(joined) > depth else joined
                if size >= BLOCK_TOKENS:
                    yield batch, Block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield batch, Block(*(np.concatenate(x) for x in zip(*held, strict=True)))


class Table:
    """Values by sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at


@dataclass
class Tree:
    """What scoring needs beside the counts of rare words, by level: log10 of the probability of a word after a state, for
    n-grams that are kept, and what a state leaves to the next shorter one, as log10 too."""

    tokens: int
    distinct: int
    words: Table  # occurrences of the frequent words
    entries: list[Table]
    states: list[Table]

    @property
    def depth(self) -> int:
        return len(self.states)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text leaves 2 when divided by 7. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_words(texts: DataFrame) -> DataFrame:
    """(key, n) of every token of a one-column table of texts; words are combined within a task before the shuffle."""

    def run(batches):
        total, held = [], 0

        def flush():
            keys, n = np.concatenate([k for k, _ in total]), np.concatenate([n for _, n in total])
            total.clear()
            found, back = np.unique(keys, return_inverse=True)
            return found, np.bincount(back, weights=n).astype(np.int64)

        for _, block in blocks(batches, 0):
            total.append(np.unique(block.keys[block.own], return_counts=True))
            held += len(total[-1][0])
            if held >= 1 << 22:
                total.append(flush())
                held = len(total[0][0])
                if held >= 1 << 21:
                    yield as_batch(*flush())
                    held = 0
        if total:
            yield as_batch(*flush())
        release()

    def as_batch(keys, n):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def count_grams(texts: DataFrame, length: int, known: np.ndarray, least: float) -> DataFrame:
    """(key, context, suffix, n) of the n-grams of a length that occur `least` times or more. `known` are the sorted keys of
    the frequent ones one word shorter: both parts of a frequent n-gram are among them, all others aren't counted."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        frequent = Table(shared.value, shared.value)
        total, held = [], 0
        for _, block in blocks(batches, length - 1):
            *_, (short, _), (gram, whole) = block.grams(length - 1)
            there, _ = frequent.find(short)
            chosen = np.flatnonzero(block.own & whole & there & np.concatenate([np.zeros(1, bool), there[:-1]]))
            found, first, n = np.unique(gram[chosen], return_index=True, return_counts=True)
            total.append((found, short[chosen[first] - 1], short[chosen[first]], n))
            held += len(found)
            if held >= 1 << 21:
                yield as_batch(total)
                total, held = [], 0
        if total:
            yield as_batch(total)
        release()

    def as_batch(total):
        keys, contexts, suffixes, n = (np.concatenate(x) for x in zip(*total, strict=True))
        found, first, back = np.unique(keys, return_index=True, return_inverse=True)
        columns = [found.view(np.int64), contexts[first].view(np.int64), suffixes[first].view(np.int64), np.bincount(back, weights=n, minlength=len(found)).astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "context", "suffix", "n"])

    counted = texts.mapInArrow(run, "key long, context long, suffix long, n long")
    counted = counted.groupBy("key").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least)


def grow(words: Table, tokens: int, distinct: int, levels: list[dict[str, np.ndarray]], pull: float = PULL) -> Tree:
    """The tree over frequent n-grams, given by level from two words on.

    A context's gain is its count times the Kullback-Leibler divergence of its distribution from that of its suffix, over
    its frequent next words and all others as one; it stays if that is over half the logarithm of its count for each of
    these. Suffixes of contexts that stay do too."""
    counts, lower = words, Table(words.keys, (words.values + 1) / (tokens + distinct + 1))
    found = []
    for level in levels:
        have, at = counts.find(level["context"])
        context, group = np.unique(level["context"], return_inverse=True)
        total = np.zeros(len(context))
        total[group] = counts.values[at]
        n = level["n"].astype(float)
        _, below = lower.find(level["suffix"])
        under = lower.values[below]
        kept_n, kept_p, branches = np.bincount(group, n, len(context)), np.bincount(group, under, len(context)), np.bincount(group, minlength=len(context))
        rest, rest_p = np.maximum(total - kept_n, 0) / total, np.maximum(1 - kept_p, 1e-12)
        gain = np.bincount(group, n * np.log(n / total[group] / under), len(context)) + total * np.where(rest > 0, rest * np.log(np.maximum(rest, 1e-300) / rest_p), 0)
        left = (total - kept_n + pull) / (total + pull)
        chance = n / (total[group] + pull) + left[group] * under
        suffix = np.zeros(len(context), np.uint64)
        if found:  # a context's own suffix is the suffix of the n-gram that it is
            back = Table(levels[len(found) - 1]["key"], levels[len(found) - 1]["suffix"])
            suffix = back.values[back.find(context)[1]]
        found.append({"context": context, "group": group, "key": level["key"], "chance": chance, "left": left, "stays": gain > 0.5 * (branches + 1) * np.log(np.maximum(total, 2)), "suffix": suffix})
        counts, lower = Table(level["key"], level["n"]), Table(level["key"], chance)
    for upper, below in zip(reversed(found[1:]), reversed(found[:-1]), strict=True):
        below["stays"] |= np.isin(below["context"], upper["suffix"][upper["stays"]])
    entries, states = [], []
    for f in found:
        stays = f["stays"][f["group"]]
        entries.append(Table(f["key"][stays], np.log10(f["chance"][stays])))
        states.append(Table(f["context"][f["stays"]], np.log10(f["left"][f["stays"]])))
    return Tree(tokens, distinct, words, entries, states)


def collected(rows: DataFrame) -> dict[str, np.ndarray]:
    """A bounded table of longs as arrays; keys are unsigned."""
    got = rows.toArrow()
    arrays = {c: got.column(c).to_numpy() for c in got.column_names}
    return {c: a if c == "n" else a.view(np.uint64) for c, a in arrays.items()}


def learn(texts: DataFrame, *, share: float = SHARE, depth: int = DEPTH, pull: float = PULL) -> tuple[Tree, DataFrame]:
    """The tree of a one-column table of texts, and the stored counts (key, n) of all its tokens. What is collected are
    words and n-grams that make up a share of all tokens: at most 1/share of each length."""
    small_batches(texts.sparkSession)
    counts = stash(count_words(texts), "word-counts")
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    least = max(2.0, share * sizes["tokens"])
    often = collected(counts.filter(F.col("n") >= least))
    words, levels = Table(often["key"], often["n"]), []
    known = words.keys[words.keys != END]  # the end token is never part of a context, but ends n-grams
    for length in range(2, depth + 2):
        ends = np.sort(np.append(known, END)) if length == 2 else known
        level = collected(count_grams(texts, length, ends, least)) if len(known) else {"key": known}
        if not len(level["key"]):
            break
        levels.append(level)
        known = np.sort(level["key"])
    return grow(words, sizes["tokens"], sizes["distinct"], levels, pull), counts


def block_scores(block: Block, tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token log10 of its probability as a word alone and in the tree, and whether it is a rare word: for these
    log10(n + 1), n being its count, has to be added to both."""
    frequent, at = tree.words.find(block.keys)
    size = np.log10(tree.tokens + tree.distinct + 1)
    alone = np.where(frequent, np.log10((tree.words.values[at] if len(tree.words.values) else 0) + 1.0), 0.0) - size
    grams = list(block.grams(tree.depth))
    chances, open_ = np.zeros(len(alone)), np.ones(len(alone), bool)
    for k in range(tree.depth, 0, -1):
        context, gram = np.concatenate([np.zeros(1, np.uint64), grams[k - 1][0][:-1]]), grams[k][0]
        some = np.flatnonzero(open_ & (block.places >= k))
        there, state = tree.states[k - 1].find(context[some])
        some, state = some[there], state[there]
        kept, entry = tree.entries[k - 1].find(gram[some])
        chances[some[kept]] += tree.entries[k - 1].values[entry[kept]]
        open_[some[kept]] = False
        chances[some[~kept]] += tree.states[k - 1].values[state[~kept]]
    return alone, np.where(open_, chances + alone, chances), ~frequent


def score(docs: DataFrame, tree: Tree, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each row, its whole text and the end token after it:
    log10 probabilities of the text, by word frequencies and by the tree. A word that training lacks has the chance of a
    word that occurs no times; both models are distributions over the words of training and one for all others.

    A null text is empty, so the end token alone. Repeated rows and ids are judged each; a null id is kept; an empty table
    gives an empty result. Very long texts go through memory a stretch at a time. Only the id and text columns are read,
    whatever their names."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch, block in blocks(batches, tree_depth, 2):
            alone, chance, rare = block_scores(block, shared.value)
            own = block.own
            starts = np.flatnonzero(np.concatenate([[True], block.rows[1:] != block.rows[:-1]]))
            rows = block.rows[starts]

            def summed(x, starts=starts):
                return np.add.reduceat(x, starts)

            odd = np.flatnonzero(own & rare)
            order = odd[np.lexsort((block.keys[odd], block.rows[odd]))]
            keys, whose = block.keys[order], block.rows[order]
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (whose[1:] != whose[:-1])])) if len(keys) else np.zeros(0, np.int64)
            offsets = np.searchsorted(whose[first], np.append(rows, rows[-1] + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (keys[first].view(np.int64), np.diff(np.append(first, len(keys))).astype(np.int32))]
            sums = [pa.array(summed(np.where(own, x, 0))) for x in (np.ones(len(own), np.int64), (~rare).astype(np.int64), alone, chance)]
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), *sums, *lists], names)
        release()

    names = ["_rid", "_id", "n_tokens", "n_known", "base", "chance", "rare", "times"]
    tree_depth, kind = tree.depth, docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    parts = stash(read.mapInArrow(run, f"_rid long, _id {kind}, n_tokens long, n_known long, base double, chance double, rare array<long>, times array<int>"), "scored-parts")
    rare = parts.select("_rid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("_rid", F.col("w.rare").alias("key"), F.col("w.times").alias("times"))
    met = rare.join(counts, "key").groupBy("_rid").agg(F.sum("times").alias("n_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"))
    zero = F.lit(0.0)
    every = parts.select("_rid", "_id", "n_tokens", "n_known", "base", "chance", zero.alias("more")).union(met.select("_rid", F.lit(None).cast(kind), F.lit(0), "n_known", zero, zero, "more"))
    total = every.groupBy("_rid").agg(F.max("_id").alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "chance", "more")])
    return total.select("id", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("chance") + F.col("more")).alias("score"))
