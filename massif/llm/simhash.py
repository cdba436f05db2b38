"""SimHash near-duplicates by meeting in the middle.

Every fingerprint emits all variants within half the radius; two fingerprints within the radius share a variant. For an
odd radius the two half balls end one bit apart, so each variant is emitted once for each of a few blocks of bits with
that block wiped: one differing bit falls into some wiped block, and the rest are met half way. Wider radii wipe several
blocks at once: with any two of four wiped, of six differing bits two at most are left to be met half way. Colliding
fingerprints are verified, and only a spanning forest of the verified links leaves a group, so a dense group gives no
square of pairs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.llm.tokens import arrow_chunks, arrow_rows, release, small_batches
from massif.operators.components import connected_components
from massif.plans.shared import shuffle_width, stash

BITS = 64


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits that over half of some unsigned hashes have, given in parts; none give zero."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """A text's SimHash, unsigned: majority bits of the XXH64 of its shingles, repeats included. Fewer words make one
    shingle; none give zero."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    n = max(1, len(parts) - words + 1)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    places = (zip(starts[at : at + (1 << 18)], ends[at : at + (1 << 18)], strict=True) for at in range(0, n, 1 << 18))
    return majority(np.array([xxh64_intdigest(line[a:b], seed) for a, b in part], "<u8") for part in places)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, digest, fp) of each row; digest identifies the text, fp is the fingerprint as a signed long."""

    def run(batches):
        for part in arrow_chunks(batches):
            fps = np.array([fingerprint(t, words) for t in part.column(2).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64())], [id_col, "digest", "fp"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(id_, F.xxhash64(text).alias("digest"), text).mapInArrow(run, f"`{id_col}` {kind}, digest long, fp long")


OUTPUTS = ("digest", "fp", "component", "component_id")


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text): names that no output has."""
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))


def under_name(found: DataFrame, id_col: str) -> DataFrame:
    """A result under the caller's name of the id, which stays `_id` where an output has that name."""
    return found if id_col in OUTPUTS else found.withColumnRenamed("_id", id_col)


def variant_masks(radius: int, blocks: int, wiped: int | None = None, flips: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bits kept, bits flipped and block marks) of the variants that each fingerprint emits: for any choice of `wiped`
    blocks (one for an odd radius, else none) what is left of the fingerprint, with up to half of the differing bits
    flipped that the best choice can leave, or up to `flips` bits."""
    wiped = radius % 2 if wiped is None else wiped
    left = radius - wiped * (radius // blocks) - min(wiped, radius % blocks)  # of bits spread evenly, the worst case
    bounds = [b * BITS // blocks for b in range(blocks + 1)]
    keep, flip = [], []
    for mark, chosen in enumerate(combinations(range(blocks), wiped)):
        hole = sum((1 << bounds[b + 1]) - (1 << bounds[b]) for b in chosen)
        free = [j for j in range(BITS) if not hole >> j & 1]
        for k in range(((left + 1) // 2 if flips is None else flips) + 1):
            for bits in combinations(free, k):
                keep.append(~hole & (1 << BITS) - 1)
                flip.append(sum(1 << j for j in bits) | (mark << bounds[chosen[0]] if chosen else 0))
    return np.array(keep, np.uint64), np.array(flip, np.uint64)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within the radius among distinct fingerprints."""
    out, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            close = np.bitwise_count(rest ^ at) <= radius
            if close.any():
                met = rest[close]
                out += [(at, x) for x in met]
                queue += list(met)
                rest = rest[~close]
    return out


def _across(links: list[tuple[int, int]], label: dict[int, int]) -> list[tuple[int, int]]:
    """Those of the links that join what the labels leave apart."""
    joined: dict[int, int] = {}

    def root(x):
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    out = []
    for u, v in links:
        a, b = root(label[int(u)]), root(label[int(v)])
        if a != b:
            joined[a] = b
            out.append((u, v))
    return out


def _links(keys: np.ndarray, fps: np.ndarray, labels: np.ndarray, radius: int) -> np.ndarray:
    """Verified links among rows sorted by key, as rows of two fingerprints; equal labels count as linked."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    two = starts[sizes == 2]
    a, b = fps[two], fps[two + 1]
    good = (np.bitwise_count(a ^ b) <= radius) & (labels[two] != labels[two + 1])
    found = [np.stack([a[good], b[good]], axis=1)]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        label = labels[s : s + n]
        if (label == label[0]).all():
            continue
        forest = _across(_forest(np.unique(fps[s : s + n]), radius), dict(zip(fps[s : s + n].tolist(), label.tolist(), strict=True)))
        if forest:
            found.append(np.array(forest, np.uint64).reshape(-1, 2))
    both = np.concatenate(found)
    return np.unique(np.sort(both, axis=1), axis=0)


def near_links(fps: DataFrame, *, radius: int = 3, blocks: int = 4, wiped: int | None = None, flips: int | None = None) -> DataFrame:
    """(u, v) links that join every two fingerprints (column fp, distinct) within the radius, directly or through others
    of their group. Of `blocks` blocks `wiped` at a time are wiped, one by default where the radius is odd, else none:
    wider ones emit fewer, shorter keys. Fewer `flips` than the radius needs find some of the links. Where a column
    component tells what is joined already, only links across components are given."""
    keep, flip = variant_masks(radius, blocks, wiped, flips)
    carried = ["fp", *(c for c in fps.columns if c == "component")]

    def emit(batches):
        for part in arrow_chunks(batches, 2048):
            fp = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            key = ((fp[:, None] & keep) | 0) ^ flip
            rest = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), len(keep))) for c in part.columns]
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), *rest], ["key", *carried])

    def link(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the last group, which may go on in the next batch

        def joined():
            k, f, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return as_batch(_links(k, f, c, radius))

        for batch in batches:
            k, f, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, len(carried)))
            f = f.view(np.uint64)
            if not len(k):
                continue
            first, last = (np.searchsorted(k, held[-1][0][-1], "right") if held else 0), np.searchsorted(k, k[-1])
            if first:
                held.append((k[:first], f[:first], c[:first]))
            if first < len(k):
                if held:
                    yield joined()
                if first < last:
                    yield as_batch(_links(k[first:last], f[first:last], c[first:last], radius))
                held.append((k[last:], f[last:], c[last:]))
        if held:
            yield joined()
        release()

    def as_batch(found):
        found = found.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], ["u", "v"])

    spark = fps.sparkSession
    sent = fps.select(*carried).mapInArrow(emit, ", ".join(f"{c} long" for c in ["key", *carried])).repartition(shuffle_width(spark), "key").sortWithinPartitions("key")
    return sent.mapInArrow(link, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, blocks: int = 4, words: int = 3) -> DataFrame:
    """(id, digest, fp, component, component_id) of each row: components are joined by links of `radius` differing bits or
    fewer; component_id is the smallest id in one, component tells them apart even where ids repeat.

    Null texts and texts without words have fingerprint zero and are linked like any other; very long texts are whole,
    their shingles counted a stretch at a time. Rows with a null id take part; a component of such rows alone has a null
    component_id. Repeated rows are all kept; an empty table gives an empty result. The id keeps its name, unless an
    output has it: then it is `_id`."""
    prints = stash(fingerprints(plain(docs, id_col, text_col), id_col="_id", text_col="_text", words=words), "fingerprints")
    distinct = stash(prints.groupBy("fp").agg(F.min("_id").alias("first")), "distinct-fingerprints")
    with arrow_rows(docs.sparkSession, 10_000):
        links = stash(near_links(distinct, radius=radius, blocks=blocks), "links")
    nodes = connected_components(links).join(distinct, F.col("node") == F.col("fp"))
    named = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = nodes.select("node", "component").join(named, "component").select("node", "component", "component_id")
    known = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    known = stash(known, "components")  # read by an exchange of its own, so that the rows of one fingerprint can be split
    return under_name(prints.join(known, F.col("fp") == F.col("_fp")).drop("_fp"), id_col)


FEW_ROWS = 1 << 20  # of three longs at most: such a side is broadcast, whatever Spark expects of its size


def few(rows: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A stored table, to be broadcast if it has no more than `most` rows; else joins of it are merged."""
    return F.broadcast(rows) if rows.count() <= most else rows.hint("merge")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near=near_duplicates, few_rows: int = FEW_ROWS, **how) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id, and one only where ids or rows repeat. `near` finds
    the components.

    Who stays is settled on ids and digests; texts are read again and only lose the rows that go. Up to `few_rows` of
    these (their number is counted) reach the readers by broadcast and no text is shuffled, beyond that by a merge join.
    Only rows that repeat are numbered. A null id is an id of its own, the first of all; very long texts are texts like
    any other; an empty table gives an empty result; columns may have any names."""
    found = near(plain(docs, id_col, text_col), id_col="_id", text_col="_text", **how)
    empty = F.lit("" if dict(docs.dtypes)[id_col] == "string" else 0).cast(docs.schema[id_col].dataType)

    def keys(id_: Column, digest: Column) -> list[Column]:
        return [id_.isNull().alias("_none"), F.coalesce(id_, empty).alias("_id"), digest.alias("_digest")]

    names = ["_none", "_id", "_digest"]
    rows = found.select(F.col("component").alias("_c"), F.struct(*keys(F.col("_id"), F.col("digest"))).alias("_r"))
    rows = stash(rows.groupBy("_c", "_r").agg(F.count(F.lit(1)).alias("_n")), "component-rows")
    first = stash(rows.groupBy("_c").agg(F.min("_r").alias("_first")), "first-rows")
    marked = rows.join(first, "_c").filter((F.col("_r") != F.col("_first")) | (F.col("_n") > 1))
    marked = stash(marked.select("_r.*", (F.col("_r") == F.col("_first")).alias("_stays")), "marked-rows")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keys(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))))
    alone = keyed.join(few(marked.select(*names), few_rows), names, "left_anti").select("_row.*")
    again = stash(marked.filter("_stays").select(*names), "repeated-rows")
    one = F.row_number().over(Window.partitionBy(*names).orderBy(*names))
    return alone.union(keyed.join(few(again, few_rows), names, "left_semi").withColumn("_n", one).filter("_n = 1").select("_row.*"))


def near_components(fps: DataFrame, *, radius: int, blocks: int, wiped: int) -> DataFrame:
    """(node, component) of the fingerprints (column fp, distinct) that links of `radius` bits or fewer join to others.

    Variants without flips settle most links first; all variants then meet, and give only links across what is joined: a
    dense cluster, which meets under every variant, leaves few links and not a forest for each variant."""
    how = {"radius": radius, "blocks": blocks, "wiped": wiped}
    with arrow_rows(fps.sparkSession, 10_000):
        first = stash(near_links(fps, flips=0, **how), "wiped-links")
        nodes = connected_components(first)
        known = fps.join(few(nodes), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))
        more = stash(near_links(stash(known, "joined-fingerprints"), **how), "links")
    return connected_components(first.union(more))
