"""Near-duplicates by the exact Jaccard similarity of word shingles.

SimHash, met in the middle, proposes first: sets whose fingerprints are joined by links of two differing bits or fewer
meet, on whole fingerprints, so that unrelated ones do not meet by chance. Pairs at similarity 0.8 differ in about ten
bits, and no radius that holds them all can be met in the middle, so MinHash bands propose the rest, among sets that are not joined yet: texts that agree in all values of a band meet. At
similarity 0.8 a pair misses all 32 bands of 4 values with probability 5e-8.

Every link is verified on the whole shingle sets: first neighbours within a group that meets, then, in groups that these
links leave in several components, the members outside a group's largest component against all of it. Such groups are cut
into cells of a few hundred sets, so none is ever in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.llm import simhash
from massif.llm.simhash import few
from massif.llm.tokens import arrow_chunks, small_batches
from massif.operators.components import connected_components
from massif.plans.shared import shuffle_width, stash

RADIUS, BLOCKS, WIPED = 2, 4, 0  # 65 variants of a fingerprint, of all its 64 bits
BANDS, VALUES = 32, 4
FEW, MANY = 256, 512  # sets, about, of the two sides of a cell
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, (BANDS * VALUES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 64, (BANDS * VALUES, 1), np.uint64)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text's lower-cased (ASCII) words, hashed, sorted. Fewer words make one shingle; none
    give none."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(w) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))


def band_keys(found: np.ndarray) -> list[int]:
    """A key of each band, as signed longs; none for an empty set."""
    from xxhash import xxh64_digest

    if not len(found):
        return []
    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (_FACTORS * found[at : at + 4096] + _OFFSETS).min(axis=1))
    return np.frombuffer(b"".join(xxh64_digest(b.tobytes(), i) for i, b in enumerate(least.reshape(BANDS, VALUES))), "<i8").tolist()


def _prints(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int) -> DataFrame:
    """(id, digest, fp, sim, bands) of each row; fp identifies the shingle set, sim is its SimHash, null for an empty set."""
    from xxhash import xxh64_digest

    def run(batches):
        for part in arrow_chunks(batches):
            sets = [shingles(t, words) for t in part.column(2).to_pylist()]
            fps = np.frombuffer(b"".join(xxh64_digest(s.tobytes()) for s in sets), "<i8")
            sims = pa.array(np.array([simhash.majority([s]) for s in sets], np.uint64).view(np.int64), mask=np.array([not len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps), sims, pa.array([band_keys(s)[:bands] for s in sets], pa.list_(pa.int64()))], [id_col, "digest", "fp", "sim", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.xxhash64(text_col).alias("digest"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, digest long, fp long, sim long, bands array<long>")


def _sets(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(fp, shingles) of the rows (id, digest) in chosen, once for each fp."""

    def run(batches):
        for part in arrow_chunks(batches):
            sets = [shingles(t, words).view(np.int64) for t in part.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["fp", "shingles"])

    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_digest"), F.col(text_col).alias("_text"))
    at = texts["_id"].eqNullSafe(chosen["id"]) & (texts["_digest"] == chosen["digest"])
    return texts.join(few(chosen), at).select("fp", "_text").mapInArrow(run, "fp long, shingles array<long>").dropDuplicates(["fp"])


def links_across(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs (indexes) at `similarity` or more that join whatever labels they can: members of one label count as joined."""
    sizes, labels = np.array([len(s) for s in sets]), labels.copy()
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
    counts, bounds = np.bincount(codes), np.concatenate([[0], np.cumsum(sizes)])
    begins = np.cumsum(counts) - counts
    out = []
    for i in range(len(sets)):
        other = labels != labels[i]
        if not other.any():
            break
        mine = codes[bounds[i] : bounds[i + 1]]
        shared = np.zeros(len(sets), np.int64)
        for at in range(0, len(mine), 4096):
            n, first = counts[mine[at : at + 4096]], begins[mine[at : at + 4096]]
            places = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            shared += np.bincount(owners[places], minlength=len(sets))
        near = np.flatnonzero(other & (shared / (sizes + sizes[i] - shared) >= similarity))
        for label, j in zip(*np.unique(labels[near], return_index=True), strict=True):
            out.append((i, int(near[j])))
            labels[labels == label] = labels[i]
    return out


def _links_in_groups(members: DataFrame, similarity: float) -> DataFrame:
    """(u, v) links across the components of each group; members has (key, fp, component, shingles).

    What is outside a group's largest component is dealt into some columns of cells, the whole group into rows of cells:
    in each cell the former are held, about FEW, and the latter streamed past them. A cell gives links that join
    components, never all pairs."""
    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top"))
    shape = shape.select("key", F.col("top.component").alias("largest"), F.ceil(F.col("all") / MANY).alias("rows"), F.ceil((F.col("all") - F.col("top.n")) / FEW).alias("columns"))
    placed = members.join(stash(shape, "group-shapes"), "key")

    def along(n: str, own: str | None) -> Column:
        return F.pmod(F.xxhash64("fp", F.lit(own)), F.col(n)) if own else F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    held = placed.filter("component <> largest").select("key", along("rows", None).alias("row"), along("columns", "c").alias("column"), F.lit(0).alias("side"), "fp", "component", "shingles")
    past = placed.select("key", along("rows", "r").alias("row"), along("columns", None).alias("column"), F.lit(1).alias("side"), "fp", "component", "shingles")
    cells = held.union(past).repartition(shuffle_width(members.sparkSession), "key", "row", "column").sortWithinPartitions("key", "row", "column", "side", "fp")

    def run(batches):
        cell, few, joined = None, [], {}

        def root(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        def link(more):
            rows = few + more
            pairs = links_across([r[1] for r in rows], np.array([root(r[2]) for r in rows]), similarity) if few and more else []
            for i, j in pairs:
                joined[root(rows[i][2])] = root(rows[j][2])
            return pa.RecordBatch.from_arrays([pa.array([rows[p[c]][0] for p in pairs], pa.int64()) for c in range(2)], ["u", "v"])

        for part in arrow_chunks(batches):
            flat, ends = part.column(6).flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(part.column(6).value_lengths().to_numpy())])
            more: list = []
            for k, (key, row, column, side, fp, label) in enumerate(zip(*[part.column(c).to_pylist() for c in range(6)], strict=True)):
                if (key, row, column) != cell:
                    yield link(more)
                    cell, few, joined, more = (key, row, column), [], {}, []
                (more if side else few).append((fp, flat[ends[k] : ends[k + 1]].copy(), label))
            yield link(more)

    return cells.mapInArrow(run, "u long, v long").distinct()


def _join(met: DataFrame, sets: DataFrame, similarity: float, links: DataFrame | None = None, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, nodes): `links` and those that join the sets that meet under one key, and the components they give. Sets
    that `links` have joined, as `nodes` tells, are not compared again."""
    pairs = met.filter("next is not null").select(F.col("fp").alias("u"), F.col("next").alias("v")).distinct()
    if nodes is not None:
        known = few(nodes)
        pairs = pairs.join(known.toDF("u", "_a"), "u", "left").join(known.toDF("v", "_b"), "v", "left").filter("_a is null or _b is null or _a <> _b").select("u", "v")
    both = pairs.join(sets.toDF("u", "_a"), "u").join(sets.toDF("v", "_b"), "v").select("u", "v", F.size("_a").alias("_m"), F.size("_b").alias("_n"), F.size(F.array_intersect("_a", "_b")).alias("_both"))
    found = stash(both.filter(F.col("_both") / (F.col("_m") + F.col("_n") - F.col("_both")) >= similarity).select("u", "v"), "links")
    links = links.union(found) if links is not None else found
    nodes = connected_components(links)
    labelled = met.join(nodes, F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("component", "fp").alias("component"))
    groups = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("same"), F.min("component").alias("_a"), F.max("component").alias("_b"))
    groups = groups.filter("n > 2 and _a < _b").groupBy("n", "same").agg(F.min("key").alias("key")).select("key")  # equal groups of several bands once
    members = labelled.join(groups, "key").join(sets, "fp").select("key", "fp", "component", "shingles")
    more = stash(_links_in_groups(members, similarity), "links-in-groups")
    if not more.isEmpty():
        links = links.union(more)
        nodes = connected_components(links)
    return links, nodes


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, radius: int = RADIUS, blocks: int = BLOCKS, wiped: int = WIPED, bands: int = BANDS) -> DataFrame:
    """(id, digest, fp, component, component_id) of each row: components are joined by links of texts whose shingle sets
    have a Jaccard similarity of `similarity` or more; component_id is the smallest id in one, component tells them apart
    even where ids repeat.

    SimHash proposes every pair that links of `radius` bits or fewer join, wider ones with some of `blocks` blocks of bits
    `wiped`, and `bands` MinHash bands propose the rest. Null
    texts and texts without words are alike and like no other; very long texts are compared whole. Rows with a null id take
    part; a component of such rows alone has a null component_id. Repeated rows are all kept; an empty table gives an
    empty result. The id keeps its name, unless an output has it: then it is `_id`."""
    name, docs, id_col, text_col = id_col, simhash.plain(docs, id_col, text_col), "_id", "_text"
    small_batches(docs.sparkSession)
    prints = stash(_prints(docs, id_col, text_col, words, bands), "shingle-prints")
    row = F.struct(F.col(id_col).isNull(), F.col(id_col).alias("id"), "digest")
    distinct = stash(prints.groupBy("fp").agg(F.min(row).alias("_r"), F.first("sim").alias("sim"), F.first("bands").alias("bands")).select("fp", "_r.id", "_r.digest", "sim", "bands"), "distinct-shingle-sets")
    sims = distinct.filter("sim is not null").select(F.col("sim").alias("fp")).distinct()
    balls = simhash.near_components(sims, radius=radius, blocks=blocks, wiped=wiped)
    keys = F.concat(F.array(F.struct(F.lit(False).alias("far"), F.coalesce("component", "sim").alias("key"))), F.transform("bands", lambda b: F.struct(F.lit(True).alias("far"), b.alias("key"))))
    keyed = distinct.filter("sim is not null").join(few(balls), F.col("sim") == F.col("node"), "left").select("fp", F.explode(keys).alias("_k")).select("_k.*", "fp")
    order = Window.partitionBy("far", "key").orderBy("fp")
    met = keyed.select("far", "key", "fp", F.lead("fp").over(order).alias("next"), F.lag("fp").over(order).alias("before"))
    met = stash(met.filter(F.col("next").isNotNull() | F.col("before").isNotNull()), "met")
    chosen = stash(distinct.join(met.select("fp").distinct(), "fp", "left_semi").select("fp", "id", "digest"), "met-sets")
    sets = stash(_sets(docs, chosen, id_col, text_col, words), "shingle-sets")
    links, nodes = _join(met.filter("not far"), sets, similarity)
    links, nodes = _join(met.filter("far"), sets, similarity, links, nodes)
    known = nodes.join(distinct.select("fp", "id"), F.col("node") == F.col("fp"))
    named = known.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = known.select("node", "component").join(named, "component").select("node", "component", "component_id")
    known = distinct.join(linked, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "fp").alias("component"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    known = stash(known, "components")  # read by an exchange of its own, so that the rows of one set can be split
    return simhash.under_name(prints.drop("sim", "bands").join(known, F.col("fp") == F.col("_fp")).drop("_fp"), name)
