"""Best-fit packing of documents into sequences under several capacities.

Every piece asks a bin for three things: tokens, one document, and attention cost (its length squared). All three follow
from the piece's length, so the driver packs a histogram of lengths, whose size is bounded by the capacity and not by the
data; pieces then find their bin by their rank among pieces of equal length."""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.llm.tokens import arrow_chunks, encoder, release, small_batches
from massif.plans.shared import stash

ROWS_PER_BUCKET = 2000  # pieces of one length that are ranked together


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and how bins are chosen: `norm` takes the bin whose weighted residual is smallest after
    the piece is placed, `dot` the bin whose residual has the largest weighted product with the piece."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)
    rule: str = "norm"


    def scores(self, residuals: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """How good each residual is for a piece; the lowest is best."""
        scale, weights = np.array([self.tokens, self.documents, self.attention], float), np.array(self.weights)
        left, ask = residuals / scale, ask / scale
        return (weights * (left - ask) ** 2).sum(axis=1) if self.rule == "norm" else -(weights * left * ask).sum(axis=1)

    def fits(self, residual: tuple[int, int, int], length: int) -> int:
        """Pieces of a length that a residual holds."""
        return min(residual[0] // max(length, 1), residual[1], residual[2] // max(length * length, 1))


def plan_bins(histogram: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Vector best fit, longest pieces first: each piece goes to the bin of the best score among those that hold it, of
    equal scores to the least residual; a bin is opened only if none holds it. Gives (length, first_rank, count, first_bin,
    offset): the pieces of that length with ranks from first_rank go, one each, to consecutive bins at that offset.

    Bins of equal residuals are handled together, so steps follow lengths and residuals, not pieces. Under `norm` a bin
    that has taken a piece scores better than before, so it takes equal pieces until it is full; under `dot` it scores
    worse, so all others of its residual come first."""
    full = (cap.tokens, cap.documents, cap.attention)
    states: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual -> runs of bins
    placed, bins = [], 0
    for length in sorted(histogram, reverse=True):
        ask, left, rank = np.array([length, 1, length * length]), histogram[length], 0
        if not cap.fits(full, length):
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        keys = [k for k in states if cap.fits(k, length)]
        queue = [] if not keys else list(zip(cap.scores(np.array(keys, float), ask).tolist(), keys, strict=True))
        heapq.heapify(queue)
        while left:
            if queue:
                key, runs = queue[0][1], states.pop(heapq.heappop(queue)[1])
                each = cap.fits(key, length) if cap.rule == "norm" else 1
            else:  # no other bin holds a piece of this length: new ones take as many as they hold
                key, each = full, cap.fits(full, length)
                runs = [(bins, -(-left // each))]
                bins += runs[0][1]
            rest = []
            while runs:
                first, n = runs.pop()
                parts = [(min(n, left // each), each)]
                parts.append((min(n - parts[0][0], int(0 < left - parts[0][0] * each < each)), left % each))
                for count, deep in parts:
                    if count and deep:
                        placed += [(length, rank + j * count, count, first, cap.tokens - key[0] + j * length) for j in range(deep)]
                        after = (key[0] - deep * length, key[1] - deep, key[2] - deep * length * length)
                        if after not in states and cap.rule == "dot" and cap.fits(after, length):
                            heapq.heappush(queue, (float(cap.scores(np.array([after], float), ask)[0]), after))
                        states.setdefault(after, []).append((first, count))
                        rank, left, first, n = rank + count * deep, left - count * deep, first + count, n - count
                if n:
                    rest.append((first, n))
            if rest:
                states[key] = states.get(key, []) + rest
    return placed


def cut_pieces(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, size: int = 1024, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of whole texts: ids, then `end_id`. Only documents longer than `size` are cut, into pieces of `size` of
    which the first may be shorter; pieces joined in order give the document's ids again. Null text counts as empty."""
    ids_type = docs.schema[id_col].dataType
    schema = f"`{id_col}` {ids_type.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    end = int(end_id).to_bytes(4, "little")
    small_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(tokenizer_path)
        for part in arrow_chunks(batches):
            rows: list[tuple] = []
            for row, packed in enumerate(enc.encode(part.column(1).to_pylist())):
                packed += end
                n = len(packed) // 4
                cuts = [0, n] if n <= size else [0, *range(n % size or size, n + 1, size)]
                rows += [(row, k, a, b - a, zlib.crc32(packed[4 * a : 4 * b]), packed[4 * a : 4 * b] if keep_ids else None) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            take, piece, start, length, crc, raw = zip(*rows, strict=True) if rows else ((),) * 6
            arrays = [part.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype("i4") for x in raw], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def pack(pieces: DataFrame, cap: Capacity = Capacity(), *, id_col: str = "doc_id") -> DataFrame:
    """`pieces` (id, piece, length and any more) with sequence_id and offset.

    Equal rows get places of their own; an empty table gives an empty result. `pieces` should be a stored table, as it
    is read twice. The histogram has at most `cap.tokens` rows; it and the plan made from it are all the driver sees."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sorted(plan_bins(counts, cap))
    key = np.array([(p[0] << 40) + p[1] for p in plan], np.int64)
    bins, offsets = np.array([p[3] for p in plan], np.int64), np.array([p[4] for p in plan], np.int64)
    # Frequent lengths are dealt over many buckets, ranked apart and set one after another.
    buckets = [1] * (cap.tokens + 1)
    for length, n in counts.items():
        buckets[length] = -(-n // ROWS_PER_BUCKET)
    n_buckets = F.array(*[F.lit(b) for b in buckets])[F.col("length").cast("int")]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece", F.lit(7)), n_buckets).cast("int"))
    sizes = dealt.groupBy(F.col("length").alias("_l"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_g", (F.col("_b") / 1000).cast("int"))

    def sum_before(n: str, keys: list[str], by: str) -> Column:
        return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    groups = sizes.groupBy("_l", "_g").agg(F.sum("_n").alias("_m")).withColumn("_base", sum_before("_m", ["_l"], "_g")).drop("_m")
    before = sizes.withColumn("_in", sum_before("_n", ["_l", "_g"], "_b")).join(groups, ["_l", "_g"]).select("_l", "_b", (F.col("_base") + F.col("_in")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(id_col, "piece", "ids_crc32"))
    ranked = dealt.withColumn("_rank", within - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b"))).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.drop("_l", "_b", "_before", "_bucket")
    at, names = ranked.columns.index("length"), [c for c in ranked.columns if c != "_rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at, batch.num_columns - 1))
            k = (length << 40) + rank
            i = np.searchsorted(key, k, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins[i] + (k - key[i]), pa.int64()), pa.array(offsets[i], pa.int64())], [*names, "sequence_id", "offset"])
        release()

    ranked = ranked.select(*names, "_rank")
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, cap: Capacity = Capacity(), *, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack whole documents: one row a piece. Null texts count as empty; repeated rows have places of their
    own; an empty table gives an empty result; columns other than id and text are left out."""
    pieces = cut_pieces(docs, tokenizer_path, end_id=end_id, size=cap.tokens, keep_ids=keep_ids)
    return pack(stash(pieces, "pieces"), cap)
