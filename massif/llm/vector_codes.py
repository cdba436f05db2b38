"""Compression of vectors to short codes: a vector is cut into equal parts, each part is replaced by the number of the
nearest entry of that part's codebook, and codebooks are learnt in rounds over all vectors.

A round is one treeAggregate over blocks of vectors, each a NumPy matrix with a row for every dimension: distances
accumulate dimension by dimension, every block adds to a tensor of int64 sums and counts, and these tensors, whose size
depends on parts and entries only, merge through a reduction tree. All arithmetic is on integers, so results depend
neither on the blocks nor on the order of merging."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massif.llm.simhash import few
from massif.llm.tokens import arrow_rows, release
from massif.plans.shared import stash

BLOCK_ROWS = 4096  # vectors in a block
STRIDE = 2048  # vectors whose distances to all entries are held at once


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and dimension within the part."""

    entries: np.ndarray

    def digest(self) -> str:
        """The SHA-256, in hexadecimal, of all components in decimal, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def finite(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    def good(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return vector.isNotNull() & F.forall(vector, good)


def quantised(rows: DataFrame, *, id_col: str, vector_col: str, label_col: str | None, parts: int, scale: int) -> DataFrame:
    """(_id, _label, q) of the usable vectors, q being floor(scale * x) of each component. Vectors are of the length that
    most have and that parts divide evenly, the greater of equally frequent ones."""
    vector = F.col(f"`{vector_col}`")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = rows.filter(finite(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    kept = stash(kept.select(F.col(f"`{id_col}`").alias("_id"), label.alias("_label"), whole.alias("q")), "quantised")
    most = kept.groupBy(F.size("q").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return kept.filter(F.size("q") == most["dims"]) if most else kept


def matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """A list column as a matrix with a row for every dimension.

    Components so large that a sum of squares could leave 64 bits are an error."""
    q = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    most = int(2 ** 30.5 / dims**0.5)
    if len(q) and (q.max() > most or q.min() < -most):
        raise ValueError(f"a component is beyond {most} after scaling")
    return np.ascontiguousarray(q.T)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of a part's block the nearest entry, the first of equals, and its squared distance."""
    near, least = np.empty(part.shape[1], np.int64), np.empty(part.shape[1], np.int64)
    for at in range(0, part.shape[1], STRIDE):
        some = part[:, at : at + STRIDE]
        far = np.zeros((len(book), some.shape[1]), np.int64)
        for j, row in enumerate(some):
            off = book[:, j, None] - row
            off *= off
            far += off
        best = far.argmin(axis=0)
        near[at : at + STRIDE], least[at : at + STRIDE] = best, far[best, np.arange(len(best))]
    return near, least


def first_entries(kept: DataFrame, *, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, ascending; of equal ids the smaller vector comes first, null ids
    come last."""
    rows = kept.orderBy(F.asc_nulls_last("_id"), "q").limit(entries).select("q").collect()
    width = len(rows[0]["q"]) // parts if rows else 0
    return np.array([r["q"] for r in rows], np.int64).reshape(len(rows), parts, width).transpose(1, 0, 2)


def learn_round(kept: DataFrame, books: np.ndarray, *, block_rows: int = BLOCK_ROWS, depth: int = 2) -> np.ndarray:
    """Codebooks after one round: each entry that was nearest to some parts becomes floor(sum / count) of these."""
    parts, entries, width = books.shape
    dims = parts * width

    def block(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([matrix(batch.column(0), dims).astype("<i8").tobytes()], pa.binary())], ["block"])
        release()

    def add(total: np.ndarray, row) -> np.ndarray:
        columns = np.frombuffer(row["block"], "<i8").reshape(dims, -1)
        for p in range(parts):
            part = columns[p * width : (p + 1) * width]
            near, _ = nearest(part, books[p])
            for j in range(width):
                np.add.at(total[p, :, j], near, part[j])
            np.add.at(total[p, :, width], near, 1)
        return total

    def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left += right
        return left

    with arrow_rows(kept.sparkSession, block_rows):
        blocks = kept.select("q").mapInArrow(block, "block binary").rdd
        total = blocks.treeAggregate(np.zeros((parts, entries, width + 1), np.int64), add, merge, depth)
    sums, counts = total[:, :, :width], total[:, :, width:]
    return np.where(counts > 0, sums // np.maximum(counts, 1), books)


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(_id, _label, code, error) of each vector."""
    parts, _, width = books.shape
    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("_id", "_label"))

    def run(batches):
        for batch in batches:
            columns = matrix(batch.column(2), parts * width)
            found = [nearest(columns[p * width : (p + 1) * width], books[p]) for p in range(parts)]
            digits = np.stack([near for near, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(np.sum([far for _, far in found], axis=0), pa.int64())], ["_id", "_label", "code", "error"])
        release()

    return kept.select("_id", "_label", "q").mapInArrow(run, f"{kinds}, code string, error long")


def compress(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error) of each usable vector, and the codebooks.

    A code has two hexadecimal digits a part; error is the squared distance of a vector to what its code stands for, in
    units of 1/scale; label_error sums it over equal labels, null labels together. Each codebook starts as that part of
    the vectors of the `entries` smallest ids; fewer vectors make smaller codebooks.

    Null vectors and vectors with null or non-finite components are left out, and so are vectors of another length than
    most have. Null ids are kept and never start a codebook while others can; repeated rows are rows each; of several
    entries at one distance the first is taken; components may be of any size that keeps sums in 64 bits, beyond which
    the job fails; an empty table gives an empty result and codebooks without entries. Only the id, vector and label
    columns are read, whatever else there is, and columns of any name will do."""
    if not 1 <= entries <= 256:
        raise ValueError("two hexadecimal digits hold 256 entries at most")
    kept = quantised(rows, id_col=id_col, vector_col=vector_col, label_col=label_col, parts=parts, scale=scale)
    books = first_entries(kept, parts=parts, entries=entries)
    for _ in range(rounds if books.size else 0):
        books = learn_round(kept, books)
    coded = stash(encode(kept, books), "vector-codes")
    sums = stash(coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of"), "label-errors")
    told = coded.join(few(sums), F.col("_label").eqNullSafe(F.col("_of"))).select(F.col("_id").alias("id"), F.col("_label").alias("label"), "code", "error", "label_error")
    return told, Codebooks(books)
