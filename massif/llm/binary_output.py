"""Token ids as packed binary matrices.

Documents are dealt into blocks by a hash of the row, so blocks, and with them sequences, follow from the rows alone and
not from how they lie in partitions. A block is tokenised, packed by best fit decreasing, with a segment tree over the
capacities left, and written as a shard. Tasks write under temporary names; only the files of those that succeeded are
listed in the manifest and moved to their names, so a lost executor leaves nothing behind."""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm.tokens import arrow_chunks, encoder, release, small_batches
from massif.llm.warc import MANIFEST, _filesystem, commit
from massif.plans.shared import fresh_dir, qualified, stash

BLOCK_BYTES = 24 << 20  # text that makes a block, on average: some six million tokens
MOST_TASKS = 1 << 14  # a task handles several blocks, one after another, where there are more
KINDS = ("ids", "positions", "lengths", "rows", "segments")
ENDINGS = {"segments": "parquet", "positions": "npy.zst"}  # positions are nearly all runs: compressed, they take little


class CapacityTree:
    """How many bins have each capacity left; finds the smallest capacity that holds a piece in logarithmic time."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.width
        while at:
            self.count[at] += by
            at >>= 1

    def at_least(self, size: int) -> int | None:
        at = size + self.width
        if self.count[at]:
            return size
        while at > 1 and (at & 1 or not self.count[at + 1]):  # up, until a right neighbour has bins
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.width:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each piece, and the number of bins: longest pieces first, each into the fullest bin that holds
    it, the first in order among equals."""
    tree, bins = CapacityTree(size), {}
    where, offset, n = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] > size:
            raise ValueError(f"a piece of {lengths[i]} tokens exceeds {size}")
        left = tree.at_least(lengths[i])
        if left is None:
            left, at, n = size, n, n + 1
        else:
            at = bins[left].pop()
            tree.add(left, -1)
        where[i], offset[i] = at, size - left
        bins.setdefault(left - lengths[i], []).append(at)
        tree.add(left - lengths[i], 1)
    return where, offset, n


def cuts(n: int, size: int) -> list[int]:
    """Where a document of n ids is cut: only if longer than `size`, into pieces of `size` of which the first may be
    shorter."""
    return [0, n] if n <= size else [0, *range(n % size or size, n + 1, size)]


def pack_block(pieces: list[bytes], size: int, pad_id: int, id_bytes: int) -> tuple[dict[str, np.ndarray], list[int], list[int]]:
    """Matrices of ids and of positions (from zero in each segment; zero in padding), cumulative segment lengths of each
    sequence (from zero) with each sequence's place among them; and sequence and offset of each piece."""
    lengths = [len(p) // 4 for p in pieces]
    where, offset, n = best_fit_decreasing(lengths, size)
    ids = np.full((n, size), pad_id, f"<u{id_bytes}")
    positions = np.zeros((n, size), "<u4" if size > 1 << 16 else "<u2")
    for raw, row, at, length in zip(pieces, where, offset, lengths, strict=True):
        got = np.frombuffer(raw, "<u4")
        if length and int(got.max()) >> 8 * id_bytes:
            raise ValueError(f"ids need more than {id_bytes} bytes")
        ids[row, at : at + length] = got
        positions[row, at : at + length] = np.arange(length)
    order = sorted(range(len(pieces)), key=lambda i: (where[i], offset[i]))
    sums: list[list[int]] = [[0] for _ in range(n)]
    for i in order:
        sums[where[i]].append(offset[i] + lengths[i])
    flat = np.array([x for s in sums for x in s], "<i4")
    return {"ids": ids, "positions": positions, "lengths": flat, "rows": np.cumsum([0, *map(len, sums)]).astype("<i8")}, where, offset


def write_packed(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 2, pad_id: int = 0, id_bytes: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write whole texts, each its ids and `end_id`, below `path`, and return the manifest.

    A shard has five files: .ids.npy and .positions.npy.zst (sequences by `size`), .lengths.npy (cumulative segment
    lengths), .rows.npy (each sequence's place in them) and .segments.parquet (id, piece, start, length, row, offset). Only
    documents longer than `size` are cut, and their pieces joined in order give the ids again. A null text counts as empty,
    so it is its end id alone; null ids and repeated rows are kept; an empty table gives an empty manifest; columns other
    than the two are left out. Sequences are packed within blocks; each leaves one or two that aren't full. Rows equal in
    id and text share a block; one that they make four times too long is packed in parts, in memory one at a time."""
    end, path = int(end_id).to_bytes(4, "little"), qualified(docs.sparkSession, path)
    small_batches(docs.sparkSession)
    slim = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    total = slim.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    slim = slim.withColumn("digest", F.xxhash64("id", "text"))
    slim = slim.withColumn("block", F.pmod("digest", F.lit(n_blocks)))
    tasks = min(n_blocks, MOST_TASKS)
    dealt = slim.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "id", "digest").select("block", "id", "text")

    def write(batches):
        fs, root = _filesystem(path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        enc, attempt = encoder(tokenizer_path), uuid.uuid4().hex
        pieces: list[bytes] = []
        cells: list[tuple] = []
        done, held, block, part_no, kind = [], 0, -1, 0, None

        def end_block():
            nonlocal pieces, cells, held, part_no
            if not pieces:
                return
            name = f"{block:08d}-{part_no:04d}"
            arrays, where, offset = pack_block(pieces, size, pad_id, id_bytes)
            key, piece, start, length = zip(*cells, strict=True)
            table = pa.table({"id": pa.array(key, kind), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "row": pa.array(where, pa.int64()), "offset": pa.array(offset, pa.int64())})
            for what in KINDS:
                file = f"{name}.{what}.{ENDINGS.get(what, 'npy')}"
                with fs.open_output_stream(f"{root}/_temporary/{file}.{attempt}", compression="zstd" if what == "positions" else None) as out:
                    if what == "segments":
                        pq.write_table(table, out, compression="zstd")
                    else:
                        np.lib.format.write_array(out, arrays[what], allow_pickle=False)
                done.append((block, file, f"{file}.{attempt}", len(arrays["ids"]), fs.get_file_info(f"{root}/_temporary/{file}.{attempt}").size))
            pieces, cells, held, part_no = [], [], 0, part_no + 1

        for part in arrow_chunks(batches):
            kind = part.column(1).type
            for at_block, key, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), enc.encode(part.column(2).to_pylist()), strict=True):
                if at_block != block:
                    end_block()
                    block, part_no = at_block, 0
                elif held >= block_bytes:  # four times the tokens that its text, on average, has
                    end_block()
                packed += end
                at = cuts(len(packed) // 4, size)
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    pieces.append(packed[4 * a : 4 * b])
                    cells.append((key, k, a, b - a))
                held += at[-1]
        end_block()
        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*done, strict=True) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "file", "temporary", "records", "bytes"])

    return commit(docs.sparkSession, stash(dealt.mapInArrow(write, MANIFEST), "packed-manifest"), path)


def read_packed(spark: SparkSession, path: str, *, id_type: str = "long", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every segment, out of the matrices of a
    committed output. Lengths, positions and padding are checked against each other."""
    path = qualified(spark, path)
    manifest = spark.read.schema("shard int, file string, records long, bytes long").parquet(f"{path}/manifest").filter("file LIKE '%.segments.parquet'")
    schema = f"id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * keep_ids

    def load(fs, root: str, name: str, what: str) -> np.ndarray:
        with fs.open_input_stream(f"{root}/{name}.{what}.{ENDINGS.get(what, 'npy')}", compression="zstd" if what == "positions" else None) as stream:
            return np.lib.format.read_array(io.BytesIO(stream.read()), allow_pickle=False)

    def read(batches):
        fs, root = _filesystem(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                name = file.removesuffix(".segments.parquet")
                ids, positions, lengths, rows = (load(fs, root, name, k) for k in KINDS[:4])
                with fs.open_input_file(f"{root}/{file}") as f:
                    table = pq.read_table(f).combine_chunks()
                row, offset, length = (table[c].to_numpy() for c in ("row", "offset", "length"))
                crc, kept = [], []
                for r, a, n in zip(row.tolist(), offset.tolist(), length.tolist(), strict=True):
                    sums = lengths[rows[r] : rows[r + 1]]
                    k = int(np.searchsorted(sums, a))
                    if sums[k] != a or sums[k + 1] != a + n or not np.array_equal(positions[r, a : a + n], np.arange(n)):
                        raise ValueError(f"{name}: sequence {r} disagrees with its segments")
                    got = ids[r, a : a + n].astype("<u4")
                    crc.append(zlib.crc32(got.tobytes()))
                    if keep_ids:
                        kept.append(got.astype("i8"))
                block, part_no = map(int, name.split("-"))
                arrays = [*(table[c].combine_chunks() for c in ("id", "piece", "start", "length")), pa.array(crc, pa.int64()), pa.array(row + (block << 40) + (part_no << 28), pa.int64()), pa.array(offset, pa.int64())]
                if keep_ids:
                    arrays.append(pa.array(kept, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids)
        release()

    return manifest.select("file").repartition(max(1, min(10_000, manifest.count())), "file").mapInArrow(read, schema)


def packed_round_trip(docs: DataFrame, tokenizer_path: str, **how) -> DataFrame:
    """Write `docs` to a fresh folder in the shared one and read the segments back."""
    path = fresh_dir(docs.sparkSession, "packed")
    write_packed(docs, path, tokenizer_path, **how)
    return read_packed(docs.sparkSession, path, id_type=docs.schema[how.get("id_col", "doc_id")].dataType.simpleString())
