"""WARC archives, written in deterministic shards and read back.

Records are sorted by key, then payload digest, and dealt over ranges of these that follow from an exact histogram, which
is refined where keys crowd, so the same table gives the same files. Each task writes under temporary names; the names of those that succeeded, and no others, are committed."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.llm.tokens import release, small_batches
from massif.plans.shared import arrow_uri, fresh_dir, qualified, stash

ROLL_BYTES = 64 << 20  # compressed bytes at which a file ends
SHARD_BYTES = 32 << 20  # payload bytes that one task writes, about,
MOST_SHARDS = 1 << 16  # unless these many shards must hold more each; files are then rolled by their compressed size
CELLS = 1 << 14  # ranges of keys that one pass of the histogram counts, about
DIGEST_BITS = 60  # of a digest, that order and split the records of one key
MANIFEST = "shard int, file string, temporary string, records long, bytes long"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of name-based UUIDs


def _filesystem(path: str):
    """A file system of any kind Arrow knows (file, hdfs, s3, gs), and the path in it. The path must be qualified(): without
    a scheme it could be taken for a folder of this machine. An unknown scheme is an error."""
    return pafs.FileSystem.from_uri(arrow_uri(path))


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{key}/{digest}/{copy}')}>"


def _line(value: str | None) -> str:
    """A header value on one line: controls and `%` as percent escapes."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, copy: int, date: str) -> bytes:
    """One record as a gzip member. A revisit has the payload's HTTP header and digest, not the payload."""
    digest, revisit = base32_sha1(payload), refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(key, digest, copy)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}", f"X-Key: {'' if key is None else key}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Key: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _crowded(sizes: DataFrame, cells: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The cells (first key, last key, bytes), disjoint and in order, each split into equal ranges; empty ones go."""
    parts = max(16, CELLS // len(cells))
    first, last = np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], np.int64)
    width = np.array([max(1, -(-(c[1] - c[0] + 1) // parts)) for c in cells], np.uint64)

    def count(batches):
        total: dict[int, int] = {}  # one entry a range that has rows
        for batch in batches:
            key, size = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            cell = np.searchsorted(first, key, side="right") - 1
            own = (cell >= 0) & (key <= last[cell])
            key, size, cell = key[own], size[own], cell[own]
            at = (key.view(np.uint64) - first[cell].view(np.uint64)) // width[cell]
            which, back = np.unique(cell * parts + at.astype(np.int64), return_inverse=True)
            for w, n in zip(which.tolist(), np.bincount(back, weights=size).tolist(), strict=True):
                total[w] = total.get(w, 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["part", "bytes"])

    found = sizes.mapInArrow(count, "part long, bytes long").groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()
    out = []
    for r in found:
        cell, at = divmod(r["part"], parts)
        low = cells[cell][0] + at * int(width[cell])
        out.append((low, min(low + int(width[cell]) - 1, cells[cell][1]), r["bytes"]))
    return sorted(out)


def key_ranges(rows: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """(key, digest bits) from which all shards but the first begin. Bytes are summed over ranges of keys; ranges of more
    than a quarter of a shard are split again, until they are light or a single key, however keys are spread. Neighbours
    are joined up to `shard_bytes`; a key of more than that is split by its digests. The driver sees a few ranges a shard,
    of which there are MOST_SHARDS at most."""
    sizes = stash(rows.filter(F.col("key").isNotNull()).select("key", (F.octet_length("payload") + 500).cast("long").alias("bytes")), "record-sizes")
    low, high, total = sizes.agg(F.min("key"), F.max("key"), F.sum("bytes")).first()
    if low is None:
        return []
    most = max(shard_bytes, total // MOST_SHARDS)
    light: list[tuple[int, int, int]] = []
    heavy = [(low, high, total)]
    while heavy:
        split = _crowded(sizes, heavy)
        heavy = [c for c in split if c[2] > most // 4 and c[0] < c[1]]
        light += [c for c in split if not (c[2] > most // 4 and c[0] < c[1])]
    starts, filled = [], 0
    for first, _, size in sorted(light):
        if filled and filled + size > most:
            starts.append((first, 0))
            filled = 0
        more = -(-size // most)
        starts += [(first, (j << DIGEST_BITS) // more) for j in range(1, more)]
        filled += size if more == 1 else most
    return starts


def shard_of(key: Column, digest: Column, starts: list[tuple[int, int]]) -> Column:
    """How many of the starts are not above the key and its digest, by binary search. A null key is in shard 0."""
    keys, bits = np.array([k for k, _ in starts], np.int64), np.array([b for _, b in starts], np.int64)
    split = np.unique(keys[bits > 0])

    @F.pandas_udf("int")
    def find(key: pd.Series, bits_: pd.Series) -> pd.Series:
        at = np.searchsorted(keys, key, side="right")
        for k in np.intersect1d(split, key):
            a, b = np.searchsorted(keys, k), np.searchsorted(keys, k, side="right")
            at[key == k] = a + np.searchsorted(bits[a:b], bits_[key == k], side="right")
        return pd.Series(at.astype(np.int32))

    own = F.conv(F.substr(digest, F.lit(1), F.lit(DIGEST_BITS // 4)), 16, 10).cast("long")
    return F.when(key.isNull(), 0).otherwise(find(F.coalesce(key, F.lit(0)), own))


def revisits(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(key, digest, refers_to) of rows whose payload, of `least_bytes` or more, a row of a larger key has as well, null
    keys being less than all others: the largest is the response. Only keys and digests are shuffled, and summed before
    they are joined."""
    keyed = rows.select("key", "digest", F.octet_length("payload").alias("size")).filter(F.col("size") >= least_bytes)
    largest = keyed.groupBy("digest").agg(F.max("key").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    largest = stash(largest, "responses")  # read by an exchange of its own, so that the rows of one digest can be split
    return keyed.join(largest, "digest").filter(F.col("refers_to").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("refers_to")))).select("key", "digest", "refers_to").distinct()


def write_warc(pages: DataFrame, path: str, *, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row below `path` and return the manifest (shard, file, records, bytes).

    Records go by key, then payload digest; a file ends where its compressed size reaches `roll_bytes` or its shard ends.
    Null payloads count as empty. A null key comes first and is less than all others: it revisits any key that has its
    payload; rows that only have null keys are responses. Of rows equal in key and payload the first is the response or
    the revisit that its payload calls for; the others revisit that response, or their own first row. A payload of any
    length is one record, held whole by the task that writes it. No rows make no files. Columns may have any names; only
    key, url and payload are read. `path` must be one that Arrow can write and all executors share; without a scheme it is
    of the session's default file system."""
    path = qualified(pages.sparkSession, path)
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    if dict(pages.dtypes)[payload_col] != "binary":
        payload = F.encode(payload, "UTF-8")
    rows = pages.select(F.col(f"`{key_col}`").cast("long").alias("key"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    spark, starts = pages.sparkSession, key_ranges(rows, shard_bytes)
    small_batches(spark)
    none = F.lit(None)
    marks = revisits(rows, least_bytes).select("key", none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", "refers_to", F.lit(0).alias("kind"))
    both = marks.union(rows.select("key", "url", "payload", "digest", none.cast("long").alias("refers_to"), F.lit(1).alias("kind")))
    both = both.withColumn("shard", shard_of(F.col("key"), F.col("digest"), starts))
    # A shard a task, each in the partition of its number: hashing would put several into one.
    dealt = both.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", "key", "digest", "kind", "url").select("shard", "key", "url", "payload", "digest", "refers_to", "kind")

    def write(batches):
        fs, root = _filesystem(path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        attempt, done, out, shard, number = uuid.uuid4().hex, [], None, None, 0
        name, records, size = "", 0, 0
        mark, before, copy = None, None, 0

        def end():
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, name, f"{name}.{attempt}", records, size))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                same = (row["key"], row["digest"])
                if row["kind"] == 0:
                    mark = (same, row["refers_to"])
                    continue
                if row["shard"] != shard or out is None or size >= roll_bytes:
                    end()
                    shard, number = row["shard"], number + 1 if row["shard"] == shard else 0
                    name, records, size = f"{shard:06d}-{number:04d}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/_temporary/{name}.{attempt}", compression=None)
                copy = copy + 1 if same == before else 0
                before = same
                refers = mark[1] if mark and mark[0] == same else None
                if refers is None and copy and row["key"] is not None and len(row["payload"]) >= least_bytes:
                    refers = row["key"]
                data = record(row["key"], row["url"], row["payload"], refers, copy, date)
                out.write(data)
                records, size = records + 1, size + len(data)
        end()
        release()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 5, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "file", "temporary", "records", "bytes"])

    written = stash(dealt.mapInArrow(write, MANIFEST), "warc-manifest")
    return commit(spark, written, path)


def commit(spark: SparkSession, written: DataFrame, path: str) -> DataFrame:
    """Move the temporary files that `written` lists to their names, then store the manifest: an archive without one is
    not complete. May be repeated after a failure."""
    def move(batches):
        fs, root = _filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                source = f"{root}/_temporary/{row['temporary']}"
                if fs.get_file_info(source).type == pafs.FileType.File:
                    fs.move(source, f"{root}/{row['file']}")
            yield batch

    moved = written.repartition(max(1, min(200, written.count()))).mapInArrow(move, MANIFEST).drop("temporary")
    moved.write.mode("overwrite").parquet(f"{path}/manifest")
    fs, root = _filesystem(path)
    fs.delete_dir_contents(f"{root}/_temporary", missing_dir_ok=True)
    return spark.read.schema("shard int, file string, records long, bytes long").parquet(f"{path}/manifest")


def members(stream, chunk: int = 1 << 20):
    """The gzip members of a stream, one after another, each inflated."""
    pending = b""
    while pending or (pending := stream.read(chunk)):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not pending and not (pending := stream.read(chunk)):
                raise ValueError("an archive ends within a record")
            parts.append(unpack.decompress(pending))
            pending = unpack.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """A record's fields; its digests and lengths are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(x.partition(": ")[::2] for x in lines)
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"Content-Length: (\d+)", http)[1])
    response = field["WARC-Type"] == "response"
    good = version.startswith("WARC/") and rest[len(block) :] == b"\r\n\r\n" and field["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}"
    if not good or response and (len(payload) != declared or field["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}"):
        raise ValueError(f"record {field.get('WARC-Record-ID')} does not match its digests")
    return {
        "key": int(field["X-Key"]) if field["X-Key"] else None, "url": re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), field["WARC-Target-URI"]),
        "record_type": field["WARC-Type"], "payload_bytes": declared, "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": int(field["X-Refers-To-Key"]) if "X-Refers-To-Key" in field else None, "payload": payload if response else None,
    }


def read_warc(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """(key, url, record_type, payload_bytes, payload_digest, refers_to[, payload]) of every record of a committed
    archive; files are streamed, one record in memory at a time."""
    path = qualified(spark, path)
    manifest = spark.read.schema("shard int, file string, records long, bytes long").parquet(f"{path}/manifest")
    names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def read(batches):
        fs, root = _filesystem(path)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen, held = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        rows.append(parse(data))
                        seen, held = seen + 1, held + len(data)
                        if len(rows) >= 1000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, its manifest {expected}")
                if rows:
                    yield batch_of(rows)
        release()

    schema = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads
    files = manifest.select("file", "records").repartition(max(1, min(10_000, manifest.count())), "file")
    return files.mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write `pages` to a fresh archive in the shared folder and read it back."""
    path = fresh_dir(pages.sparkSession, "warc")
    write_warc(pages, path, **how)
    return read_warc(pages.sparkSession, path)
