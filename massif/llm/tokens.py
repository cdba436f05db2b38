"""Token ids of whole texts."""

from __future__ import annotations

import ctypes
import json
import re
import sys
import types
from array import array
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

# Fixed value: the splitting pattern of byte-level BPE with use_regex.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# tiktoken's regex engine gives up on about a million white-space characters in a row, and the task with it.
LONGEST_SPACE = 100_000
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONGEST_SPACE},}}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves,
    the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class TextEncoder:
    """Encodes texts with a `tokenizers` file, giving little-endian unsigned 32-bit ids.

    For a byte-level BPE whose ids follow the order of its merges, tiktoken gives the same ids as the library and is
    several times as fast; it then encodes the texts without special strings or very long white space. All else goes
    to the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        simple = (
            spec.get("normalizer") is None and spec.get("truncation") is None and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex") is True
        )
        self.ranked = self._ranked(spec["model"]) if simple else None
        del spec
        release()

    @staticmethod
    def _ranked(model: dict):
        """A tiktoken encoding with the same ids, or None where the vocabulary isn't in the order of its merges."""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        vocab, letters = model["vocab"], _byte_letters()
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or not set(letters) <= set(vocab):
            return None
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or max(vocab[c] for c in letters) != 255:
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in t): vocab[t] for t in [*letters, *(a + b for a, b in merges)]}
        return tiktoken.Encoding("ranked", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        texts = [t or "" for t in texts]
        out: list = [None] * len(texts)
        hard = [i for i, t in enumerate(texts) if not self.ranked or any(s in t for s in self.special) or (len(t) >= LONGEST_SPACE and _LONG_SPACE.search(t))]
        if hard:
            found = self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)
            for i, e in zip(hard, found, strict=True):
                out[i] = _packed(e.ids)
        if self.ranked:
            encode = self.ranked.encode_ordinary
            out = [_packed(encode(t)) if o is None else o for t, o in zip(texts, out, strict=True)]
        return out


def encoder(path: str) -> TextEncoder:
    """This worker's encoder for a tokenizer file, kept between tasks."""
    store = sys.modules.setdefault("_massif_worker_store", types.ModuleType("_massif_worker_store")).__dict__
    key = f"encoder:{path}"
    if key not in store:
        store[key] = TextEncoder(path)
    return store[key]


def release() -> None:
    """Give memory that a worker no longer uses back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch from Spark's 10,000, which are tens of megabytes of texts in every buffer
    between the JVM and a worker. Another setting than that is the user's and stays."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, "1000")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """For what runs meanwhile, so many rows in a batch: slim rows are better sent in large batches."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def arrow_chunks(batches, size: int = 256):
    """Slices of Arrow batches, so that Python objects are made for a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    release()
