"""Coding of float samples: a predictor that makes rows compress well, and bounded compression."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def spread(row: np.ndarray) -> bytes:
    """The bytes of a row of 32-bit floats by significance, the highest of all samples first, each less the one before."""
    planes = np.asarray(row, ">f4").view(np.uint8).reshape(-1, 4).T.ravel()
    return np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes()


def gather(data: bytes) -> np.ndarray:
    """The row that spread() took."""
    planes = np.cumsum(np.frombuffer(data, np.uint8), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(">f4").ravel().astype("<f4")


def compress(data: bytes) -> bytes:
    """Zstandard, with the length in front."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def expand(data: bytes, most: int) -> bytes:
    """What compress() took; more than `most` bytes are refused before anything is expanded."""
    size = int.from_bytes(data[:8], "little")
    if size > most:
        raise ValueError(f"{size} bytes exceed {most}")
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True)


def encode_rows(rows: Column) -> Column:
    """Arrays of floats, predicted and compressed; nulls stay null."""
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else compress(spread(np.asarray(r, "f4"))))

    return F.pandas_udf(run, "binary")(rows)


def decode_rows(data: Column) -> Column:
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else gather(expand(bytes(d), 1 << 28)))

    return F.pandas_udf(run, "array<float>")(data)
