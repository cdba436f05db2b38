"""Images as bytes: PNG of 8 bits a sample, by zlib alone. Other formats are Unsupported."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from massif.errors import CorruptData, Unsupported

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value
BANDS = {0: 1, 2: 3, 4: 2, 6: 4}  # fixed values: colour types by their samples a pixel
PIXELS = "width int, height int, bands int, data binary"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of rows by columns by samples; each row is filtered by the samples above, which makes smooth images small."""
    height, width, bands = pixels.shape
    rows = np.asarray(pixels, np.uint8).reshape(height, -1)
    up = np.diff(rows, axis=0, prepend=np.zeros((1, rows.shape[1]), np.uint8)).astype(np.uint8)
    raw = np.concatenate([np.full((height, 1), 2, np.uint8), up], axis=1).tobytes()
    kind = {n: k for k, n in BANDS.items()}[bands]
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 6)) + _chunk(b"IEND", b"")


def _nearest(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the samples to the left, above and above left the one nearest to left plus above less above left."""
    guess = a.astype(int) + b - c
    d = [np.abs(guess - x) for x in (a, b, c)]
    return np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], b, c))


def decode_png(data: bytes) -> np.ndarray:
    """Rows by columns by samples. Interlaced images, palettes and depths other than 8 are Unsupported."""
    if data[:8] != SIGNATURE:
        raise Unsupported("not a PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + part):
            raise CorruptData(f"chunk {kind!r} does not have its checksum")
        head, body, at = (struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head), body + part * (kind == b"IDAT"), at + 12 + size
    width, height, depth, kind, _, _, interlaced = head
    if depth != 8 or kind not in BANDS or interlaced:
        raise Unsupported(f"PNG of depth {depth}, colour type {kind}")
    n = BANDS[kind]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width, n), np.uint8)
    for y in range(height):
        how, line = raw[y, 0], raw[y, 1:].reshape(width, n)
        above = out[y - 1] if y else np.zeros((width, n), np.uint8)
        if how in (0, 2):
            out[y] = line + (above if how else 0)
        elif how == 1:
            out[y] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif how in (3, 4):
            for x in range(width):
                a, c = (out[y, x - 1], above[x - 1]) if x else (np.zeros(n, np.uint8),) * 2
                out[y, x] = line[x] + ((a.astype(int) + above[x]) // 2 if how == 3 else _nearest(a, above[x], c)).astype(np.uint8)
        else:
            raise CorruptData(f"row filter {how}")
    return out


def decoded(content: Column) -> Column:
    """Width, height, samples a pixel and row-major samples of each PNG."""
    def run(content: pd.Series) -> pd.DataFrame:
        images = [decode_png(bytes(c)) for c in content]
        return pd.DataFrame({"width": [i.shape[1] for i in images], "height": [i.shape[0] for i in images], "bands": [i.shape[2] for i in images], "data": [i.tobytes() for i in images]})

    return F.pandas_udf(run, PIXELS)(content)


def encoded(width: Column, bands: Column, data: Column) -> Column:
    """A PNG of row-major samples."""
    def run(width: pd.Series, bands: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([encode_png(np.frombuffer(bytes(d), np.uint8).reshape(-1, w, b)) for w, b, d in zip(width, bands, data, strict=True)])

    return F.pandas_udf(run, "binary")(width, bands, data)
