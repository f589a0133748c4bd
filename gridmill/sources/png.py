"""PNG images as tables of pixels, decoded on the executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, RGB, grey with alpha, RGB with alpha.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced PNG as (height, width, channels), top row first."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None:
        raise ValueError("the PNG has no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in _CHANNELS or interlaced:
        raise ValueError("only 8-bit PNGs without palette or interlacing are read")
    n = _CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    return _unfiltered(rows[:, 0], rows[:, 1:].reshape(height, width, n))


def _unfiltered(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines.

    A sample follows from those to its left, above and at the corner between,
    so all samples of an anti-diagonal are found at once.
    """
    if np.any(kinds > 4):
        raise ValueError(f"unknown PNG filter {int(kinds.max())}")
    height, width, n = lines.shape
    done = np.zeros((height + 1, width + 1, n), np.int16)  # blank above the first line and before the first column
    for t in range(width + height - 1):
        y = np.arange(max(0, t - width + 1), min(height - 1, t) + 1)
        x, kind = t - y, kinds[y][:, None]
        left, up, corner = done[y + 1, x], done[y, x + 1], done[y, x]
        p = left + up - corner
        a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)
        done[y + 1, x + 1] = (lines[y, x] + guess) & 0xFF
    return done[1:, 1:].astype(np.uint8)


def encode(pixels: np.ndarray) -> bytes:
    """An RGB PNG of samples (height, width, 3), top row first."""
    height, width, _ = pixels.shape
    raw = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def read_png(spark: SparkSession, path: str, size: tuple[int, int] | None = None) -> DataFrame:
    """(path, x, y, r, g, b) of the images at a path; y counts from the bottom.

    Images must have three channels, and the given (width, height) if any.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                pixels = decode(bytes(content))
                height, width, channels = pixels.shape
                if channels != 3:
                    raise ValueError(f"{name} must have 3 channels, it has {channels}")
                if size and size != (width, height):
                    raise ValueError(f"{name} is {width} x {height}, not {size[0]} x {size[1]}")
                for top in range(0, height, 256):
                    part = pixels[top : top + 256]
                    y, x = np.mgrid[top : top + len(part), 0:width]
                    flat = part.reshape(-1, 3)
                    yield pd.DataFrame(
                        {"path": name, "x": x.ravel(), "y": height - 1 - y.ravel(), "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]}
                    )

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, x int, y int, r short, g short, b short")


def dimensions(image: DataFrame) -> DataFrame:
    return image.groupBy("path").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
