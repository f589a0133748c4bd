"""PNG images in strips: written by many tasks, and read as a data source with a partition for each strip that is asked for."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..shipping import ship
from .png import _SIGNATURE, decode

#: Lines of a strip.
STRIP_LINES = 64
#: Our chunk of a PNG that says where strips begin; other readers pass over it.
_INDEX = b"stRp"
_PIXELS = "path string, x int, y int, r short, g short, b short"
#: Lets Spark hand filters to data sources in Python.
PUSHDOWN = ("spark.sql.python.filterPushdown.enabled", "true")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _joined(first: int, second: int, length: int) -> int:
    """Adler-32 of two stretches of bytes from theirs, the second being so long."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % base
    b = (b1 + b2 + (length % base) * (a1 - 1)) % base
    return b << 16 | a


def _packed(lines: np.ndarray) -> tuple[bytes, int]:
    """Lines (n, width, 3) as a stretch of a deflate stream that needs nothing before it, and their checksum."""
    raw = np.hstack([np.zeros((len(lines), 1), np.uint8), lines.reshape(len(lines), -1)]).tobytes()  # unfiltered
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw)


def write_png(pixels: DataFrame, uri: str, width: int, height: int, lines: int = STRIP_LINES) -> None:
    """Write pixels(x, y, r, g, b) as one image; y counts from the bottom, missing pixels are black, those beyond the canvas are left out.

    Tasks compress a strip each. One puts the compressed strips into the file, as a file has one writer.
    """
    ship(pixels.sparkSession)
    strip = F.floor((height - 1 - F.col("y")) / lines).cast("int")
    known = pixels.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)).select(strip.alias("strip"), *[F.col(c).cast("int").alias(c) for c in ("x", "y", "r", "g", "b")])
    every = pixels.sparkSession.range(-(-height // lines)).select(F.col("id").cast("int").alias("strip"), *[F.lit(None).cast("int").alias(c) for c in ("x", "y", "r", "g", "b")])

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        top = key[0].as_py() * lines
        canvas = np.zeros((min(lines, height - top), width, 3), np.uint8)
        rows = rows.filter(rows["x"].is_valid())
        at = height - 1 - rows["y"].to_numpy() - top, rows["x"].to_numpy()
        for k, c in enumerate("rgb"):
            canvas[(*at, k)] = rows[c].to_numpy()
        packed, check = _packed(canvas)
        return pa.table({"strip": pa.array([key[0].as_py()], pa.int32()), "packed": [packed], "check": pa.array([check], pa.int64()), "size": pa.array([canvas.size + len(canvas)], pa.int64())})

    strips = known.unionByName(every).groupBy("strip").applyInArrow(pack, "strip int, packed binary, check long, size long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["strip"])
        check, at, places, body = 1, 0, [], []
        for k, r in enumerate(rows):
            part = (b"\x78\x9c" if k == 0 else b"") + r["packed"]
            check = _joined(check, r["check"], r["size"])
            if k == len(rows) - 1:
                part += b"\x03\x00" + struct.pack(">I", check)
            places.append((at + 8 + 2 * (k == 0), len(r["packed"])))  # behind the chunk's head and, at first, that of the stream
            body.append(_chunk(b"IDAT", part))
            at += len(body[-1])
        head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
        index = struct.pack(">II", lines, len(places))
        start = len(_SIGNATURE) + len(head) + 12 + len(index) + 16 * len(places)
        index += b"".join(struct.pack(">QQ", start + p, n) for p, n in places)
        system, path = _open(uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as out:
            for part in (_SIGNATURE, head, _chunk(_INDEX, index), *body, _chunk(b"IEND", b"")):
                out.write(part)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["strips"])

    strips.repartition(1).mapInArrow(write, "strips long").collect()


@dataclass
class Strip(InputPartition):
    """A stretch of lines of one image; without an offset the image has no index and is read whole."""

    uri: str
    name: str
    width: int
    height: int
    top: int
    lines: int
    offset: int | None
    size: int


class PngReader(DataSourceReader):
    """Reads RGB pixels. Options pick strips and pixels by x and y; columns are those of the schema that the reader is given."""

    def __init__(self, schema: StructType, options):
        self.schema, self.uri = schema, options["path"]
        self.low = {n: float(options.get(f"low_{n}", "-inf")) for n in "xy"}
        self.high = {n: float(options.get(f"high_{n}", "inf")) for n in "xy"}

    def partitions(self) -> list[InputPartition]:
        system, path = _open(self.uri)
        found = system.get_file_info(path)
        files = [found] if found.is_file else [i for i in system.get_file_info(fs.FileSelector(path, recursive=True)) if i.is_file and i.path.endswith(".png")]
        return [s for f in sorted(files, key=lambda f: f.path) for s in self._strips(system, f) if self._wanted(s)]

    def _strips(self, system: fs.FileSystem, file: fs.FileInfo) -> list[Strip]:
        prefix = self.uri.split("://")[0] + "://" if "://" in self.uri else "file://" if self.uri.startswith("file:") else ""
        uri = prefix + file.path
        with system.open_input_file(file.path) as f:
            if f.read(8) != _SIGNATURE:
                raise ValueError(f"{file.path} is no PNG file")
            _, _, width, height, depth, colour, _, _, interlaced = struct.unpack(">I4sIIBBBBB", f.read(21))
            if depth != 8 or colour != 2 or interlaced:
                raise ValueError(f"{file.path} must have 3 channels of 8 bits without interlacing")
            f.read(4)
            size, kind = struct.unpack(">I4s", f.read(8))
            if kind != _INDEX:
                return [Strip(uri, file.path, width, height, 0, height, None, file.size)]
            body = f.read(size)
        lines, n = struct.unpack(">II", body[:8])
        places = [struct.unpack(">QQ", body[8 + 16 * k : 24 + 16 * k]) for k in range(n)]
        return [Strip(uri, file.path, width, height, k * lines, min(lines, height - k * lines), p, s) for k, (p, s) in enumerate(places)]

    def _wanted(self, strip: Strip) -> bool:
        return strip.height - 1 - strip.top >= self.low["y"] and strip.height - strip.top - strip.lines <= self.high["y"] and self.low["x"] < strip.width and self.high["x"] >= 0

    def read(self, strip: Strip | None) -> Iterator[pa.RecordBatch]:
        if strip is None:  # no strip is wanted
            return
        system, path = _open(strip.uri)
        with system.open_input_file(path) as f:
            if strip.offset is None:
                lines = decode(f.read())
            else:
                f.seek(strip.offset)
                raw = zlib.decompressobj(-15).decompress(f.read(strip.size))
                lines = np.frombuffer(raw, np.uint8).reshape(strip.lines, 1 + 3 * strip.width)[:, 1:].reshape(strip.lines, strip.width, 3)
        y = strip.height - 1 - (strip.top + np.arange(len(lines)))
        x = np.arange(strip.width)
        rows, columns = (np.flatnonzero((at >= self.low[n]) & (at <= self.high[n])) for n, at in (("y", y), ("x", x)))
        lines = lines[rows][:, columns]
        pixel = {"x": np.tile(x[columns], len(rows)).astype(np.int32), "y": np.repeat(y[rows], len(columns)).astype(np.int32)}
        pixel |= {c: lines[:, :, k].ravel().astype(np.int16) for k, c in enumerate("rgb")}
        pixel["path"] = pa.array([strip.name] * len(pixel["x"])) if "path" in self.schema.names else None
        yield pa.RecordBatch.from_arrays([pa.array(pixel[n]) for n in self.schema.names], self.schema.names)


class PngFilteredReader(PngReader):
    """Takes filters on x and y as well. Spark refuses it in sessions that don't hand filters on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in self.low and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low[name] = max(self.low[name], f.value + (1 if isinstance(f, GreaterThan) else 0))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.high[name] = min(self.high[name], f.value - (1 if isinstance(f, LessThan) else 0))
            else:
                yield f


class PngStrips(DataSource):
    """``spark.read.format("png_strips").load(path)``: (path, x, y, r, g, b), or the columns of them that ``schema`` names."""

    @classmethod
    def name(cls) -> str:
        return "png_strips"

    def schema(self) -> str:
        return _PIXELS

    def reader(self, schema: StructType) -> PngReader:
        return (PngFilteredReader if self.options.get("filters") == "true" else PngReader)(schema, self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    if not spark._jsparkSession.sessionState().dataSourceManager().dataSourceExists(PngStrips.name()):
        spark.dataSource.register(PngStrips)


def read_strips(spark: SparkSession, uri: str, columns: str = _PIXELS, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None) -> DataFrame:
    """The pixels of an image or a folder of images, within x and y (both ends included) if these are given.

    In sessions with the setting PUSHDOWN, filters on x and y reach the source by themselves.
    """
    register(spark)
    filters = spark.conf.get(PUSHDOWN[0], "false")
    reader = spark.read.format(PngStrips.name()).schema(columns).option("filters", filters)
    for name, ends in (("x", x), ("y", y)):
        if ends is not None:
            reader = reader.option(f"low_{name}", str(ends[0])).option(f"high_{name}", str(ends[1]))
    return reader.load(uri)
