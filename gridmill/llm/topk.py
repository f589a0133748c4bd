"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers and dealt into blocks of rows. In a block,
slice (d, b) is the bitmap of rows whose d-th value has bit b. A query's scores
are sums of slices: each signed binary digit of each weight adds the slices of
its dimension at a shift, by full adders on whole bitmaps. A negative digit adds
the complements, which differs by a constant. The result is a bit-sliced score, and
the best rows are picked from its most significant slice downward; the rows
that tie at the boundary are resolved by their ids.

Each block's index is built once, packed, and kept in the shared folder. The
queries are a stated set that grows with the table, so both sides are dealt
into blocks and every query block meets every index once, by their numbers.
Nothing is broadcast. A task holds one index and one block of queries. A block
has at most BLOCK_VALUES components on average, so its memory doesn't hang on
the number of dimensions.

Defined results: vectors that are null, or hold a null or non-finite component,
take no part. Components may be of any magnitude: sums are as wide as they need
be, and a score among a query's best that a long can't hold raises an error.
Shorter vectors count as padded with zeros; an empty vector scores 0. Rows that
share a query's id are all its own; if several of them ask, what they find is
ranked together. Without candidates a query has no rows, and an empty table
gives none. Rows without an id take no part. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ._base import checkpointed, map_arrow

#: Components in an index block; queries of a query block, at least and at most; tasks wanted.
BLOCK_VALUES, BLOCK_QUERIES, MOST_QUERIES, TASKS = 1 << 22, 256, 4096, 64


def takes_part(vector: Column) -> Column:
    """Whether a vector is whole and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vectors: pa.Array, scale: int, dims: int) -> np.ndarray:
    """floor(scale * x) of each component, padded with zeros; Python integers where 63 bits don't hold them."""
    size = np.diff(vectors.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    x = vectors.flatten().to_numpy()
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    wide = np.flatnonzero(~(np.abs(scaled) < 2.0**62))
    out = np.zeros((len(size), dims), object if len(wide) else np.int64)
    scaled[wide] = 0
    out[row, place] = scaled.astype(np.int64)
    for i in wide.tolist():  # so large a float is a whole number
        out[row[i], place[i]] = int(x[i]) * scale
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    short = -bits.shape[-1] % 64
    padded = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, short)])
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


class BitSlicedIndex:
    """Bit slices of the rows of one block, sorted by id."""

    def __init__(self, ids: np.ndarray, low: list[int], slices: np.ndarray):
        """low: the least value of each dimension; slices: words of (dimension, bit)."""
        self.ids, self.low, self.slices = ids, low, slices
        self.width = slices.shape[1]
        self.all = _pack(np.ones((1, len(ids)), bool))[0]

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> BitSlicedIndex:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], values[order]
        low, high = values.min(0).tolist(), values.max(0).tolist()
        width = max([1, *((h - l).bit_length() for h, l in zip(high, low, strict=True))])
        slices = np.zeros((len(low), width, -(-len(ids) // 64)), np.uint64)
        for d, least in enumerate(low):  # one dimension at a time: what is unpacked stays small
            shifted = values[:, d] - least if high[d] - least < 1 << 62 else values[:, d].astype(object) - least
            for b in range((high[d] - least).bit_length()):
                slices[d, b] = _pack(((shifted >> b) & 1).astype(bool)[None])[0]
        return cls(ids, low, slices)

    def packed(self) -> tuple[bytes, str, int, bytes]:
        """ids, least values, width and slices, as columns of a row."""
        return self.ids.tobytes(), " ".join(map(str, self.low)), self.width, self.slices.tobytes()

    @classmethod
    def unpacked(cls, ids: bytes, low: str, width: int, slices: bytes) -> BitSlicedIndex:
        rows, least = np.frombuffer(ids, np.int64), [int(x) for x in low.split()]
        return cls(rows, least, np.frombuffer(slices, np.uint64).reshape(len(least), width, -1))

    def scores(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of every row's score, least significant first, and what to add to them."""
        columns: list[list[np.ndarray]] = []
        top = (1 << self.width) - 1
        base = sum(w * x for w, x in zip(weights, self.low, strict=False))
        for d, weight in enumerate(weights[: len(self.low)]):
            j = 0
            while weight:
                if weight & 1:
                    digit = 2 - (weight & 3)  # 1 or -1: no two neighbouring digits, so few slices
                    weight -= digit
                    slices = self.slices[d] if digit > 0 else ~self.slices[d] & self.all
                    base -= (top << j) if digit < 0 else 0
                    while len(columns) < j + self.width:
                        columns.append([])
                    for b in range(self.width):
                        columns[j + b].append(slices[b])
                weight >>= 1
                j += 1
        sums: list[np.ndarray] = []
        at = 0
        while at < len(columns):
            column = columns[at]
            if at + 1 == len(columns) and len(column) > 1:
                columns.append([])
            while len(column) > 2:  # a full adder: three bitmaps become a sum and a carry
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                column.append(half ^ z)
                columns[at + 1].append((x & y) | (half & z))
                column.insert(0, column.pop())
            if len(column) == 2:
                x, y = column
                column[:] = [x ^ y]
                columns[at + 1].append(x & y)
            sums.append(column[0] if column else np.zeros_like(self.all))
            at += 1
        return sums, base

    def top(self, query_id: int, weights: list[int], k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows, ties to the smaller id, without the query's own."""
        sums, base = self.scores(weights)
        open_ = self.all.copy()
        for own in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            open_[own >> 6] &= ~np.uint64(1 << (own & 63))
        sure = np.zeros_like(open_)
        left = k
        for bits in reversed(sums):
            high = open_ & bits
            n = int(np.bitwise_count(high).sum())
            if n > left:
                open_ = high
            else:
                sure |= high
                left -= n
                open_ = open_ & ~bits
            if not left:
                break
        rows = self._rows(sure)
        if left:  # all that is still open has one score: the boundary
            rows = np.concatenate([rows, self._rows(open_)[:left]])
        scores = [base] * len(rows)  # Python's integers: sums may be wide
        for b, bits in enumerate(sums):
            set_ = (bits[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            scores = [s + (int(x) << b) for s, x in zip(scores, set_.tolist(), strict=True)]
        return [(i, -s) for s, i in sorted(zip([-s for s in scores], self.ids[rows].tolist(), strict=True))]

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def build_indexes(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(block, ids, low, width, slices): the packed index of each block of rows(vec_id, v, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, values = None, [], []
        for batch in batches:
            block = batch.column(2).to_numpy()
            edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for first, last in zip(edges, edges[1:], strict=False):
                if last == first:
                    continue
                if block[first] != at and ids:
                    yield packed(at, ids, values)
                    ids, values = [], []
                at = block[first]
                ids.append(batch.column(0).to_numpy()[first:last])
                values.append(quantised(batch.column(1).slice(first, last - first), scale, dims))
        if ids:
            yield packed(at, ids, values)

    def packed(at: int, ids: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        index = BitSlicedIndex.of(np.concatenate(ids), np.concatenate(values))
        columns = [pa.array([int(at)], pa.int32()), *(pa.array([x]) for x in index.packed())]
        columns[3] = columns[3].cast(pa.int32())
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "low", "width", "slices"])

    placed = rows.select("vec_id", "v", "block").repartition("block").sortWithinPartitions("block")
    return map_arrow(placed, run, "block int, ids binary, low string, width int, slices binary")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row.

    ``is_query`` is a condition on the id column.
    """
    ship(vectors.sparkSession)
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    rows = rows.where(takes_part(F.col("v")))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("asks").alias("asks"), F.max(F.size("v")).alias("dims")).first()
    dims = max(1, n["dims"] or 0)
    # Few row blocks are met by many small query blocks, many by few large ones:
    # tasks enough for a cluster, and no more copies of an index than that takes.
    n_rows = -(-n["rows"] * dims // BLOCK_VALUES) or 1
    n_queries = max(-(-n["asks"] // MOST_QUERIES), min(-(-n["asks"] // BLOCK_QUERIES), -(-TASKS // n_rows))) or 1
    hash_ = F.xxhash64("vec_id", "v")
    indexes = checkpointed(build_indexes(rows.withColumn("block", F.pmod(hash_, F.lit(n_rows)).cast("int")), dims, scale))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ids", "binary"), ("low", "string"), ("width", "int"), ("slices", "binary"))]
    held = indexes.select(
        F.lit(None).cast("long").alias("vec_id"),
        F.lit(None).cast("array<double>").alias("v"),
        "block",
        F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("group"),
        "ids",
        "low",
        "width",
        "slices",
    )
    asked = rows.where("asks").select(
        "vec_id",
        "v",
        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("block"),
        F.pmod(hash_, F.lit(n_queries)).cast("int").alias("group"),
        *none,
    )

    def search(part: pa.Table) -> pa.Table:
        index, queries = None, []
        for batch in part.to_batches():
            is_index = batch.column(4).is_valid()
            for row in batch.filter(is_index).to_pylist():
                index = BitSlicedIndex.unpacked(row["ids"], row["low"], row["width"], row["slices"])
            queries.append(batch.filter(batch.column(4).is_null()))
        found = []
        for batch in queries if index else []:
            weights = quantised(batch.column(1), scale, dims).tolist()
            for q, w in zip(batch.column(0).to_pylist(), weights, strict=True):
                found += [(q, i, s) for i, s in index.top(q, w, k)]
        if any(not -(1 << 63) <= f[2] < 1 << 63 for f in found):
            raise OverflowError("the score of one of the best rows is beyond a long")
        names = ["query_id", "vec_id", "score"]
        return pa.table({name: pa.array([f[j] for f in found], pa.int64()) for j, name in enumerate(names)})

    found = held.unionByName(asked).groupBy("block", "group").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
