"""Centroid clustering with partial-distance search, in integers.

Components become integers; centroids are exact floors of means. To find a
vector's nearest centroid, squared differences are summed over the dimensions of
highest variance first, a few at a time. The centroid that is nearest after the
first few is finished and gives the best distance so far; the others go on until
they are strictly beyond it, and only those that stay finish all dimensions.

Each round is one pass over the vectors: tasks sum up the members of each
centroid, and the sums of all tasks are added by Spark. What reaches the driver
and the tasks is the centroids, whose number and length are parameters.

Defined results: vectors that are null, hold null or non-finite components, or
haven't ``dimensions`` components take no part and get no row; a component
beyond LARGEST after scaling raises an error, as distances wouldn't fit a long.
Rows that share an id are vectors of their own; a null id counts as empty text
in the order of the seeds, in which equal ids are ordered by their vectors. With
fewer vectors than centroids there are as many centroids as vectors; without any
there are no rows. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpointed, map_arrow

#: Largest component after scaling.
LARGEST = 1 << 27
#: Dimensions that are summed before centroids are compared with the best, and vectors at once.
STRIDE, VECTORS_AT_ONCE = 8, 4096


@dataclass(frozen=True)
class Clustering:
    clusters: int = 16
    rounds: int = 3
    dimensions: int = 64
    scale: int = 64
    seed: int = 1


def integers(vectors: pa.Array, how: Clustering) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their integer components)."""
    vectors = vectors.cast(pa.list_(pa.float64()))
    usable = np.asarray(vectors.is_valid()) & (np.asarray(vectors.value_lengths().fill_null(-1)) == how.dimensions)
    rows = np.flatnonzero(usable)
    flat = vectors.take(pa.array(rows)).flatten()
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), how.dimensions)
    finite = np.isfinite(x).all(axis=1)
    rows, x = rows[finite], np.floor(x[finite] * how.scale)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return rows, x.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; of equals the smaller number."""
    x, centroids = x[:, order], centroids[:, order]
    n, k = len(x), len(centroids)

    def part(rows: np.ndarray, of: np.ndarray, dims: slice) -> np.ndarray:
        gap = x[rows, dims] - centroids[of, dims]
        return np.einsum("ij,ij->i", gap, gap)

    gap = x[:, None, :STRIDE] - centroids[None, :, :STRIDE]
    begun = np.einsum("ijk,ijk->ij", gap, gap)
    every = np.arange(n)
    first = begun.argmin(axis=1)
    rest = slice(STRIDE, None)
    best = begun[every, first] + part(every, first, rest)
    # The others, as pairs of vector and centroid, until they are beyond the best.
    open_ = (begun <= best[:, None]) & (np.arange(k)[None, :] != first[:, None])
    row, of = np.nonzero(open_)
    sums = begun[row, of]
    for at in range(STRIDE, x.shape[1], STRIDE):
        sums = sums + part(row, of, slice(at, at + STRIDE))
        stay = sums <= best[row]
        row, of, sums = row[stay], of[stay], sums[stay]
    # Survivors are whole distances; a vector's smallest (distance, number) counts.
    row, of, sums = np.concatenate([every, row]), np.concatenate([first, of]), np.concatenate([best, sums])
    at = np.lexsort((of, sums, row))
    at = at[np.unique(row[at], return_index=True)[1]]
    return of[at].astype(np.int32), sums[at]


def _batches(batches: Iterator[pa.RecordBatch], how: Clustering) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, VECTORS_AT_ONCE):
            some = batch.slice(at, VECTORS_AT_ONCE)
            rows, x = integers(some.column(1), how)
            if len(rows):
                yield some.column(0).take(pa.array(rows)), x


def _totals(vectors: DataFrame, per_task, how: Clustering) -> dict[tuple[int, int], tuple[int, int]]:
    """(group, dimension) to (sum, sum of squares), exact, added over all tasks; few groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for _, x in _batches(batches, how):
            for group, some in per_task(x):
                # Sums of a batch fit a long, those of a task may not.
                now = some.sum(axis=0).astype(object), (some.astype(object) ** 2).sum(axis=0) if np.abs(some).max() > 1 << 24 else (some * some).sum(axis=0).astype(object)
                old = sums.get(group)
                sums[group] = now if old is None else (old[0] + now[0], old[1] + now[1])
        rows = [(g, d, str(a[d]), str(b[d])) for g, (a, b) in sums.items() for d in range(len(a))]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = [pa.int32(), pa.int32(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["group", "dim", "total", "squares"])

    tasks = map_arrow(vectors, run, "group int, dim int, total string, squares string")
    added = tasks.groupBy("group", "dim").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "squares")])
    return {(r["group"], r["dim"]): (int(r["total"]), int(r["squares"])) for r in added.collect()}


def seeds(vectors: DataFrame, how: Clustering) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, how):
            hashes = [hashlib.sha256(f"{how.seed}:{'' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(x), pa.list_(pa.int64()))], ["hash", "x"])

    first = map_arrow(vectors, run, "hash string, x array<bigint>").orderBy("hash", "x").limit(how.clusters).collect()
    return np.array([r["x"] for r in first], np.int64).reshape(len(first), how.dimensions)


def variance_order(vectors: DataFrame, how: Clustering) -> tuple[np.ndarray, int]:
    """Dimensions from the highest variance on, and how many vectors there are."""
    found = _totals(vectors, lambda x: [(0, x), (1, np.ones_like(x[:, :1]))], how)
    n = found.get((1, 0), (0, 0))[0]
    spread = [n * found[0, d][1] - found[0, d][0] ** 2 if n else 0 for d in range(how.dimensions)]
    return np.array(sorted(range(how.dimensions), key=lambda d: (-spread[d], d))), n


def fit(vectors: DataFrame, how: Clustering) -> tuple[np.ndarray, np.ndarray]:
    """(centroids after all rounds, order of dimensions)."""
    centroids, (order, _) = seeds(vectors, how), variance_order(vectors, how)

    def members(x: np.ndarray, now: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        cluster, _ = nearest(x, now, order)
        for k in np.unique(cluster):
            some = x[cluster == k]
            yield int(k), np.hstack([some, np.ones_like(some[:, :1])])  # the last sum is the count

    for _ in range(how.rounds if len(centroids) else 0):
        found = _totals(vectors, lambda x, now=centroids: members(x, now), how)
        centroids = np.array(
            [[found[k, d][0] // found[k, how.dimensions][0] for d in range(how.dimensions)] if (k, 0) in found else c.tolist() for k, c in enumerate(centroids)], np.int64
        )
    return centroids, order


def assign(vectors: DataFrame, centroids: np.ndarray, order: np.ndarray, how: Clustering) -> DataFrame:
    """(id, cluster, distance) of every vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, how):
            cluster, distance = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(distance)], ["id", "cluster", "distance"])

    id_type = vectors.schema["id"].dataType.simpleString()
    return map_arrow(vectors, run, f"id {id_type}, cluster int, distance bigint")


def cluster_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", how: Clustering | None = None) -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    how = how or Clustering()
    vectors = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    centroids, order = fit(vectors, how)
    found = checkpointed(assign(vectors, centroids, order, how)) if len(centroids) else assign(vectors.limit(0), np.zeros((1, how.dimensions), np.int64), order, how)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}

    def by_cluster(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("cluster"))

    numbers = range(max(1, len(centroids)))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids] or [""]
    return found.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        by_cluster([sums.get(k, 0) for k in numbers]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        by_cluster(digests).alias("centroid_sha256"),
    )
