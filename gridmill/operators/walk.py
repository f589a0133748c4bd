"""Curves walked pixel by pixel, with steps that are halved until they touch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Fixed value: below this step a curve can't be walked.
LEAST_STEP = 1e-10
#: Segments that are walked side by side.
AT_ONCE = 4096

_COORDINATES = [f"{c}{k}" for c in "xy" for k in range(4)]


def _place(at: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Pixels of cubic segments at parameter t; coordinates are cut off towards 0."""
    s = 1 - t
    s2, t2 = s * s, t * t
    s3, t3 = s2 * s, t2 * t
    return np.stack([np.trunc(s3 * a + 3 * s2 * t * b + 3 * s * t2 * c + t3 * d) for a, b, c, d in (at[:4], at[4:])]).astype(np.int64)


def _walked(at: np.ndarray, last: np.ndarray, step: float) -> tuple[np.ndarray, ...]:
    """(segment, k, pixel, t) of what segments render: their start, and every pixel that is new and touches the one before."""
    n = at.shape[1]
    t, steps, count = np.zeros(n), np.full(n, step), np.ones(n, np.int64)
    pixel = last.copy()
    found = [(np.arange(n), np.zeros(n, np.int64), _place(at, t), t.copy())]
    open_ = np.arange(n)
    while len(open_):
        ahead = np.minimum(t[open_] + steps[open_], 1.0)
        there = _place(at[:, open_], ahead)
        gap = np.abs(there - pixel[:, open_]).max(axis=0)
        far = gap > 1
        steps[open_[far]] /= 2
        if (steps[open_] < LEAST_STEP).any():
            raise ValueError("a curve can't be walked: its step is too small")
        t[open_[~far]] = ahead[~far]
        new = gap == 1
        rows = open_[new]
        pixel[:, rows] = there[:, new]
        found.append((rows, count[rows], there[:, new], ahead[new]))
        count[rows] += 1
        open_ = open_[t[open_] < 1.0]
    return tuple(np.concatenate(x, axis=-1) for x in zip(*found, strict=True))


def walk(segments: DataFrame, width: int, height: int) -> DataFrame:
    """(path, seg, k, x, y, t): the pixels of cubic segments(path, seg, x0..x3, y0..y3) in the order in which they are rendered.

    A segment renders its start. Its step begins at one over the larger side of
    the canvas; it is halved while the next pixel doesn't touch the last one,
    and doesn't grow again within the segment. The last pixel is handed on from
    segment to segment of a path, whose ends must touch: a curve with a gap
    raises an error. Pixels beyond the canvas are listed as well.

    Segments follow one another, but a segment's last pixel is where its curve
    ends, so each is walked on its own.
    """
    end = F.struct(*[F.when(F.col(c) < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long").alias(c[0]) for c in ("x3", "y3")])
    start = F.struct(*[F.when(F.col(c) < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long").alias(c[0]) for c in ("x0", "y0")])
    last = F.coalesce(F.lag(end).over(Window.partitionBy("path").orderBy("seg")), start)
    rows = segments.select("path", "seg", *[F.col(c).cast("double").alias(c) for c in _COORDINATES], last.alias("last")).select("path", "seg", *_COORDINATES, "last.x", "last.y")
    step = 1.0 / max(width, height)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(first, AT_ONCE)
                at = np.stack([c.to_numpy() for c in some.columns[2:10]])
                which, k, pixel, t = _walked(at, np.stack([c.to_numpy() for c in some.columns[10:]]), step)
                order = np.lexsort((k, which))
                names = [c.take(pa.array(which[order])) for c in some.columns[:2]]
                columns = [*names, pa.array(k[order].astype(np.int32)), *[pa.array(p[order]) for p in pixel], pa.array(t[order])]
                yield pa.RecordBatch.from_arrays(columns, ["path", "seg", "k", "x", "y", "t"])

    ship(segments.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"path {kinds['path']}, seg {kinds['seg']}, k int, x long, y long, t double")
