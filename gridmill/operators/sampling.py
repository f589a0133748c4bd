"""Blue-noise points, thrown tile by tile. They are made once per grid and stored."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import encode
from ..plans.lineage import cut
from ..shipping import ship

#: Points wanted in a cell, and tries around an active point.
POINTS_PER_CELL, ATTEMPTS = 5, 30
#: Radii in a tile's side; tiles that are filled together at most, and groups of them wanted at least.
TILE_RADII, TILES_TOGETHER, GROUPS = 64, 64, 48


def _hash(seed):
    """The stateless hash of ``functions.naming`` on a Python integer, or on an array of them."""
    i = (np.atleast_1d(seed).astype(np.int64) & 0xFFFFFFFF).astype(np.uint32) ^ np.uint32(12345391)
    i = i * np.uint32(2654435769)
    i ^= (i << np.uint32(6)) ^ (i >> np.uint32(26))
    i = i * np.uint32(2654435769)
    i = i + ((i << np.uint32(5)) ^ (i >> np.uint32(12)))
    return i if np.ndim(seed) else int(i[0])


def poisson_disk(
    width: float, height: float, radius: float, seed: int = 0, attempts: int = ATTEMPTS, held: np.ndarray | None = None
) -> np.ndarray:
    """Points of a box no two of which are nearer than ``radius``, until no more fit around any.

    ``held``: points that there are already, some of them beyond the box; new
    ones keep their distance from these and grow from them as well.
    """
    return poisson_boxes([(width, height, seed, held)], radius, attempts)[0]


def poisson_boxes(boxes: list[tuple[float, float, int, np.ndarray | None]], radius: float, attempts: int = ATTEMPTS) -> list[np.ndarray]:
    """``poisson_disk`` of boxes (width, height, seed, held) that don't know of each other, a step of all of them at a time."""
    side = radius / math.sqrt(2)
    n = len(boxes)
    width, height = (np.array([b[k] for b in boxes], float) for k in (0, 1))
    state = np.array([b[2] for b in boxes], np.int64)
    nx, ny = (math.ceil(float(c.max()) / side) + 6 for c in (width, height))  # three cells more at every side
    rings = [np.array([i * ny + j for i in range(-2, 3) for j in range(-2, 3) if max(abs(i), abs(j)) == k]) for k in range(3)]
    cell = np.full((2, n * nx * ny), np.inf)  # the point in each cell
    known = np.array([0 if b[3] is None else len(b[3]) for b in boxes])
    most = int(known.max()) + nx * ny
    points, active = np.empty((n, most, 2)), np.empty((n, most), np.int64)
    count = np.zeros(n, np.int64)

    def at(k, x, y) -> np.ndarray:
        i, j = (np.floor_divide(c, side).astype(np.int64) + 3 for c in (x, y))
        return np.where((i >= 0) & (i < nx) & (j >= 0) & (j < ny), (k * nx + i) * ny + j, -1)

    for k, (w, h, _, held) in enumerate(boxes):
        if not known[k]:
            held = _hash(state[k] + np.arange(2))[None] / 0xFFFFFFFF * (w, h)
            state[k] += 2
        count[k] = len(held)
        points[k, : count[k]], active[k, : count[k]] = held, np.arange(count[k])
        where = at(k, *held.T)
        cell[:, where[where >= 0]] = held[where >= 0].T
    left, live = count.copy(), np.arange(n)
    draws = np.arange(2 * attempts + 1)
    while len(live):
        drawn = _hash(state[live, None] + draws) / 0xFFFFFFFF
        pick = (drawn[:, 0] * left[live]).astype(np.int64) % left[live]
        px, py = points[live, active[live, pick]].T
        far, angle = radius * (1 + drawn[:, 1::2]), 2 * math.pi * drawn[:, 2::2]
        x, y = px[:, None] + far * np.cos(angle), py[:, None] + far * np.sin(angle)
        row, tried = np.nonzero((x >= 0) & (x < width[live, None]) & (y >= 0) & (y < height[live, None]))
        x, y = x[row, tried], y[row, tried]
        own = at(live[row], x, y)
        for ring in rings:  # most are too near to a point of their own cell or one beside it
            near = own[:, None] + ring
            dx, dy = cell[0].take(near), cell[1].take(near)
            dx -= x[:, None]
            dy -= y[:, None]
            dx *= dx
            dy *= dy
            dx += dy
            free = np.flatnonzero(dx.min(axis=1) >= radius * radius)
            own, x, y, row, tried = own[free], x[free], y[free], row[free], tried[free]
        first = np.diff(row, prepend=-1) > 0  # of each box the first try that fits
        row, tried = row[first], tried[first]
        found = live[row]
        # The library's functions of a single number: the same on every machine.
        x = np.array([p + r * math.cos(o) for p, r, o in zip(px[row].tolist(), far[row, tried].tolist(), angle[row, tried].tolist(), strict=True)])
        y = np.array([p + r * math.sin(o) for p, r, o in zip(py[row].tolist(), far[row, tried].tolist(), angle[row, tried].tolist(), strict=True)])
        points[found, count[found], 0], points[found, count[found], 1] = x, y
        cell[:, at(found, x, y)] = x, y
        active[found, left[found]] = count[found]
        count[found] += 1
        left[found] += 1
        state[found] += 2 * tried + 3
        none = np.ones(len(live), bool)
        none[row] = False
        ended = live[none]
        active[ended, pick[none]] = active[ended, left[ended] - 1]
        left[ended] -= 1
        state[ended] += len(draws)
        if len(ended) and not left[ended].all():
            live = live[left[live] > 0]
    return [points[k, known[k] : count[k]].copy() for k in range(n)]


def poisson_tiles(spark: SparkSession, width: float, height: float, radius: float, seed: int = 0, side: int = TILE_RADII) -> DataFrame:
    """(x, y) as of ``poisson_disk``, made tile by tile.

    Tiles are of ``side`` radii. Every second one along either axis is filled
    at a time, four times in all, so no two that are filled at once touch. A
    task gets a few tiles with the points around them that there are already.
    """
    ship(spark)
    tile = side * radius
    nx, ny = max(1, math.ceil(width / tile)), max(1, math.ceil(height / tile))
    tiles = spark.range(nx * ny).select((F.col("id") % nx).alias("tx"), F.floor(F.col("id") / nx).alias("ty"))
    at_once = math.ceil(nx / 2) * math.ceil(ny / 2)
    together = min(TILES_TOGETHER, math.ceil(at_once / GROUPS))
    groups = math.ceil(at_once / together)
    group = F.floor((F.floor(F.col("ty") / 2) * math.ceil(nx / 2) + F.floor(F.col("tx") / 2)) / together)

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        boxes, lows = [], []
        for (tx, ty), own in part.groupby(["tx", "ty"]):
            low = np.array([tx * tile, ty * tile])
            there = own.dropna()[["x", "y"]].sort_values(["x", "y"]).to_numpy()
            boxes.append((min(tile, width - low[0]), min(tile, height - low[1]), int(seed + (ty * nx + tx) * 7919), there - low if len(there) else None))
            lows.append(low)
        return pd.DataFrame(np.concatenate([found + low for found, low in zip(poisson_boxes(boxes, radius), lows, strict=True)]), columns=["x", "y"])

    points = None
    for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)):
        rows = tiles.where((F.col("tx") % 2 == a) & (F.col("ty") % 2 == b)).select("tx", "ty", *[F.lit(None).cast("double").alias(c) for c in "xy"])
        if points is not None:
            own = [F.floor(F.col(c) / tile) for c in "xy"]
            around = [F.struct((own[0] + i).alias("tx"), (own[1] + j).alias("ty")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            near = points.select(F.inline(F.array(*around)), "x", "y").where((F.col("tx") % 2 == a) & (F.col("ty") % 2 == b))
            close = [(F.col(c) >= F.col(t) * tile - 2 * radius) & (F.col(c) <= (F.col(t) + 1) * tile + 2 * radius) for c, t in (("x", "tx"), ("y", "ty"))]
            rows = rows.unionByName(near.where(close[0] & close[1] & F.col("tx").between(0, nx - 1) & F.col("ty").between(0, ny - 1)))
        # A number of partitions that is named isn't made smaller, however few bytes the tiles have.
        new = cut(rows.withColumn("group", group).repartition(groups, "group").groupBy("group").applyInPandas(fill, "x double, y double"))
        points = new if points is None else points.unionByName(new)
    return points


def sample_grid(spark: SparkSession, gx: int, gy: int, per_cell: int = POINTS_PER_CELL) -> DataFrame:
    """(ci, cj, fx, fy) of points over a grid, ``per_cell`` of them a cell on average, sorted by cell."""
    high = gy / gx
    points = poisson_tiles(spark, 1.0, high, math.sqrt(0.6 / (per_cell * gx * gx)))
    scale = math.sqrt(points.count() / (gx * gx) / (1.0005 * per_cell) / high)
    if scale < 1:
        raise ValueError("the sampling gave too few points")
    scaled = points.select(*[(F.col(c) * scale).alias(c) for c in "xy"]).where((F.col("x") < 1) & (F.col("y") < high))
    return encode(scaled, 1 / (gx - 1)).repartitionByRange("ci", "cj").sortWithinPartitions("ci", "cj")


def cached_points(spark: SparkSession, folder: str, gx: int, gy: int, per_cell: int = POINTS_PER_CELL) -> DataFrame:
    """Points of a grid from the cache, or made and put there."""
    path = f"{folder}/point_cache_{gx:05d}_{gy:05d}_{per_cell:03d}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        sample_grid(spark, gx, gy, per_cell).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def nearest_gap(points: DataFrame) -> DataFrame:
    """One row: the least distance between points(x, y) of a unit grid, found among neighbouring cells."""
    placed = points.select("x", "y", F.floor("x").alias("i"), F.floor("y").alias("j"), F.monotonically_increasing_id().alias("id"))
    near = placed.select(
        F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("id").alias("id2"),
        F.inline(F.array(*[F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])),
    )
    pairs = placed.join(near, ["i", "j"]).where("id < id2")
    return pairs.agg(F.min(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("gap"))
