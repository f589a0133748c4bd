"""Whole fields: extremes, quantisation, diffusion, mesh averages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..shipping import ship

#: Bits of a quantised value; a narrower range than this is constant.
BITS, CONSTANT = 12, 1e-9
#: Cells along a tile's side, and steps of diffusion for each exchange of its surroundings.
TILE, HALO = 256, 16


def extremes(df: DataFrame, names: list[str]) -> DataFrame:
    """(field, low, high) of each named column, in one pass."""
    ends = df.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)])
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"min_{n}").alias("low"), F.col(f"max_{n}").alias("high")) for n in names])
    return ends.select(F.inline(rows))


def quantise(df: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """The field as integers of 0 to 2^bits - 1, with its range (low, high) beside it.

    A constant field gives 0.
    """
    ends = df.agg(F.min(name).alias("low"), F.max(name).alias("high"))
    ranged = df.join(F.broadcast(ends))  # an aggregate without keys: one row
    span, top = F.col("high") - F.col("low"), (1 << bits) - 1
    level = F.when(span < CONSTANT, 0.0).otherwise(F.round(F.try_divide((F.col(name) - F.col("low")) * top, span)))
    return ranged.withColumn(name, level.cast("int"))


def quantise_all(df: DataFrame, names: list[str], bits: int = BITS) -> DataFrame:
    """``quantise`` of several fields over one pass for their ranges, which are low_<name> and high_<name>."""
    ends = df.agg(*[f(n).alias(f"{e}_{n}") for n in names for e, f in (("low", F.min), ("high", F.max))])
    ranged, top = df.join(F.broadcast(ends)), (1 << bits) - 1  # an aggregate without keys: one row

    def level(n: str) -> Column:
        span = F.col(f"high_{n}") - F.col(f"low_{n}")
        return F.when(span < CONSTANT, 0.0).otherwise(F.round(F.try_divide((F.col(n) - F.col(f"low_{n}")) * top, span))).cast("int")

    return ranged.withColumns({n: level(n) for n in names})


def restore(df: DataFrame, name: str, bits: int = BITS) -> DataFrame:
    """Undo ``quantise``; a constant field is its low end."""
    span, top = F.col("high") - F.col("low"), (1 << bits) - 1
    value = F.when(span < CONSTANT, F.col("low")).otherwise(F.col("low") + F.col(name) * span / top)
    return df.withColumn(name, value).drop("low", "high")


def diffuse(field: DataFrame, iterations: int, alpha: float, width: int, height: int, names: tuple[str, ...] = ("vx", "vy")) -> DataFrame:
    """Explicit diffusion steps on field(x, y, active, names…).

    v becomes v + alpha (sum of its four neighbours - 4 v) on active cells.
    Inactive cells become 0 and count as 0 for others; beyond the image's edge a
    cell is its own neighbour. Without steps nothing changes. A step is one
    aggregation: each cell hands its value to its neighbours and to itself.
    """
    now = field
    for _ in range(iterations):
        given = []
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            to_x, to_y = F.col("x") + dx, F.col("y") + dy
            inside = to_x.between(0, width - 1) & to_y.between(0, height - 1)
            given.append(
                F.struct(
                    F.when(inside, to_x).otherwise(F.col("x")).alias("x"),
                    F.when(inside, to_y).otherwise(F.col("y")).alias("y"),
                    F.lit(False).alias("own"),
                    F.col("active"),
                    *[F.when(F.col("active"), F.col(n)).otherwise(0.0).alias(n) for n in names],
                )
            )
        own = F.struct("x", "y", F.lit(True).alias("own"), "active", *names)
        handed = now.select(F.inline(F.array(own, *given)))

        def value(n: str) -> Column:
            return F.max(F.when(F.col("own"), F.col(n)))

        sums = handed.groupBy("x", "y").agg(
            F.max(F.when(F.col("own"), F.col("active"))).alias("active"),
            *[value(n).alias(n) for n in names],
            *[F.sum(F.when(~F.col("own"), F.col(n))).alias(f"near_{n}") for n in names],
        )
        moved = [
            F.when(F.col("active"), F.col(n) + alpha * (F.coalesce(f"near_{n}", F.lit(0.0)) - 4 * F.col(n))).otherwise(0.0).alias(n)
            for n in names
        ]
        now = sums.where(F.col("active").isNotNull()).select("x", "y", "active", *moved)
    return now


def diffuse_long(field: DataFrame, iterations: int, alpha: float, width: int, height: int, every: int = 8) -> DataFrame:
    """``diffuse`` for many iterations, with the lineage cut every few of them."""
    now = field
    while iterations > 0:
        now = cut(diffuse(now, min(every, iterations), alpha, width, height))
        iterations -= every
    return now


def diffuse_tiled(
    field: DataFrame, iterations: int, alpha: float, width: int, height: int, names: tuple[str, ...] = ("vx", "vy"), tile: int = TILE, halo: int = HALO
) -> DataFrame:
    """``diffuse`` with ``halo`` steps for each exchange: a task gets a tile with so many cells around it.

    What is missing beyond them spoils one more ring of cells a step, and so
    never reaches the tile. A task holds (tile + 2 halo)^2 cells.
    """
    now = field.select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "active", *[F.col(n).cast("double").alias(n) for n in names])
    ship(field.sparkSession)
    while iterations > 0:
        steps = min(halo, iterations)
        iterations -= steps
        now = _exchanged(now, steps, alpha, width, height, names, tile)
        if iterations > 0:
            now = cut(now)
    return now


def _exchanged(now: DataFrame, steps: int, alpha: float, width: int, height: int, names: tuple[str, ...], tile: int) -> DataFrame:
    """So many steps after one exchange of cells between tiles."""

    def spread(c: str, end: int) -> Column:
        low, high = F.floor((F.col(c) - steps) / tile), F.floor((F.col(c) + steps) / tile)
        return F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, F.lit((end - 1) // tile))))

    def run(key: tuple[pa.Scalar, ...], cells: pa.Table) -> pa.Table:
        return _diffused(cells, key[0].as_py(), key[1].as_py(), steps, alpha, width, height, names, tile)

    return now.withColumn("tx", spread("x", width)).withColumn("ty", spread("y", height)).groupBy("tx", "ty").applyInArrow(run, now.schema)


def _diffused(cells: pa.Table, tx: int, ty: int, steps: int, alpha: float, width: int, height: int, names: tuple[str, ...], tile: int) -> pa.Table:
    """The tile's own cells after so many steps."""
    low_x, low_y = max(tx * tile - steps, 0), max(ty * tile - steps, 0)
    shape = min((tx + 1) * tile + steps, width) - low_x, min((ty + 1) * tile + steps, height) - low_y
    x, y = cells["x"].to_numpy(), cells["y"].to_numpy()
    at = x - low_x, y - low_y
    active = np.zeros(shape, bool)
    active[at] = cells["active"].fill_null(False).to_numpy()
    own = np.flatnonzero((x // tile == tx) & (y // tile == ty))
    out = cells.select(["x", "y", "active"]).take(pa.array(own))
    for n in names:
        v = np.zeros(shape)
        v[at] = cells[n].to_numpy()
        v[~active] = 0
        for _ in range(steps):
            wide = np.pad(v, 1, mode="edge")
            near = wide[2:, 1:-1] + wide[:-2, 1:-1] + wide[1:-1, 2:] + wide[1:-1, :-2]
            v = np.where(active, v + alpha * (near - 4 * v), 0.0)
        out = out.append_column(n, pa.array(v[at][own]))
    return out


def with_norm(flow: DataFrame) -> DataFrame:
    return flow.withColumn("norm", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def require_nonzero(df: DataFrame, name: str) -> DataFrame:
    """One row with the number of non-zero values; raises if there is none."""
    n = F.count_if(F.col(name) != 0)
    return df.agg(F.when(n == 0, F.raise_error(F.lit(f"{name} is zero everywhere"))).otherwise(n).alias("nonzero"))


def transform_mesh(nodes: DataFrame, scale: float, ox: float, oy: float) -> DataFrame:
    """Scale, then translate the nodes of a mesh."""
    return nodes.withColumns({"x": F.col("x") * scale + ox, "y": F.col("y") * scale + oy})


def cell_to_point(cells: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(node_id, names…): mean over the cells(cell_id, nodes) that use a node."""
    used = cells.select("cell_id", F.explode("nodes").alias("node_id")).join(values, "cell_id")
    return used.groupBy("node_id").agg(*[F.avg(n).alias(n) for n in names])


def probe(triangles: DataFrame, width: int, height: int, names: list[str]) -> DataFrame:
    """(x, y, names…): values of triangles at pixel centres, by barycentric interpolation.

    triangles(cell_id, ax, ay, bx, by, cx, cy, and a_n, b_n, c_n for each name n).
    Each triangle lists the pixels of its own box, so no pixel is compared with
    a triangle far away; of several covering a pixel the lowest cell_id counts
    (of its triangles the one with the lowest values).
    """
    x0, x1 = F.ceil(F.least("ax", "bx", "cx")), F.floor(F.greatest("ax", "bx", "cx"))
    y0, y1 = F.ceil(F.least("ay", "by", "cy")), F.floor(F.greatest("ay", "by", "cy"))
    zero = F.lit(0).cast("long")
    boxed = triangles.withColumns(
        {"lx": F.greatest(x0, zero), "hx": F.least(x1, F.lit(width - 1)), "ly": F.greatest(y0, zero), "hy": F.least(y1, F.lit(height - 1))}
    ).where("lx <= hx AND ly <= hy")
    pixels = boxed.withColumn("y", F.explode(F.sequence("ly", "hy"))).withColumn("x", F.explode(F.sequence("lx", "hx")))
    inside = pixels.where(_in_triangle()).select(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "cell_id")
    lowest = inside.groupBy("x", "y").agg(F.min("cell_id").alias("cell_id"))  # a number, so no pixel's list of triangles is sorted
    u, v = _barycentric()
    value = [(u * F.col(f"a_{n}") + v * F.col(f"b_{n}") + (1 - u - v) * F.col(f"c_{n}")).alias(n) for n in names]
    picked = lowest.join(triangles, "cell_id", "left").groupBy("x", "y").agg(F.min(F.when(_in_triangle(), F.struct(*value))).alias("s"))
    return picked.select("x", "y", "s.*")


def _barycentric() -> tuple[Column, Column]:
    """Weights of the corners a and b at (x, y)."""
    det = (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("ay") - F.col("cy"))
    u = F.try_divide((F.col("by") - F.col("cy")) * (F.col("x") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("y") - F.col("cy")), det)
    v = F.try_divide((F.col("cy") - F.col("ay")) * (F.col("x") - F.col("cx")) + (F.col("ax") - F.col("cx")) * (F.col("y") - F.col("cy")), det)
    return u, v


def _in_triangle() -> Column:
    u, v = _barycentric()
    return (u >= 0) & (v >= 0) & (1 - u - v >= 0)
