"""Particles to grid nodes: sums over the 3x3 stencil.

A particle's contribution to its nine nodes is a product of weights of its own
local coordinates and a node offset. Contributions are therefore first summed
per cell, nine sums a quantity, within the map-side aggregation; only the few
cells, not the particles, are then spread to nodes. Nothing is exploded ninefold
before a shuffle, and the second aggregation is over cells.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MODELLED
from ..functions.color import WATER, clamp
from ..functions.material import kirchhoff, matrix
from ..functions.stencil import STENCIL, weight2
from ..params import SimParams

#: A quantity: its unweighted value for a node offset (di, dj).
Quantity = Callable[[int, int], Column]


def spread(particles: DataFrame, quantities: Mapping[str, Quantity]) -> DataFrame:
    """(i, j, one sum per quantity) of the nodes around particles(ci, cj, fx, fy, …)."""
    fx, fy = F.col("fx"), F.col("fy")
    per_cell = particles.groupBy("ci", "cj").agg(
        *[
            F.sum(weight2(fx, fy, di, dj) * value(di, dj)).alias(f"{name}_{k}")
            for name, value in quantities.items()
            for k, (di, dj) in enumerate(STENCIL)
        ]
    )
    nodes = per_cell.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        (F.col("ci") + di).alias("i"),
                        (F.col("cj") + dj).alias("j"),
                        *[F.col(f"{name}_{k}").alias(name) for name in quantities],
                    )
                    for k, (di, dj) in enumerate(STENCIL)
                ]
            )
        )
    )
    return nodes.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in quantities])


def plain(column: Column) -> Quantity:
    return lambda di, dj: column


def enabled(particles: DataFrame) -> DataFrame:
    return particles.where(~F.col("disabled"))


def particle_mass(particles: DataFrame, prm: SimParams) -> DataFrame:
    """Mass of every touched node."""
    return spread(enabled(particles), {"mass": plain(prm.particle_mass * F.col("thickness"))})


def particles_to_grid(particles: DataFrame, prm: SimParams) -> DataFrame:
    """Mass and momentum of every touched node, stress included."""
    m = prm.particle_mass * F.col("thickness")
    pull = prm.dt_vol_dp_inv * F.col("jp_inv") * F.col("thickness")
    tau, b, h = kirchhoff(matrix("fe"), prm), matrix("bp"), prm.cellsize

    def momentum(v: Column, along_x: Column, along_y: Column) -> Quantity:
        return lambda di, dj: m * v + along_x * ((di - F.col("fx")) * h) + along_y * ((dj - F.col("fy")) * h)

    return spread(
        enabled(particles),
        {
            "mass": plain(m),
            "px": momentum(F.col("vx"), m * b.a - pull * tau.a, m * b.b - pull * tau.b),
            "py": momentum(F.col("vy"), m * b.c - pull * tau.c, m * b.d - pull * tau.d),
        },
    )


def rasterise(particles: DataFrame, prm: SimParams) -> DataFrame:
    """Frame fields of every touched node: density, and weighted means."""
    m = prm.particle_mass * F.col("thickness")
    sums = spread(
        enabled(particles),
        {
            "density": plain(F.lit(1.0)),
            "m": plain(m),
            "mvx": plain(m * F.col("vx")),
            "mvy": plain(m * F.col("vy")),
            **{f"s_{c}": plain(F.col(c).cast("double")) for c in ("jp_inv", "p", "q", "r", "g", "b")},
        },
    )

    def mean(name: str) -> Column:
        return F.try_divide(F.col(f"s_{name}"), F.col("density"))

    return sums.select(
        "i",
        "j",
        "density",
        F.try_divide("mvx", "m").alias("vx"),
        F.try_divide("mvy", "m").alias("vy"),
        (mean("jp_inv") - 1).alias("jpinv"),
        *[mean(c).alias(c) for c in ("p", "q", "r", "g", "b")],
    )


def masked(frame: DataFrame, cells: DataFrame) -> DataFrame:
    """Mask thin cells, zero what isn't modelled, and blend colours with water by density, which stays."""
    full = frame.join(cells.select("i", "j", "status"), ["i", "j"], "left")
    mask = (F.col("density") > 0.1).cast("int")
    shown = (mask == 1) & (F.coalesce("status", F.lit(0)) == MODELLED)
    alpha = clamp(F.col("density"))
    blended = [
        F.floor(alpha * F.floor(clamp(F.col(c), 0.0, 255.0)) + (1 - alpha) * w).cast("int").alias(c)
        for c, w in zip("rgb", WATER, strict=True)
    ]
    fields = [F.when(shown, F.col(c)).otherwise(0.0).alias(c) for c in ("jpinv", "p", "q", "vx", "vy")]
    return full.select("i", "j", "density", mask.alias("mask"), *fields, *blended)


def points_per_cell(particles: DataFrame, wrap: bool = False) -> DataFrame:
    """(ci, cj, n); ``wrap`` counts as a byte does."""
    counts = particles.groupBy("ci", "cj").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("n", F.col("n") % 256) if wrap else counts


def fill_histogram(particles: DataFrame, gx: int, gy: int) -> DataFrame:
    """(n, cells): how many cells hold n points, empty cells of the grid included."""
    counts = points_per_cell(particles).where(F.col("ci").between(0, gx - 1) & F.col("cj").between(0, gy - 1))
    filled = counts.groupBy("n").agg(F.count(F.lit(1)).alias("cells"))
    empty = filled.agg((F.lit(gx * gy) - F.coalesce(F.sum("cells"), F.lit(0))).alias("cells"))
    return filled.unionByName(empty.select(F.lit(0).cast("long").alias("n"), "cells"))
