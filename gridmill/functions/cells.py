"""Cells: positions, packed codes, path and region codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(x: Column, h: float) -> Column:
    """Index of the nearest node; halves go up."""
    return F.floor(x / h + 0.5).cast("int")


def encode(df: DataFrame, h: float, x: str = "x", y: str = "y") -> DataFrame:
    """Replace a position by its cell (ci, cj) and local coordinates (fx, fy) in [-0.5, 0.5]."""
    placed = df.withColumns({"ci": cell_of(F.col(x), h), "cj": cell_of(F.col(y), h)})
    return placed.withColumns({"fx": F.col(x) / h - F.col("ci"), "fy": F.col(y) / h - F.col("cj")}).drop(x, y)


def decode(df: DataFrame, h: float) -> DataFrame:
    """Add the position (x, y) of cell and local coordinates."""
    return df.withColumns({"x": (F.col("fx") + F.col("ci")) * h, "y": (F.col("fy") + F.col("cj")) * h})


def packed(i: Column, j: Column) -> Column:
    return F.shiftleft(j.cast("long"), 16).bitwiseOR(i.cast("long"))


def unpacked(code: Column) -> tuple[Column, Column]:
    return code.bitwiseAND(0xFFFF).cast("int"), F.shiftright(code, 16).cast("int")


def linear(i: Column, j: Column, grid_y: int) -> Column:
    """x-major cell number."""
    return i.cast("long") * grid_y + j


# Bits of a stored flag word.
GRAIN_MASK, CRUSHED, DISABLED, WEAKENED = 0xFFFF, 0x10000, 0x20000, 0x40000


def flags(word: Column) -> dict[str, Column]:
    """Typed columns of a stored flag word."""
    return {
        "grain": word.bitwiseAND(GRAIN_MASK).cast("int"),
        "crushed": word.bitwiseAND(CRUSHED) != 0,
        "disabled": word.bitwiseAND(DISABLED) != 0,
        "weakened": word.bitwiseAND(WEAKENED) != 0,
    }


# Path codes from 1000 are interiors; a status of 100 is the modelled region.
INTERIOR, MODELLED = 1000, 100


def status_of(path_index: Column) -> Column:
    """Status byte of a path index: boundary k gives k + 1, interior k gives 100 + k, outside 0."""
    return F.when(path_index < INTERIOR, path_index + 1).otherwise(path_index - (INTERIOR - MODELLED))


def region_of(status: Column) -> Column:
    """Region of a status byte: boundary and interior of a path share one."""
    return F.when(status >= MODELLED, status - (MODELLED - 1)).otherwise(status)


def at_rim(i: Column, j: Column, gx: int, gy: int) -> Column:
    return (i <= 1) | (j <= 1) | (i >= gx - 2) | (j >= gy - 2)


def window(df: DataFrame, ox: int, oy: int, gx: int, gy: int) -> DataFrame:
    """The rows of an image inside a window, with cell indices (i, j) from its corner."""
    inside = F.col("x").between(ox, ox + gx - 1) & F.col("y").between(oy, oy + gy - 1)
    return df.where(inside).withColumns({"i": F.col("x") - ox, "j": F.col("y") - oy}).drop("x", "y")
