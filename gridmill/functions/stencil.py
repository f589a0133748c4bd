"""The 3x3 stencil of quadratic B-splines."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column

OFFSETS = (-1, 0, 1)
STENCIL = tuple(product(OFFSETS, OFFSETS))


def weight(f: Column, d: int) -> Column:
    """Weight of the neighbour at offset d for local coordinate f."""
    if d == 0:
        return 0.75 - f * f
    reach = 0.5 + d * f
    return 0.5 * reach * reach


def weight2(fx: Column, fy: Column, di: int, dj: int) -> Column:
    return weight(fx, di) * weight(fy, dj)
