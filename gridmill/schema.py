"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "short": T.ShortType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def _struct(text: str) -> T.StructType:
    """From "name type, …"; needs no session."""
    pairs = [column.split() for column in text.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PARTICLES = _struct(
    "pid long, ci int, cj int, fx double, fy double, vx double, vy double, "
    "fe00 double, fe01 double, fe10 double, fe11 double, bp00 double, bp01 double, bp10 double, bp11 double, "
    "jp_inv double, p double, q double, thickness double, crushed boolean, disabled boolean, grain int"
)
GRID = _struct("i int, j int, mass double, px double, py double, cvx double, cvy double, fx double, fy double")
MAP_PX = _struct("x int, y int, path_index int, nx float, ny float, ice_status short, ice_thickness float")
FLOW = _struct("x int, y int, vx float, vy float, norm float")
IMAGE = _struct("x int, y int, r short, g short, b short")
FRAMES = _struct("frame int, i int, j int, jpinv float, p float, q float, vx float, vy float, r short, g short, b short, mask short")
FORCES = _struct("frame int, region int, fx float, fy float")


def checked(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """The columns of ``schema`` in order; raises where one is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{what} lacks columns: {', '.join(wrong)}")
    return df.select(*schema.names)
