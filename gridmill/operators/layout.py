"""A stored layout for lookups by place: zones along a space-filling curve, and a small table of what each zone holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a cell number, and ranges of the curve that a box is taken as, at most.
BITS, MOST_RANGES = 16, 64
#: Masks of the steps that move the bits of a number of 16 bits apart.
_SPREAD = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(c: Column) -> Column:
    c = c.cast("long")
    for step, mask in _SPREAD:
        c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask).cast("long"))
    return c


def curve_key(i: Column, j: Column) -> Column:
    """The place of cell (i, j) on a Z curve: the bits of both numbers, by turns. Numbers have BITS bits."""
    return F.shiftleft(_spread(i), 1).bitwiseOR(_spread(j))


def box_ranges(i0: int, i1: int, j0: int, j1: int, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve, both ends included, that hold every cell of a box; few enough, so cells beside it may be among them.

    Squares that lie in the box are ranges of their own; those across its edge
    are halved as long as that makes no more than ``most``.
    """
    whole: list[tuple[int, int, int]] = []
    across = [(0, 0, 1 << BITS)]
    while across:
        inside, halved = [], []
        for i, j, size in across:
            half = size // 2
            for a, b in ((i, j), (i, j + half), (i + half, j), (i + half, j + half)):
                if a > i1 or b > j1 or a + half <= i0 or b + half <= j0:
                    continue
                (inside if i0 <= a and a + half - 1 <= i1 and j0 <= b and b + half - 1 <= j1 else halved).append((a, b, half))
        if len(_joined(whole + inside + halved)) > most:
            break
        whole, across = whole + inside, halved
    return _joined(whole + across)


def _key(i: int, j: int) -> int:
    return sum(((i >> k & 1) << (2 * k + 1)) | ((j >> k & 1) << (2 * k)) for k in range(BITS))


def _joined(squares: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The ranges of squares, neighbours on the curve as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((_key(i, j), _key(i, j) + size * size - 1) for i, j, size in squares):
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def store(points: DataFrame, path: str, zones: int) -> None:
    """Write points(ci, cj, …) in ``zones`` of about equal size along the curve, in order within each, and what each holds.

    Cells are numbers of BITS bits. A cell with many points may lie in several zones.
    """
    known = points.withColumn("curve", curve_key(F.col("ci"), F.col("cj")))
    tie = F.xxhash64(*[c for c, kind in points.dtypes if "map<" not in kind])
    dealt = known.withColumn("_tie", tie).repartitionByRange(zones, "curve", "_tie").withColumn("zone", F.spark_partition_id())
    dealt.sortWithinPartitions("zone", "curve", "_tie").drop("_tie").write.mode("overwrite").partitionBy("zone").parquet(f"{path}/points")
    held = points.sparkSession.read.parquet(f"{path}/points").groupBy("zone").agg(F.min("curve").alias("low"), F.max("curve").alias("high"), F.count(F.lit(1)).alias("n"))
    held.repartition(1).write.mode("overwrite").parquet(f"{path}/zones")


def lookup(spark: SparkSession, path: str, i0: int, i1: int, j0: int, j1: int, most: int = MOST_RANGES) -> DataFrame:
    """The stored points of cells i0 to i1 and j0 to j1. Zones that hold none of them aren't opened, and of the others row groups are passed over."""
    ranges = box_ranges(max(i0, 0), min(i1, (1 << BITS) - 1), max(j0, 0), min(j1, (1 << BITS) - 1), most) if i0 <= i1 and j0 <= j1 else []
    held, touched = spark.read.parquet(f"{path}/zones"), F.lit(False)
    for start, end in ranges:
        touched = touched | ((F.col("low") <= end) & (F.col("high") >= start))
    zones = [r["zone"] for r in held.where(touched).select("zone").collect()]  # those of the box alone
    on_curve = F.lit(False)
    for start, end in ranges:
        on_curve = on_curve | F.col("curve").between(start, end)
    exact = F.col("ci").between(i0, i1) & F.col("cj").between(j0, j1)
    return spark.read.parquet(f"{path}/points").where(F.col("zone").isin(zones) & on_curve & exact).drop("zone", "curve")
