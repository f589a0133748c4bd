"""Order and equal splits of particles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task ranks, about.
LANE_ROWS = 1_000_000


def equal_split(df: DataFrame, parts: int, order: list[Column], lanes: int | None = None) -> DataFrame:
    """Add ``part``: equal counts of the ordered rows, the small parts first.

    Part k takes floor(what is left / parts left). Rows are ranked without
    meeting in one task: they are dealt into range partitions, ranked there,
    and shifted by what precedes each partition. Counts of partitions are all
    that reaches the driver; there is one for LANE_ROWS rows, or ``lanes``.
    """
    from ..plans.lineage import cut

    lanes = lanes or max(8, df.count() // LANE_ROWS)
    dealt = cut(df.repartitionByRange(lanes, *order).withColumn("lane", F.spark_partition_id()))
    sizes = {r["lane"]: r["n"] for r in dealt.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, ahead, starts = sum(sizes.values()), 0, {}
    for lane in sorted(sizes):
        starts[lane] = ahead
        ahead += sizes[lane]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv]), F.col("lane"))
    rank = start + F.row_number().over(Window.partitionBy("lane").orderBy(*order)) - 1
    part, upto = F.lit(parts - 1), []
    left = total
    for k in range(parts):
        left -= left // (parts - k)
        upto.append(total - left)
    for k in reversed(range(parts - 1)):
        part = F.when(F.col("rank") < upto[k], k).otherwise(part)
    return dealt.withColumn("rank", rank).withColumn("part", part).drop("lane", "rank")


def find_cell(particles: DataFrame, i: int, j: int) -> DataFrame:
    """Particles of one cell. Where they are stored as ``squeeze`` lays them out, files and row groups of other cells are skipped."""
    return particles.where((F.col("ci") == i) & (F.col("cj") == j))


def squeeze(particles: DataFrame) -> DataFrame:
    """Drop disabled particles and lay the rest out by cell: range partitions, sorted within."""
    return particles.where(~F.col("disabled")).repartitionByRange("ci", "cj").sortWithinPartitions("ci", "cj")


def needs_squeeze(disabled: int, particles: int, share: float = 0.05) -> bool:
    return particles > 0 and disabled > share * particles
