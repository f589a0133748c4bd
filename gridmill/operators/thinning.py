"""Points of a table thinned to a least distance, as if they were taken one by one in the order of their priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Cells that a distance of sqrt(2) cells' sides can reach, along each axis.
REACH = 2


def _around(rows: DataFrame) -> DataFrame:
    """Each row once for every cell (ci, cj) within reach of its own."""
    steps = F.sequence(F.lit(-REACH), F.lit(REACH))
    far = rows.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    return far.withColumns({"ci": F.col("ci") + F.col("di"), "cj": F.col("cj") + F.col("dj")}).drop("di", "dj")


def thin(points: DataFrame, distance: float, priority: list[Column]) -> DataFrame:
    """The points(x, y, …) that stay: no two nearer than ``distance``, and each one left out nearer than it to one that stays.

    The result is that of taking points in the order of ``priority`` (ties by
    place) and keeping each one that has no kept one nearer than ``distance``. Of
    rows with equal priority and place all stay or go. Points without a place are
    left out.

    Cells are so small that any two of their points are too near, so a cell keeps
    one at most, and only its first point need be looked at. In a round, a cell's
    first point stays if it comes before those of all cells within reach; what is
    too near to it goes. However dense points lie, a cell meets 25 others.
    """
    side = distance / 2**0.5
    name = F.struct(*[c.alias(f"p{k}") for k, c in enumerate(priority)], "x", "y")
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(name.alias("name"), "x", "y").distinct()
    # Cells are half open; a tiny bit smaller, as their diagonal is rounded.
    cell = {c: F.floor(F.col(x) / (side * (1 - 1e-12))) for c, x in (("ci", "x"), ("cj", "y"))}
    open_, kept = cut(known.withColumns(cell)), None
    while not open_.isEmpty():
        first = open_.groupBy("ci", "cj").agg(F.min("name").alias("name"))
        least = _around(first).groupBy("ci", "cj").agg(F.min("name").alias("least"))
        chosen = cut(first.join(least.hint("merge"), ["ci", "cj"]).where(F.col("name") == F.col("least")).select("name", "ci", "cj"))
        kept = chosen.select("name") if kept is None else kept.unionByName(chosen.select("name"))
        near = _around(chosen).groupBy("ci", "cj").agg(F.collect_list(F.struct("name.x", "name.y")).alias("near"))
        apart = F.exists("near", lambda k: (F.col("x") - k.x) * (F.col("x") - k.x) + (F.col("y") - k.y) * (F.col("y") - k.y) < distance * distance)
        open_ = cut(open_.join(near.hint("merge"), ["ci", "cj"], "left").where(~F.coalesce(apart, F.lit(False))).drop("near"))
    if kept is None:
        return points.where(F.lit(False))
    return points.withColumn("_name", name).join(kept, F.col("_name") == F.col("name"), "left_semi").drop("_name")
