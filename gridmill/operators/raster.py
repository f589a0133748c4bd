"""Curves to pixels: evaluation, scanline fill, precedence, bounding box."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import INTERIOR


def bezier(t: Column, points: tuple[str, str, str, str]) -> Column:
    """One coordinate of a cubic Bezier segment at parameter t."""
    a, b, c, d = (F.col(p) for p in points)
    s = 1 - t
    return s * s * s * a + 3 * s * s * t * b + 3 * s * t * t * c + t * t * t * d


def bezier_slope(t: Column, points: tuple[str, str, str, str]) -> Column:
    a, b, c, d = (F.col(p) for p in points)
    s = 1 - t
    return 3 * s * s * (b - a) + 6 * s * t * (c - b) + 3 * t * t * (d - c)


X, Y = ("x0", "x1", "x2", "x3"), ("y0", "y1", "y2", "y3")


def sample_curves(segments: DataFrame, steps: int | Column, carried: Sequence[str] = ()) -> DataFrame:
    """(path, seg, k, steps, x, y, tx, ty, carried…): points and unit tangents at t = k / steps of each segment."""
    at = segments.withColumn("steps", F.lit(steps) if isinstance(steps, int) else steps)
    at = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps").cast("int"))))
    t = F.col("k") / F.col("steps")
    sampled = at.withColumns({"x": bezier(t, X), "y": bezier(t, Y), "sx": bezier_slope(t, X), "sy": bezier_slope(t, Y)})
    long_ = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy"))
    unit = [F.coalesce(F.try_divide(F.col(s), long_), F.lit(0.0)).alias(n) for s, n in (("sx", "tx"), ("sy", "ty"))]
    return sampled.select("path", "seg", "k", "steps", "x", "y", *unit, *carried)


def steps_without_gaps() -> Column:
    """Steps of a segment after which neighbouring points are a pixel apart at most, along either axis.

    A coordinate's slope is three times a mix of the differences of its control
    points, so it is three times the largest of them at most.
    """
    leaps = [F.abs(F.col(b) - F.col(a)) for axis in (X, Y) for a, b in zip(axis, axis[1:], strict=False)]
    return F.greatest(F.ceil(3 * F.greatest(*leaps)), F.lit(1)).cast("int")


def outline(segments: DataFrame) -> DataFrame:
    """(path, seg, k, x, y): the consecutive pixels of curves, each touching the next.

    A segment's pixels are compared among themselves, and its first one with
    the end of the segment before, so no path meets in one task as a whole.
    """
    ends = F.struct(F.floor("x3").cast("int").alias("x"), F.floor("y3").cast("int").alias("y"))
    known = segments.withColumn("ended", F.lag(ends).over(Window.partitionBy("path").orderBy("seg")))
    points = sample_curves(known, steps_without_gaps(), ["ended"]).select("path", "seg", "k", F.floor("x").cast("int").alias("x"), F.floor("y").cast("int").alias("y"), "ended")
    within = F.lag(F.struct("x", "y")).over(Window.partitionBy("path", "seg").orderBy("k"))
    before = F.when(F.col("k") == 0, F.col("ended")).otherwise(within)
    return points.withColumn("before", before).where(~F.struct("x", "y").eqNullSafe(F.col("before"))).drop("before", "ended")


def crossings(boundary: DataFrame) -> DataFrame:
    """(path, y, x, dir): where closed polylines boundary(path, seq, x, y) cross rows at y + 0.5.

    Horizontal edges cross nothing; an edge upwards counts 1, downwards -1.
    """
    order = Window.partitionBy("path").orderBy("seq")
    whole = Window.partitionBy("path")
    ends = boundary.select(
        "path",
        "seq",
        F.col("x").alias("xa"),
        F.col("y").alias("ya"),
        F.lead(F.struct("x", "y")).over(order).alias("next"),
        F.min_by(F.struct("x", "y"), "seq").over(whole).alias("first"),
    )
    edges = ends.withColumn("to", F.coalesce("next", "first")).select(
        "path", "xa", "ya", F.col("to.x").alias("xb"), F.col("to.y").alias("yb")
    ).where("ya <> yb")
    rows = edges.withColumn("y", F.explode(F.sequence(F.least("ya", "yb"), F.greatest("ya", "yb") - 1)))
    x = F.col("xa") + (F.col("y") + 0.5 - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    return rows.select("path", "y", x.alias("x"), F.when(F.col("yb") > F.col("ya"), 1).otherwise(-1).alias("dir"))


def filled(boundary: DataFrame) -> DataFrame:
    """(path, x, y) of the pixels inside closed polylines, by non-zero winding along each row."""
    along = Window.partitionBy("path", "y").orderBy("x", "dir")
    spans = crossings(boundary).select(
        "path",
        "y",
        F.lag("x").over(along).alias("from"),
        F.col("x").alias("to"),
        F.sum("dir").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("winding"),
    )
    inside = spans.where("winding <> 0").select("path", "y", F.ceil("from").cast("int").alias("a"), F.floor("to").cast("int").alias("b"))
    return inside.where("a <= b").select("path", F.explode(F.sequence("a", "b")).alias("x"), "y").distinct()


def fill_precedence(candidates: DataFrame) -> DataFrame:
    """(x, y, path_index) from candidates(x, y, path, boundary).

    The highest path with a boundary at the pixel wins; without one, the lowest
    path other than 0 that covers it; then path 0.
    """
    found = candidates.groupBy("x", "y").agg(
        F.max(F.when(F.col("boundary"), F.col("path"))).alias("edge"),
        F.min(F.when(~F.col("boundary") & (F.col("path") > 0), F.col("path"))).alias("inner"),
    )
    return found.select("x", "y", F.coalesce("edge", INTERIOR + F.col("inner"), F.lit(INTERIOR)).cast("int").alias("path_index"))


def closed_only(paths: DataFrame) -> DataFrame:
    return paths.where("closed")


def main_first(paths: DataFrame, main: str | Column) -> DataFrame:
    """Swap the main path, given by its name or by a condition, with path 0 and mark it; without such a path nothing changes."""
    main = paths.where(F.col("name") == main if isinstance(main, str) else main).agg(F.min("path").alias("main"))
    marked = paths.join(F.broadcast(main))  # an aggregate without keys: one row
    path = F.when(F.col("main").isNull(), F.col("path")).when(F.col("path") == F.col("main"), 0).when(F.col("path") == 0, F.col("main"))
    return marked.withColumns({"is_main": F.coalesce(F.col("path") == F.col("main"), F.lit(False)), "path": path.otherwise(F.col("path"))}).drop("main")


def bounding_box(pixels: DataFrame, width: int, height: int, pad: int = 2) -> DataFrame:
    """(ox, oy, gx, gy) of pixels with a path, padded and clamped; raises if there is none."""
    box = pixels.where("path_index <> -1").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    x0 = F.when(F.col("x0").isNull(), F.raise_error(F.lit("modelled area not found"))).otherwise(F.col("x0"))
    found = box.select(
        F.greatest(F.lit(0), x0 - pad).cast("int").alias("ox"),
        F.greatest(F.lit(0), F.col("y0") - pad).cast("int").alias("oy"),
        F.least(F.lit(width - 1), F.col("x1") + pad).alias("x1"),
        F.least(F.lit(height - 1), F.col("y1") + pad).alias("y1"),
    )
    return found.select("ox", "oy", (F.col("x1") - F.col("ox") + 1).alias("gx"), (F.col("y1") - F.col("oy") + 1).alias("gy"))


def signed_area(boundary: DataFrame) -> DataFrame:
    """(path, area): shoelace area of closed polylines; its sign is the winding."""
    order = Window.partitionBy("path").orderBy("seq")
    whole = Window.partitionBy("path")
    to = F.coalesce(F.lead(F.struct("x", "y")).over(order), F.min_by(F.struct("x", "y"), "seq").over(whole))
    edges = boundary.withColumn("to", to)
    return edges.groupBy("path").agg((F.sum(F.col("x") * F.col("to.y") - F.col("to.x") * F.col("y")) / 2).alias("area"))
