"""Pixels by colour: nearest point of colour curves, classes and thickness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import INTERIOR

#: Distances within which a colour is water, or else intact.
WATER_DISTANCE, SOLID_DISTANCE = 0.05, 0.1
#: Classes of a pixel.
OPEN_WATER, CRUSHED, INTACT, LAND = 0, 1, 2, 3

Curve = Sequence[tuple[float, float, float]]


def project(rgb: Sequence[Column], curve: Curve) -> tuple[Column, Column]:
    """(distance, position) of the nearest point of a polyline; position is 0 to 1 along it.

    The curve is a parameter of a few points, so its segments are unrolled into
    the row's expression; of equally near segments the first wins.
    """
    lengths = [sum((b - a) ** 2 for a, b in zip(p, q, strict=True)) ** 0.5 for p, q in zip(curve, curve[1:], strict=False)]
    total, done = sum(lengths), 0.0
    options = []
    for k, (p, q, length) in enumerate(zip(curve, curve[1:], lengths, strict=False)):
        side = [b - a for a, b in zip(p, q, strict=True)]
        along = sum(((c - a) * s for c, a, s in zip(rgb[1:], p[1:], side[1:], strict=True)), (rgb[0] - p[0]) * side[0])
        t = F.least(F.greatest(along / (length * length), F.lit(0.0)), F.lit(1.0)) if length else F.lit(0.0)
        gaps = [c - (a + s * t) for c, a, s in zip(rgb, p, side, strict=True)]
        distance = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
        position = (done + t * length) / total if total else F.lit(0.0)
        options.append(F.struct(distance.alias("distance"), F.lit(k).alias("segment"), position.alias("position")))
        done += length
    best = F.least(*options) if len(options) > 1 else options[0]
    return best["distance"], best["position"]


def classify(image: DataFrame, open_water: Curve, solid: Curve, scale: float = 255.0) -> DataFrame:
    """Image with (kind, distance, position): water, crushed or intact by colour."""
    rgb = [F.col(c) / scale for c in "rgb"]
    (dw, pw), (ds, ps) = project(rgb, open_water), project(rgb, solid)
    near = image.withColumns({"dw": dw, "pw": pw, "ds": ds, "ps": ps})
    water, intact = F.col("dw") < WATER_DISTANCE, F.col("ds") < SOLID_DISTANCE
    return near.withColumns(
        {
            "kind": F.when(water, OPEN_WATER).when(intact, INTACT).otherwise(CRUSHED),
            "position": F.when(water, F.col("pw")).otherwise(F.col("ps")),
        }
    ).drop("pw", "ps")


def thickness(classified: DataFrame) -> DataFrame:
    """Classified pixels(path_index, kind, position) with ice_status and ice_thickness.

    Thin intact ice is crushed and keeps its thickness; what lies on land or
    inside other paths is masked.
    """
    thick = (
        F.when(F.col("kind") == OPEN_WATER, 0.0)
        .when(F.col("kind") == CRUSHED, 0.8)
        .otherwise(0.8 + 0.2 * F.col("position"))
    )
    land = (F.col("path_index") == -1) | (F.col("path_index") > INTERIOR)
    thin = (F.col("kind") == INTACT) & (F.col("ice_thickness") < 0.9)
    status = F.when(land, LAND).when(thin, CRUSHED).otherwise(F.col("kind"))
    return classified.withColumn("ice_thickness", thick).withColumn("ice_status", status)


def initial_points(points: DataFrame, map_px: DataFrame, image: DataFrame, gx: int, gy: int) -> DataFrame:
    """Points(ci, cj, …) on ice and off the rim, with colour, thickness and rest state."""
    from ..functions.cells import at_rim

    ice = map_px.where(F.col("ice_status").isin(CRUSHED, INTACT)).select(
        F.col("x").alias("ci"), F.col("y").alias("cj"), "ice_status", F.col("ice_thickness").cast("double").alias("thickness")
    )
    colours = image.select(F.col("x").alias("ci"), F.col("y").alias("cj"), "r", "g", "b")
    inner = points.where(~at_rim(F.col("ci"), F.col("cj"), gx, gy))
    found = inner.join(ice, ["ci", "cj"]).join(colours, ["ci", "cj"], "left")
    rest = {f"fe{k}": F.lit(v) for k, v in (("00", 1.0), ("01", 0.0), ("10", 0.0), ("11", 1.0))}
    rest |= {f"bp{k}": F.lit(0.0) for k in ("00", "01", "10", "11")} | {c: F.lit(0.0) for c in ("vx", "vy", "p", "q")}
    return found.withColumns(
        {**rest, "jp_inv": F.lit(1.0), "crushed": F.col("ice_status") == CRUSHED, "disabled": F.lit(False)}
    ).drop("ice_status")


def on_ice(points: DataFrame, map_px: DataFrame, gx: int, gy: int) -> DataFrame:
    """Points off the rim whose cell is crushed or intact ice."""
    from ..functions.cells import at_rim

    ice = map_px.where(F.col("ice_status").isin(CRUSHED, INTACT)).select(F.col("x").alias("ci"), F.col("y").alias("cj"))
    return points.where(~at_rim(F.col("ci"), F.col("cj"), gx, gy)).join(ice, ["ci", "cj"], "left_semi")
