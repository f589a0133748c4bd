"""Nearest segment of many: points against tables of curves, down a tree of the points' tiles.

A tile is a box around its points. A segment stays with it if it may be the
nearest of one of them: if the centre of the box is not farther from it than half
the box's diagonal and the largest distance that a point of the tile needs to look.
Crowded tiles are split and what stays goes to their parts. How far a point needs
to look is known from its nearest among a share of the segments; among that share,
from the segment that is nearest to the centre. Segments are whole rows at every
level and lie only in tiles with points nearby, so neither their number nor their
length is squared, and no side is broadcast whole or crossed.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Pairs of a point and a segment in a leaf, from which on it is split; levels of tiles at most.
LEAF_PIECES, MOST_LEVELS = 1 << 18, 24
#: Segments, about, of the share that is searched first where there are more than twice as many.
SHARE = 1 << 17
#: Bounds are widened by these shares of themselves and of the coordinates, as sums of squares are rounded.
SLACK, GRAIN = 1e-9, 1e-12
#: Rows of a counted table up to which it is broadcast; what grew by pairs since its size was estimated never is.
FEW, SHUFFLED = 1 << 18, "merge"


def polyline_segments(nodes: DataFrame, axes: list[str], curve: str = "curve", seq: str = "seq") -> DataFrame:
    """Segments of curves nodes(curve, seq, axes…): (curve, seg, a<axis>, b<axis>, done, length, total).

    done: length of the curve before the segment, a running sum; seg: the seq at
    which it begins. Curves of one node have none.
    """
    order = Window.partitionBy(curve).orderBy(seq)
    ends = nodes.select(curve, F.col(seq).alias("seg"), *[F.col(x).alias(f"a{x}") for x in axes], *[F.lead(x).over(order).alias(f"b{x}") for x in axes])
    known = ends.where(" AND ".join(f"b{x} IS NOT NULL" for x in axes)).withColumn("length", F.sqrt(sum_of(*[square(F.col(f"b{x}") - F.col(f"a{x}")) for x in axes])))
    along = Window.partitionBy(curve).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(curve).orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.withColumns({"done": F.coalesce(F.sum("length").over(along), F.lit(0.0)), "total": F.sum("length").over(whole)})


def square(c: Column) -> Column:
    return c * c


def sum_of(first: Column, *others: Column) -> Column:
    for c in others:
        first = first + c
    return first


def _usable(columns: list[str]) -> Column:
    """All are numbers, and finite."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.coalesce(F.abs(F.col(c)) < F.lit(float("inf")), F.lit(False))
    return ok


def _few(table: DataFrame) -> DataFrame:
    """To be broadcast where it is counted as small, else to be joined by shuffle."""
    return F.broadcast(table) if table.count() <= FEW else table.hint(SHUFFLED)


def _to_segment(at: list[Column], axes: list[str]) -> tuple[Column, Column]:
    """The place of a<axis> to b<axis> that is nearest to ``at``, 0 to 1, and its distance."""
    side = [F.col(f"b{x}") - F.col(f"a{x}") for x in axes]
    along = sum_of(*[(c - F.col(f"a{x}")) * s for c, x, s in zip(at, axes, side, strict=True)])
    t = F.coalesce(F.least(F.greatest(F.try_divide(along, sum_of(*map(square, side))), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return t, F.sqrt(sum_of(*[square(c - (F.col(f"a{x}") + s * t)) for c, x, s in zip(at, axes, side, strict=True)]))


class _Tiles:
    """Tiles of places(axes…): cubes of a grid that is halved level by level."""

    def __init__(self, axes: list[str], lows: list[float], width: float, largest: float) -> None:
        self.axes, self.lows, self.width, self.pad = axes, lows, width, largest * GRAIN
        self.keys = [f"k{x}" for x in axes]
        self.step = 1 if len(axes) > 2 else 2

    def of(self, places: DataFrame, level: int) -> DataFrame:
        deep = [F.least(F.floor((F.col(x) - low) / F.lit(self.width) * 2.0**MOST_LEVELS), F.lit(2**MOST_LEVELS - 1)).cast("long") for x, low in zip(self.axes, self.lows, strict=True)]
        return places.withColumns({k: F.shiftright(d, MOST_LEVELS - level) for k, d in zip(self.keys, deep, strict=True)})

    def parts(self) -> Column:
        """Inlined: the numbers of a tile's parts of the next round within it, p<axis>; a constant, so that its code is short."""
        return F.inline(F.array(*[F.struct(*[F.lit(d).alias(f"p{x}") for d, x in zip(w, self.axes, strict=True)]) for w in product(range(2**self.step), repeat=len(self.axes))]))

    def split(self, rows: DataFrame) -> DataFrame:
        """Rows of tiles as those of all their parts of the next round."""
        inner = [(F.col(k) * 2**self.step + F.col(f"p{x}")).alias(k) for k, x in zip(self.keys, self.axes, strict=True)]
        return rows.select("*", self.parts()).select(*[c for c in rows.columns if c not in self.keys], *inner)

    def reaches(self, far: Column, distance: Column, radius: Column) -> Column:
        return distance <= (radius + far) * (1 + SLACK) + self.pad

    def nearby(self, places: DataFrame, lines: DataFrame) -> list[tuple[int, DataFrame]]:
        """By level: the leaf tiles with those of lines(line, a<axis>, b<axis>) that may be the nearest of a place.

        places(axes…) may have ``least``, a distance within which a segment is known to lie.
        """
        known, axes, keys = "least" in places.columns, self.axes, self.keys
        centre = [(F.col(f"l{x}") + F.col(f"h{x}")) / 2 for x in axes]
        radius = F.sqrt(sum_of(*[square((F.col(f"h{x}") - F.col(f"l{x}")) / 2) for x in axes]))
        box = [f(x).alias(f"{e}{x}") for e, f in (("l", F.min), ("h", F.max)) for x in axes]
        kept = ["line", *[f"{e}{x}" for e in "ab" for x in axes], *keys]
        open_, split, found, level = lines.select(*kept[: -len(keys)], *[F.lit(0).cast("long").alias(k) for k in keys]), None, [], 0
        # The optimizer multiplies the sizes of joined tables, round upon round; unions and semi-joins keep its numbers short.
        while True:
            tiles = self.of(places, level).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *box, *([F.max("least").alias("far")] if known else []))
            if split is not None:
                tiles, open_ = tiles.join(_few(self.split(split)), keys, "left_semi"), self.split(open_)
            tiles = cut(tiles)
            if known and split is not None:
                if tiles.count() > FEW:  # before rows are moved to the tile: by its whole cube
                    side = self.width / 2**level
                    cube = [F.lit(low) + (F.col(k) + 0.5) * side for k, low in zip(keys, self.lows, strict=True)]
                    open_ = open_.where(self.reaches(F.col("above"), _to_segment(cube, axes)[1], F.lit(side * len(axes) ** 0.5 / 2)))
                open_ = open_.drop("above")
            met = open_.join(_few(tiles.select(*keys, *[c.alias(f"c{x}") for c, x in zip(centre, axes, strict=True)], radius.alias("radius"), *(["far"] if known else []))), keys)
            met = met.withColumn("apart", _to_segment([F.col(f"c{x}") for x in axes], axes)[1])
            if known:
                left = cut(met.where(self.reaches(F.col("far"), F.col("apart"), F.col("radius"))).select(*kept, F.col("far").alias("above")))
            else:
                limits = cut(met.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(F.col("apart") + F.col("radius")).alias("far")))
                near = [*[F.col(k) == F.col(f"_{k}") for k in keys], self.reaches(F.col("far"), F.col("apart"), F.col("radius"))]
                left = cut(met.join(_few(limits), near, "left_semi").select(*kept))
            counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).select(*keys, F.lit(0).cast("long").alias("n"), "m")
            counted = tiles.select(*keys, "n", F.lit(0).cast("long").alias("m")).unionByName(counts).groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("m"))
            crowded = (F.col("n") > 1) & (F.col("n") * F.col("m") > LEAF_PIECES) & F.lit(level + self.step <= MOST_LEVELS)
            decided = cut(counted.select(*keys, crowded.alias("crowded")))
            split = decided.where("crowded").select(*keys)
            if split.isEmpty():
                return [*found, (level, left.select(*kept))]
            found.append((level, left.join(_few(decided.where("NOT crowded").select(*keys)), keys, "left_semi").select(*kept)))
            open_ = left.join(_few(split), keys, "left_semi")
            level += self.step

    def compared(self, places: DataFrame, nearby: list[tuple[int, DataFrame]]) -> list[DataFrame]:
        """By level: places with the segments near their tile, ``t`` and ``distance``."""
        t, distance = _to_segment([F.col(x) for x in self.axes], self.axes)
        return [_few(lines).join(self.of(places, level), self.keys).withColumn("t", t).withColumn("distance", distance) for level, lines in nearby]

    def least(self, places: DataFrame, nearby: list[tuple[int, DataFrame]]) -> DataFrame:
        """Places with the distance of their nearest segment: least numbers are hash aggregates, least structs would sort all."""
        rows = [met.groupBy(*self.axes).agg(F.min("distance").alias("least")) for met in self.compared(places.select(*self.axes), nearby)]
        return cut(reduce(DataFrame.unionByName, rows))


def nearest_segment(points: DataFrame, segments: DataFrame, axes: list[str], order: list[str]) -> DataFrame:
    """The points with ``nearest``: (distance, the ``order`` columns of the segment, t), t being 0 to 1 along the segment.

    points(axes…, …); segments(order…, a<axis>, b<axis>, …): of equally near
    segments the first in ``order`` counts. Points that aren't finite have null,
    as all have where there are no segments; segments that aren't finite are left
    out. Points at one place are looked up once.
    """
    ends = [f"{e}{x}" for x in axes for e in "ab"]
    lines = segments.where(_usable(ends)).groupBy(*ends).agg(F.min(F.struct(*order)).alias("name"))
    lines = cut(lines.select(F.monotonically_increasing_id().alias("line"), "name", *[F.col(c).cast("double") for c in ends]))
    places = cut(points.where(_usable(axes)).select(*[F.col(x).cast("double").alias(x) for x in axes]).distinct())

    shape = lines.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*map(F.abs, ends))).alias("largest")).first()
    spread = places.agg(*[f(x).alias(f"{f.__name__}_{x}") for x in axes for f in (F.min, F.max)]).first()
    if not shape["n"] or spread[0] is None:
        named = lines.schema["name"].dataType.simpleString()
        return points.withColumn("nearest", F.lit(None).cast(f"struct<distance:double,name:{named},t:double>"))
    lows, highs = [spread[f"min_{x}"] for x in axes], [spread[f"max_{x}"] for x in axes]
    width = max(h - l for l, h in zip(lows, highs, strict=True)) or 1.0
    tiles = _Tiles(axes, lows, width, max(shape["largest"], *map(abs, lows + highs)))
    session = points.sparkSession
    parts = min(int(session.conf.get("spark.sql.shuffle.partitions")), shape["n"] // 1000 + 1)  # few bytes, but much work
    dealt = lines.drop("name").repartition(parts, "line")
    bounded = places
    if shape["n"] > 2 * SHARE:
        share = cut(dealt.where(F.pmod(F.xxhash64(*ends), F.lit(shape["n"] // SHARE)) == 0))
        if not share.isEmpty():  # any share will do, as it only bounds the search
            bounded = tiles.least(places, tiles.nearby(places, share))
    near = tiles.nearby(bounded, dealt)
    least = tiles.least(bounded, near)
    first = [met.where(F.col("distance") == F.col("least")).select(*axes, "distance", "t", "line") for met in tiles.compared(least, near)]
    names = lines.select("line", "name")
    met = reduce(DataFrame.unionByName, first).join(F.broadcast(names) if shape["n"] <= FEW else names.hint(SHUFFLED), "line")
    found = met.groupBy(*axes).agg(F.min(F.struct("distance", "name", "t")).alias("nearest")).withColumnsRenamed({x: f"_{x}" for x in axes})
    return points.join(found, [F.col(x) == F.col(f"_{x}") for x in axes], "left").drop(*[f"_{x}" for x in axes])
