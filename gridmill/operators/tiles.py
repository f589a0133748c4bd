"""Points in cells of any size: tiles of a quadtree over the points, each with the cells that may still count in it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Deepest level of tiles, levels a round, and pairs of place and triangle from which on a tile is split.
DEEPEST, STEP, HOT_PAIRS = 24, 2, 1 << 17
#: Rows of a counted table up to which it is broadcast; what grew by tiles since its size was estimated never is.
FEW, SHUFFLED = 100_000, "merge"
#: What rounding may move, as a share of lengths times coordinates.
SLACK = 1e-12

_CORNERS = (("ax", "ay"), ("bx", "by"), ("cx", "cy"))
#: Of a tile: the middle of the box around its places, and half its width and height.
_BOX = ("_x", "_y", "_w", "_h")
#: Of a triangle: its edges, and the size of its coordinates.
_EDGES = ("_far", *[f"_{c}{k}" for k in range(3) for c in "abc"])


def _edge(px: Column, py: Column, qx: Column, qy: Column, x: Column, y: Column) -> Column:
    """Above 0 where (x, y) lies left of the line from p to q."""
    return (qx - px) * (y - py) - (qy - py) * (x - px)


def _lines() -> dict[str, Column]:
    """Of the triangle's edges: side = _a x + _b y + _c, above 0 inside; and how large its coordinates are."""
    at = {c: F.col(f"cell.{c}").cast("double") for p in _CORNERS for c in p}
    turn = F.signum(_edge(*at.values()))
    found = {"_far": reduce(Column.__add__, map(F.abs, at.values()))}
    for k, ((px, py), (qx, qy)) in enumerate(zip(_CORNERS, (*_CORNERS[1:], _CORNERS[0]), strict=True)):
        a, b = (at[py] - at[qy]) * turn, (at[qx] - at[px]) * turn
        found |= {f"_a{k}": a, f"_b{k}": b, f"_c{k}": -(a * at[px] + b * at[py])}
    return {name: F.coalesce(c, F.lit(0.0)) for name, c in found.items()}  # never null, so that code is short


def _sides() -> list[tuple[Column, Column, Column]]:
    """Of each edge: the side of the middle of the tile's box, how far its corners differ from that, and the scale of rounding."""
    x, y, w, h = (F.col(c) for c in _BOX)
    far = (F.abs(x) + F.abs(y) + w + h + F.col("_far")) * SLACK
    lines = [[F.col(f"_{c}{k}") for c in "abc"] for k in range(3)]
    return [(a * x + b * y + c, F.abs(a) * w + F.abs(b) * h, (F.abs(a) + F.abs(b)) * far) for a, b, c in lines]


def _meets() -> Column:
    """Whether a triangle may hold a place of the box: false only where an edge has the whole box on its outer side."""
    return reduce(Column.__and__, [middle + corners >= -scale for middle, corners, scale in _sides()])


def _covers() -> Column:
    """Whether a triangle holds all places of the box, however their shares are rounded."""
    widest = F.greatest(*[scale for _, _, scale in _sides()])
    return reduce(Column.__and__, [(middle - corners > widest) & (middle < F.lit(float("inf"))) for middle, corners, _ in _sides()])


def _split(rows: DataFrame) -> DataFrame:
    """Rows of tiles as those of all their parts of the next round; what is inlined is a constant, so that its code is short."""
    within = F.inline(F.array(*[F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a in range(2**STEP) for b in range(2**STEP)]))
    return rows.select("*", within).withColumns({"i": F.col("i") * 2**STEP + F.col("_a"), "j": F.col("j") * 2**STEP + F.col("_b")}).drop("_a", "_b")


def _few(table: DataFrame) -> DataFrame:
    """To be broadcast where it is counted as small, else to be joined by shuffle."""
    return F.broadcast(table) if table.count() <= FEW else table.hint(SHUFFLED)


def probe_points(points: DataFrame, triangles: DataFrame, names: list[str], hot: int = HOT_PAIRS) -> DataFrame:
    """The points(x, y, …) with cell_id and the values ``names`` of the triangle that they lie in, by barycentric interpolation.

    triangles(cell_id, ax, ay, bx, by, cx, cy, and a_n, b_n, c_n for each name n).
    Edges belong to a triangle; of several that hold a point the lowest cell_id
    counts; outside all, and for points without a place, cell_id is null.
    Triangles without an area, and such with nulls or without end, hold nothing.

    Only the lowest cell counts, so a triangle that holds all places of a tile is
    that tile's bound: those with higher numbers are neither compared with its
    places nor taken to its parts. A tile in which more than ``hot`` pairs of place
    and triangle are left is split, and so each place is looked up in one tile.
    """
    area = F.abs(_edge(*[F.col(c) for p in _CORNERS for c in p]))
    corners = [c for p in _CORNERS for c in p]
    whole = triangles.where((area > 0) & (area < F.lit(float("inf"))))
    flat = cut(whole.select(F.struct("cell_id", *corners, *[f"{k}_{n}" for n in names for k in "abc"]).alias("cell")).repartition(F.col("cell.cell_id")))
    id_type = triangles.schema["cell_id"].dataType
    none = points.withColumns({"cell_id": F.lit(None).cast(id_type), **{n: F.lit(None).cast("double") for n in names}})
    reach = flat.select(*[f(*[F.col(f"cell.{p[k]}").cast("double") for p in _CORNERS]).alias(f"{e}{'xy'[k]}") for e, f in (("l", F.least), ("h", F.greatest)) for k in (0, 1)])
    frame = reach.agg(F.min("lx"), F.min("ly"), F.max("hx"), F.max("hy")).first()
    if frame[0] is None:
        return none
    pad = 1e-9 * max(abs(c) for c in frame)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    placed = points.select(x.alias("x"), y.alias("y")).where(x.between(frame[0] - pad, frame[2] + pad) & y.between(frame[1] - pad, frame[3] + pad))
    places = cut(placed.distinct())
    extent = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if extent[0] is None:
        return none
    width = max(extent[2] - extent[0], extent[3] - extent[1]) or 1.0

    def located(level: int) -> DataFrame:
        """Places with the numbers of their tile; tiles of a level are parts of those of the level above."""
        deep = [F.least(F.floor((F.col(c) - low) / F.lit(width) * 2.0**DEEPEST), F.lit(2**DEEPEST - 1)).cast("long") for c, low in (("x", extent[0]), ("y", extent[1]))]
        return places.withColumns({k: F.shiftright(d, DEEPEST - level) for k, d in zip("ij", deep, strict=True)})

    def held(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"u": u, "v": v}).withColumn("w", 1 - F.col("u") - F.col("v")).where("u >= 0 AND v >= 0 AND w >= 0")

    det = (F.col("by") - F.col("cy")) * (F.col("ax") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("ay") - F.col("cy"))
    u = F.try_divide((F.col("by") - F.col("cy")) * (F.col("x") - F.col("cx")) + (F.col("cx") - F.col("bx")) * (F.col("y") - F.col("cy")), det)
    v = F.try_divide((F.col("cy") - F.col("ay")) * (F.col("x") - F.col("cx")) + (F.col("ax") - F.col("cx")) * (F.col("y") - F.col("cy")), det)
    value = [(F.col("u") * F.col(f"a_{n}") + F.col("v") * F.col(f"b_{n}") + F.col("w") * F.col(f"c_{n}")).alias(n) for n in names]

    ends = {f"{e}{c}": f(c) for c in "xy" for e, f in (("l", F.min), ("h", F.max))}
    middle = [(F.col(f"l{c}") + F.col(f"h{c}")) / 2 for c in "xy"] + [(F.col(f"h{c}") - F.col(f"l{c}")) / 2 for c in "xy"]
    box = [F.coalesce(c, F.lit(0.0)).alias(b) for b, c in zip(_BOX, middle, strict=True)]
    below = F.col("bound").isNull() | (F.col("cell.cell_id") < F.col("bound"))
    open_, split, found, level = flat.select("cell", *[c.alias(e) for e, c in _lines().items()], *[F.lit(0).cast("long").alias(k) for k in "ij"]), None, [], 0
    # The optimizer multiplies the sizes of joined tables, round upon round; unions and semi-joins keep its numbers short.
    while True:
        tiles = located(level).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), *[c.alias(e) for e, c in ends.items()]).select("i", "j", "n", *box)
        if split is None:
            tiles = tiles.withColumn("bound", F.lit(None).cast(id_type))
        else:
            tiles = tiles.join(_few(_split(split.select("bound", "i", "j"))), ["i", "j"])
            open_ = _split(open_)
        tiles = cut(tiles)
        met = open_.join(_few(tiles), ["i", "j"]).where(below & _meets())
        least = met.where(_covers()).select("i", "j", F.lit(None).cast("long").alias("n"), F.col("cell.cell_id").alias("bound"))
        bounds = cut(tiles.select("i", "j", "n", "bound").unionByName(least).groupBy("i", "j").agg(F.max("n").alias("n"), F.min("bound").alias("bound")))
        lower = [F.col("i") == F.col("_i"), F.col("j") == F.col("_j"), F.col("_bound").isNull() | (F.col("cell.cell_id") < F.col("_bound"))]
        left = cut(met.where(~_covers()).select("cell", *_EDGES, "i", "j").join(_few(bounds.select(*[F.col(c).alias(f"_{c}") for c in ("i", "j", "bound")])), lower, "left_semi"))
        counts = left.groupBy("i", "j").agg(F.count(F.lit(1)).alias("m")).select("i", "j", F.lit(None).cast("long").alias("n"), F.lit(None).cast(id_type).alias("bound"), "m")
        counted = bounds.withColumn("m", F.lit(0).cast("long")).unionByName(counts).groupBy("i", "j").agg(*[F.max(c).alias(c) for c in ("n", "bound", "m")])
        crowded = (F.col("n") > 1) & (F.col("n") * (F.col("m") + 1) > hot) & F.lit(level < DEEPEST)
        known = cut(counted.where("m > 0 OR bound IS NOT NULL").withColumn("crowded", crowded))
        done, split = known.where("NOT crowded"), known.where("crowded")
        listed = left.join(_few(done.where("m > 0").select("i", "j")), ["i", "j"], "left_semi")
        bounding = done.where("bound IS NOT NULL").join(flat, F.col("bound") == F.col("cell.cell_id")).select("cell", "i", "j")
        found.append((level, cut(listed.select("cell", "i", "j").unionByName(bounding))))
        if split.isEmpty():
            break
        open_ = left.join(_few(split.select("i", "j")), ["i", "j"], "left_semi")
        level += STEP

    def looked_up(level: int, cells: DataFrame) -> DataFrame:
        # A least number is a hash aggregate; a least struct would sort every pair. Values are taken of one triangle alone.
        cells = cells.select("i", "j", "cell.*")
        pairs = held(located(level).join(_few(cells), ["i", "j"]))
        lowest = pairs.groupBy("x", "y", "i", "j").agg(F.min("cell_id").alias("cell_id"))
        valued = held(lowest.join(_few(cells), ["i", "j", "cell_id"]))
        return valued.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min(F.struct("cell_id", *value)).alias("found"))

    values = reduce(DataFrame.unionByName, [looked_up(*f) for f in found])
    return points.join(values, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").select(points["*"], "found.*")
