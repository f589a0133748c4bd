"""Registered queries over rasters, colours, curves, frames and meshes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as cell
from ..functions import color, naming
from ..operators import classify, colouring, fields, frames, raster, sampling
from ..sources import mesh
from . import adapters as a
from .adapters import CELLS, COLOURS, GX, GY, MAP_WIDTH, OPEN_WATER, ORDER_MAP, PARTICLES, POLYGON_SQL, SOLID, STENCIL, sql6
from .particle_queries import _FRAME, _MASKED, _NUDGE, _blend, _frame, _masked, rounded

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query(
    f"""WITH {ORDER_MAP}, s AS (SELECT x, y, path_index, CASE WHEN path_index < 1000 THEN path_index + 1 ELSE path_index - 900 END AS status FROM omap)
SELECT x, y, path_index, status, CASE WHEN status >= 100 THEN status - 99 ELSE status END AS region FROM s"""
)
def status_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = a.order_map(spark, sf_dir).select("x", "y", "path_index").withColumn("status", cell.status_of(F.col("path_index")))
    return s.withColumn("region", cell.region_of(F.col("status")))


@query(
    f"""WITH {ORDER_MAP} SELECT x - 7 AS i, y - 5 AS j, path_index FROM omap WHERE x BETWEEN 7 AND 46 AND y BETWEEN 5 AND 24"""
)
def window_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cell.window(a.order_map(spark, sf_dir).select("x", "y", "path_index"), 7, 5, 40, 20)


def _project_sql(name: str, curve) -> str:
    """Nearest point of a curve as a join with its segments."""
    parts, done = [], 0.0
    lengths = [sum((q - p) ** 2 for p, q in zip(u, v, strict=True)) ** 0.5 for u, v in zip(curve, curve[1:], strict=False)]
    for k, (u, v, length) in enumerate(zip(curve, curve[1:], lengths, strict=False)):
        parts.append("(" + ", ".join(f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x) for x in (k, *u, *[q - p for p, q in zip(u, v, strict=True)], length, done)) + ")")
        done += length
    return f"""
{name}_seg AS (SELECT * FROM (VALUES {', '.join(parts)}) t(k, ar, ag, ab, dr, dg, db, len, done)),
{name}_at AS (
  SELECT vec_id, k, len, done, r, g, b, ar, ag, ab, dr, dg, db,
         least(greatest(((r - ar) * dr + (g - ag) * dg + (b - ab) * db) / (len * len), 0), 1) AS t FROM colours, {name}_seg
), {name} AS (
  SELECT vec_id, sqrt((r - ar - t * dr) ** 2 + (g - ag - t * dg) ** 2 + (b - ab - t * db) ** 2) AS distance, (done + t * len) / {done!r} AS position
  FROM {name}_at QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1
)"""


_BOTH = f"{COLOURS}, {_project_sql('water', OPEN_WATER)}, {_project_sql('solid', SOLID)}"


@query(f"WITH {_BOTH} SELECT vec_id, {sql6('distance')} AS distance, {sql6('position')} AS position FROM solid")
def polyline_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance, position = classify.project([F.col(c) for c in "rgb"], SOLID)
    out = a.colours(spark, sf_dir).select("vec_id", distance.alias("distance"), position.alias("position"))
    return rounded(out, "distance", "position")


_KIND = f"""
kinds AS (
  SELECT vec_id, CASE WHEN water.distance < 0.25 * 0.2 THEN 0 WHEN solid.distance < 0.1 THEN 2 ELSE 1 END AS kind,
         CASE WHEN water.distance < 0.05 THEN water.position ELSE solid.position END AS position, water.distance AS dw, solid.distance AS ds
  FROM water JOIN solid USING (vec_id)
)"""
#: Embeddings pulled towards the curves, so that every class occurs.
_PULLED = COLOURS.replace("colours AS", "raw AS") + """,
colours AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN r * 0.2 WHEN 1 THEN 0.7 + r * 0.15 ELSE r END AS r,
  CASE vec_id % 3 WHEN 0 THEN 0.02 + r * 0.2 WHEN 1 THEN 0.7 + r * 0.15 ELSE g END AS g,
  CASE vec_id % 3 WHEN 0 THEN 0.05 + r * 0.3 WHEN 1 THEN 0.71 + r * 0.15 ELSE b END AS b FROM raw)"""
_CLASSES = f"{_PULLED}, {_project_sql('water', OPEN_WATER)}, {_project_sql('solid', SOLID)}, {_KIND}"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, r = F.col("vec_id") % 3, F.col("r")

    def pulled(dark, light, own: str):
        return F.when(k == 0, dark).when(k == 1, light).otherwise(F.col(own))

    raw = a.colours(spark, sf_dir).select(
        "vec_id",
        pulled(r * 0.2, 0.7 + r * 0.15, "r").alias("r"),
        pulled(0.02 + r * 0.2, 0.7 + r * 0.15, "g").alias("g"),
        pulled(0.05 + r * 0.3, 0.71 + r * 0.15, "b").alias("b"),
    )
    return classify.classify(raw, OPEN_WATER, SOLID, scale=1.0)


@query(f"WITH {_CLASSES} SELECT vec_id, kind, {sql6('dw')} AS dw, {sql6('ds')} AS ds, {sql6('position')} AS position FROM kinds")
def classify_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_classified(spark, sf_dir).select("vec_id", "kind", "dw", "ds", "position"), "dw", "ds", "position")


@query(
    f"""WITH {_CLASSES}, t AS (
  SELECT *, CASE WHEN vec_id % 5 = 0 THEN -1 WHEN vec_id % 5 = 1 THEN 1002 ELSE 1000 END AS path_index, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0.8 ELSE 0.8 + 0.2 * position END AS thick FROM kinds
) SELECT vec_id, CASE WHEN path_index = -1 OR path_index > 1000 THEN 3 WHEN kind = 2 AND thick < 0.9 THEN 1 ELSE kind END AS ice_status, {sql6('thick')} AS ice_thickness FROM t"""
)
def ice_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id") % 5
    c = _classified(spark, sf_dir).withColumn("path_index", F.when(k == 0, -1).when(k == 1, 1002).otherwise(1000))
    return rounded(classify.thickness(c).select("vec_id", "ice_status", "ice_thickness"), "ice_thickness")


def _tones(name: str, c: int) -> str:
    return "[" + ", ".join(f"CAST({x[c]!r} AS DOUBLE)" for x in color.PALETTES[name]) + "]"


def _lookup_sql(name: str, v: str) -> tuple[str, str, str]:
    """Channels of a palette at v, by a list and its next entry."""
    last = len(color.PALETTES[name]) - 1
    at = f"(least(greatest({v}, 0), 1) * {last})"
    k = f"least(CAST(floor({at}) AS INTEGER), {last - 1})"
    out = []
    for c in range(3):
        tones = _tones(name, c)
        out.append(f"CAST(floor(({tones}[{k} + 1] + ({tones}[{k} + 2] - {tones}[{k} + 1]) * ({at} - {k})) * 255) AS INTEGER)")
    return tuple(out)


def _merge_sql(x: tuple[str, ...], y: tuple[str, ...], alpha: str) -> tuple[str, ...]:
    t = f"least(greatest({alpha}, 0), 1)"
    return tuple(f"CAST(floor(({p}) * (1 - {t}) + ({q}) * {t}) AS INTEGER)" for p, q in zip(x, y, strict=True))


_VALUES = "v AS (SELECT vec_id, least(greatest(CAST(embedding[1] AS DOUBLE) * 1.5 + 0.5, -1), 2) AS v FROM embeddings)"


@query(
    f"WITH {_VALUES} "
    + " UNION ALL ".join(
        f"SELECT vec_id, '{name}' AS palette, " + ", ".join(f"{e} AS {c}" for e, c in zip(_lookup_sql(name, "v"), "rgb", strict=True)) + " FROM v" for name in color.PALETTES
    )
)
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.least(F.greatest(F.element_at("embedding", 1).cast("double") * 1.5 + 0.5, F.lit(-1.0)), F.lit(2.0))
    base = a.table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    passes = [base.select("vec_id", F.lit(n).alias("palette"), *color.lookup(n, F.col("v")).named()) for n in color.PALETTES]
    return reduce(DataFrame.unionByName, passes)  # one for each palette: code for all in one would be too large to be compiled


@query(
    f"WITH {COLOURS}, c AS (SELECT vec_id, CAST(floor(r * 255) AS INTEGER) AS r, CAST(floor(g * 255) AS INTEGER) AS g, CAST(floor(b * 255) AS INTEGER) AS b, b * 1.4 - 0.2 AS t FROM colours) SELECT vec_id, "
    + ", ".join(f"{e} AS {c}" for e, c in zip(_merge_sql(tuple("rgb"), tuple(map(str, color.WATER)), "t"), "rgb", strict=True))
    + " FROM c"
)
def merge_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = a.colours(spark, sf_dir)
    whole = c.select("vec_id", *[F.floor(F.col(k) * 255).cast("int").alias(k) for k in "rgb"], (F.col("b") * 1.4 - 0.2).alias("t"))
    return whole.select("vec_id", *color.merge(color.rgb(), color.water(), F.col("t")).named())


@query(
    f"""WITH {_VALUES}, d AS (SELECT vec_id, least(greatest(v * 2 - 1, -1), 1) AS d FROM v)
SELECT vec_id, CAST(CASE WHEN d <= 0 THEN floor((1 + d) * 255) ELSE 255 END AS INTEGER) AS r, CAST(floor((1 - abs(d)) * 255) AS INTEGER) AS g,
       CAST(CASE WHEN d <= 0 THEN 255 ELSE floor((1 - d) * 255) END AS INTEGER) AS b FROM d"""
)
def diverging_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.least(F.greatest(F.element_at("embedding", 1).cast("double") * 1.5 + 0.5, F.lit(-1.0)), F.lit(2.0))
    return a.table(spark, sf_dir, "embeddings").select("vec_id", *color.diverging(v * 2 - 1).named())


_CATEGORY = "[" + ", ".join(f"[{r}, {g}, {b}]" for r, g, b in color.CATEGORIES) + "]"


@query(
    f"WITH {ORDER_MAP} SELECT x, y, "
    + ", ".join(f"{_CATEGORY}[(path_index + CASE WHEN path_index >= 1000 THEN 5 ELSE 0 END) % 20 + 1][{k + 1}] AS {c}" for k, c in enumerate("rgb"))
    + " FROM omap WHERE path_index <> -1"
)
def category_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.order_map(spark, sf_dir).where("path_index <> -1").select("x", "y", *color.category(F.col("path_index")).named())


_WATER = tuple(map(str, color.WATER))
_BASE = tuple(_blend(c, w) for c, w in zip("rgb", color.WATER, strict=True))
_SCALES = {"jpinv": 0.1, "ridges": 0.1, "p": 50000.0, "q": 10000.0, "speed": 0.05, "colors": 1.0}


def _frame_color_sql(variable: str) -> str:
    scale, mask = _SCALES[variable], "CAST(mask AS DOUBLE)"
    base = ("br", "bg", "bb")
    ground = _merge_sql(_WATER, base, mask)
    speed = f"(sqrt(zx * zx + zy * zy) / {scale})"
    if variable == "jpinv":
        out = _merge_sql(ground, _lookup_sql("Pressure", f"0.5 * (zj / {scale}) + 0.5"), f"abs(zj / {scale} * {mask})")
    elif variable == "ridges":
        out = _merge_sql(ground, _lookup_sql("Ridges", f"zj / {scale}"), f"CASE WHEN zj > 0 THEN {mask} * (zj / {scale}) ELSE 0 END")
    elif variable == "p":
        out = _merge_sql(_WATER, _lookup_sql("Pressure", f"0.5 * zp / {scale} + 0.5"), mask)
    elif variable == "q":
        out = _merge_sql(_WATER, _lookup_sql("ANSYS", f"zq / {scale}"), mask)
    elif variable == "speed":
        out = _merge_sql(_WATER, _merge_sql(base, _lookup_sql("ANSYS", speed), f"least({speed}, 1)"), mask)
    else:
        out = ground
    return f"SELECT i, j, '{variable}' AS variable, " + ", ".join(f"{e} AS {c}" for e, c in zip(out, "rgb", strict=True)) + " FROM shown"


def _zeroed(c: str, name: str, digits: int) -> str:
    return f"{sql6(f'CASE WHEN mask = 1 AND status = 100 THEN {c} ELSE 0 END', digits)} + {_NUDGE} AS {name}"


@query(
    f"WITH {PARTICLES}, {STENCIL}, {_FRAME}, {CELLS}, {_MASKED}, shown AS (SELECT i, j, mask, "
    + ", ".join([_zeroed("jpinv", "zj", 6), _zeroed("p", "zp", 3), _zeroed("q", "zq", 3), _zeroed("vx", "zx", 6), _zeroed("vy", "zy", 6)])
    + ", "
    + ", ".join(f"{e} AS {n}" for e, n in zip(_BASE, ("br", "bg", "bb"), strict=True))
    + " FROM masked) "
    + " UNION ALL ".join(_frame_color_sql(v) for v in color.FRAME_VARIABLES)
)
def frame_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields are rounded first, as truncated colours would show the order of summation."""
    shown = _masked(spark, sf_dir)
    digits = {"jpinv": 6, "p": 3, "q": 3, "vx": 6, "vy": 6}
    shown = shown.withColumns({n: F.round(n, d) + _NUDGE for n, d in digits.items()})
    return colouring.frame_colours(shown, {v: _SCALES[v] for v in color.FRAME_VARIABLES})


@query(
    f"""WITH {PARTICLES}, {STENCIL}, {_FRAME}, e AS (SELECT round(min(p), 3) AS low, round(max(p), 3) AS high FROM frame)
SELECT i, j, CAST(CASE WHEN high - low < 1e-9 THEN 0 ELSE round((round(p, 3) - low) * 4095 / (high - low)) END AS INTEGER) AS p, low + 0.0 AS low, high + 0.0 AS high FROM frame, e"""
)
def quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _frame(spark, sf_dir).select("i", "j", F.round("p", 3).alias("p"))
    return fields.quantise(frame, "p")


@query(
    f"""WITH {PARTICLES}, {STENCIL}, {_FRAME}, e AS (SELECT round(min(p), 3) AS low, round(max(p), 3) AS high FROM frame)
SELECT i, j, {sql6('low + CASE WHEN high - low < 1e-9 THEN 0 ELSE round((round(p, 3) - low) * 4095 / (high - low)) END * (high - low) / 4095', 3)} AS p FROM frame, e"""
)
def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.restore(quantize(spark, sf_dir), "p"), "p", digits=3)


def _diffusion_sql(n: int) -> str:
    """Steps one after another over a grid of every pixel up to the last row; pixels without an order are no part of it."""
    moved = ", ".join(
        f"CASE WHEN active THEN {v} + 0.02e0 * (CASE WHEN x + 1 < {MAP_WIDTH} THEN coalesce(lead({v}) OVER r, 0) ELSE {v} END + CASE WHEN x > 0 THEN coalesce(lag({v}) OVER r, 0) ELSE {v} END"
        f" + CASE WHEN y + 1 < height THEN coalesce(lead({v}) OVER c, 0) ELSE {v} END + CASE WHEN y > 0 THEN coalesce(lag({v}) OVER c, 0) ELSE {v} END - 4 * {v}) ELSE 0 END AS {v}"
        for v in ("vx", "vy")
    )
    steps = [
        f"d{k + 1} AS MATERIALIZED (SELECT x, y, height, known, active, {moved} FROM d{k} WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y))" for k in range(n)
    ]
    return f"""WITH {ORDER_MAP}, h AS (SELECT max(y) + 1 AS height FROM omap), every AS (
  SELECT CAST(range % {MAP_WIDTH} AS INTEGER) AS x, CAST(range // {MAP_WIDTH} AS INTEGER) AS y, height FROM h, range((SELECT height * {MAP_WIDTH} FROM h))
), d0 AS MATERIALIZED (
  SELECT x, y, height, path_index IS NOT NULL AS known, coalesce(path_index = 1000, FALSE) AS active, CASE WHEN path_index = 1000 THEN vx ELSE 0 END AS vx, CASE WHEN path_index = 1000 THEN vy ELSE 0 END AS vy
  FROM every LEFT JOIN omap USING (x, y)
), {', '.join(steps)} SELECT x, y, {sql6('vx')} AS vx, {sql6('vy')} AS vy FROM d{n} WHERE known"""


def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.order_map(spark, sf_dir).select("x", "y", (F.col("path_index") == cell.INTERIOR).alias("active"), "vx", "vy")


@query(_diffusion_sql(4))
def diffusion_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.diffuse(_flow(spark, sf_dir), 4, 0.02, MAP_WIDTH, a.map_height(spark, sf_dir)).drop("active"), "vx", "vy")


@query(_diffusion_sql(32))
def diffusion_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many steps, eight for each exchange of tiles."""
    return rounded(fields.diffuse_tiled(_flow(spark, sf_dir), 32, 0.02, MAP_WIDTH, a.map_height(spark, sf_dir), halo=8).drop("active"), "vx", "vy")


@query(f"WITH {ORDER_MAP} SELECT x, y, {sql6('sqrt(vx * vx + vy * vy)')} AS norm FROM omap")
def flow_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.with_norm(_flow(spark, sf_dir)).select("x", "y", "norm"), "norm")


_SEGMENTS = "seg AS (SELECT CAST(p_partkey AS INTEGER) AS seg, p_size AS x0, p_size + 2.5 AS x1, p_retailprice / 10 AS x2, p_size * 2 AS x3, p_retailprice / 20 AS y0, p_size * 1.5 AS y1, p_size + 7 AS y2, 40 - p_size AS y3 FROM part)"


@query(
    f"""WITH {_SEGMENTS}, k AS (SELECT seg.*, k, CAST(k AS DOUBLE) / 8 AS t FROM seg, (SELECT CAST(range AS INTEGER) AS k FROM range(9))), d AS (
  SELECT seg, k, x0 * (1 - t) ** 3 + 3 * x1 * t * (1 - t) ** 2 + 3 * x2 * t ** 2 * (1 - t) + x3 * t ** 3 AS x, y0 * (1 - t) ** 3 + 3 * y1 * t * (1 - t) ** 2 + 3 * y2 * t ** 2 * (1 - t) + y3 * t ** 3 AS y,
         3 * ((1 - t) ** 2 * (x1 - x0) + 2 * t * (1 - t) * (x2 - x1) + t ** 2 * (x3 - x2)) AS sx, 3 * ((1 - t) ** 2 * (y1 - y0) + 2 * t * (1 - t) * (y2 - y1) + t ** 2 * (y3 - y2)) AS sy FROM k
) SELECT seg, k, {sql6('x', 11)} AS x, {sql6('y', 11)} AS y, {sql6('coalesce(sx / nullif(sqrt(sx * sx + sy * sy), 0), 0)')} AS tx, {sql6('coalesce(sy / nullif(sqrt(sx * sx + sy * sy), 0), 0)')} AS ty FROM d"""
)
def bezier_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    seg = a.table(spark, sf_dir, "part").select(
        F.lit(0).alias("path"), F.col("p_partkey").cast("int").alias("seg"),
        s.alias("x0"), (s + 2.5).alias("x1"), (r / 10).alias("x2"), (s * 2).alias("x3"),
        (r / 20).alias("y0"), (s * 1.5).alias("y1"), (s + 7).alias("y2"), (40 - s).alias("y3"),
    )
    return rounded(rounded(raster.sample_curves(seg, 8).drop("path", "steps"), "x", "y", digits=11), "tx", "ty")


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    return a.table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 40).cast("int").alias("path"), F.col("p_partkey").cast("int").alias("seg"),
        s.alias("x0"), (s + 2.5).alias("x1"), (r / 10).alias("x2"), (s * 2).alias("x3"),
        (r / 20).alias("y0"), (s * 1.5).alias("y1"), (s + 7).alias("y2"), (40 - s).alias("y3"),
    )


def _bezier_sql(c: str) -> str:
    s = "(1 - t)"
    return f"{s} * {s} * {s} * {c}0 + 3 * {s} * {s} * t * {c}1 + 3 * {s} * t * t * {c}2 + t * t * t * {c}3"


_LEAPS = ", ".join(f"abs({c}{k + 1} - {c}{k})" for c in "xy" for k in range(3))


@query(
    f"""WITH {_SEGMENTS}, n AS (SELECT *, seg % 40 AS path, greatest(CAST(ceil(3 * greatest({_LEAPS})) AS INTEGER), 1) AS steps FROM seg),
k AS (SELECT *, CAST(k AS DOUBLE) / steps AS t FROM (SELECT *, CAST(unnest(range(0, steps + 1)) AS INTEGER) AS k FROM n)),
px AS (SELECT path, seg, k, CAST(floor({_bezier_sql('x')}) AS INTEGER) AS x, CAST(floor({_bezier_sql('y')}) AS INTEGER) AS y FROM k),
b AS (SELECT *, lag(x) OVER o AS bx, lag(y) OVER o AS by_ FROM px WINDOW o AS (PARTITION BY path ORDER BY seg, k))
SELECT path, seg, k, x, y FROM b WHERE bx IS NULL OR x <> bx OR y <> by_"""
)
def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.outline(_curves(spark, sf_dir))


_FILLED = """
crossed AS (  -- where an edge crosses a row, and the pixels of the path's box on that row
  SELECT e.path, y, xa + (y + 0.5e0 - ya) * (xb - xa) / CAST(yb - ya AS DOUBLE) AS spot, sign(yb - ya) AS turn
  FROM (SELECT *, unnest(range(least(ya, yb), greatest(ya, yb))) AS y FROM edges WHERE ya <> yb) e
), across AS (
  SELECT path, y, unnest(range(low, high + 1)) AS x FROM (SELECT path, y, CAST(floor(min(spot)) AS BIGINT) AS low, CAST(ceil(max(spot)) AS BIGINT) AS high FROM crossed GROUP BY path, y)
), filled AS (  -- the winding number of each pixel: crossings at or left of it on its row
  SELECT p.path, CAST(p.x AS INTEGER) AS x, CAST(p.y AS INTEGER) AS y FROM across p JOIN crossed c USING (path, y) GROUP BY p.path, p.x, p.y
  HAVING sum(CASE WHEN spot < p.x THEN turn ELSE 0 END) <> 0 OR bool_or(spot = p.x)
)"""


@query(f"WITH {POLYGON_SQL}, {_FILLED} SELECT path, x, y FROM filled")
def scanline_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.filled(a.polygons(spark, sf_dir))


_CANDIDATES = "cand AS (SELECT x, y, path, FALSE AS boundary FROM filled UNION ALL SELECT x, y, path, TRUE FROM poly)"
_PRECEDENCE = """
pidx AS (
  SELECT x, y, coalesce(max(path) FILTER (WHERE boundary), 1000 + min(path) FILTER (WHERE NOT boundary AND path > 0), 1000) AS path_index FROM cand GROUP BY x, y
)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    poly = a.polygons(spark, sf_dir)
    inner = raster.filled(poly).select("x", "y", "path", F.lit(False).alias("boundary"))
    return inner.unionByName(poly.select("x", "y", "path", F.lit(True).alias("boundary")))


@query(f"WITH {POLYGON_SQL}, {_FILLED}, {_CANDIDATES}, {_PRECEDENCE} SELECT x, y, CAST(path_index AS INTEGER) AS path_index FROM pidx")
def fill_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.fill_precedence(_candidates(spark, sf_dir))


#: The canvas of the polygons' rows: as wide as eight of them, and so high that the topmost are cut off.
_CANVAS = (230, 20_000)


@query(
    f"""WITH {POLYGON_SQL}, {_FILLED}, {_CANDIDATES}, {_PRECEDENCE}, box AS (
  SELECT greatest(min(x) - 2, 0) AS ox, greatest(min(y) - 2, 0) AS oy, least(max(x) + 2, {_CANVAS[0] - 1}) AS x1, least(max(y) + 2, {_CANVAS[1] - 1}) AS y1 FROM pidx WHERE path_index <> -1
) SELECT ox, oy, x1 - ox + 1 AS gx, y1 - oy + 1 AS gy FROM box"""
)
def bounding_box_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.bounding_box(raster.fill_precedence(_candidates(spark, sf_dir)), *_CANVAS)


@query(f"WITH {POLYGON_SQL} SELECT path, sum(xa * yb - xb * ya) / CAST(2 AS DOUBLE) AS area FROM edges GROUP BY path")
def shoelace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.signed_area(a.polygons(spark, sf_dir))


@query(
    """SELECT CASE n_nationkey WHEN 7 THEN 0 WHEN 0 THEN 7 ELSE n_nationkey END AS path, n_name AS name, n_nationkey = 7 AS is_main FROM nation WHERE n_regionkey <> 4 OR n_nationkey = 7"""
)
def main_path_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = a.table(spark, sf_dir, "nation")
    paths = nation.select(F.col("n_nationkey").alias("path"), F.col("n_name").alias("name"), ((F.col("n_regionkey") != 4) | (F.col("n_nationkey") == 7)).alias("closed"))
    return raster.main_first(raster.closed_only(paths), F.col("path") == 7).select("path", "name", "is_main")


@query(
    """SELECT event_id, strftime(to_timestamp(1717988400 + CAST(floor(value * 1000) AS BIGINT)) AT TIME ZONE 'UTC', '%d-%m-%Y %H:%M:%S') || ' UTC' AS label,
  'f' || lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS frame_name, 's' || lpad(CAST(user_id % 100000 AS VARCHAR), 5, '0') AS snapshot_name FROM events"""
)
def frame_time_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        naming.time_label(F.lit(1717988400), F.col("value") * 1000).alias("label"),
        naming.frame_name(F.col("event_id") % 100000).alias("frame_name"),
        naming.snapshot_name(F.col("user_id") % 100000).alias("snapshot_name"),
    )


@query(
    """WITH e AS (SELECT CAST(floor(epoch(ts) / 43200) - 19723 * 2 AS INTEGER) AS frame, CAST(user_id % 7 AS INTEGER) AS region, value FROM events),
f AS (SELECT frame, region, sum(value) AS fx, sum(-value / 2) AS fy FROM e GROUP BY frame, region),
g AS (SELECT CAST(frame AS INTEGER) AS frame, CAST(region AS INTEGER) AS region FROM (SELECT unnest(range(0, (SELECT max(frame) + 1 FROM f))) AS frame), (SELECT range AS region FROM range(10)))
SELECT frame, region, """
    + f"{sql6('coalesce(fx, 0)', 4)} AS fx, {sql6('coalesce(fy, 0)', 4)} AS fy FROM g LEFT JOIN f USING (frame, region)"
)
def force_series_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    forces = a.table(spark, sf_dir, "events").select(
        (F.floor(F.unix_timestamp("ts") / 43200) - 19723 * 2).cast("int").alias("frame"),
        (F.col("user_id") % 7).cast("int").alias("region"),
        F.col("value").alias("fx"),
        (-F.col("value") / 2).alias("fy"),
    )
    return rounded(frames.force_series(forces, 10), "fx", "fy", digits=4)


@query(
    """WITH t AS (SELECT o_orderkey AS cell_id, [o_custkey % 50, o_custkey % 50 + 1, o_orderkey % 50] AS nodes, o_totalprice AS u FROM orders),
n AS (SELECT unnest(nodes) AS node_id, u FROM t) SELECT node_id, """
    + f"{sql6('avg(u)', 4)} AS u FROM n GROUP BY node_id"
)
def mesh_point_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders")
    c, k = F.col("o_custkey") % 50, F.col("o_orderkey") % 50
    mesh = o.select(F.col("o_orderkey").alias("cell_id"), F.array(c, c + 1, k).alias("nodes"))
    values = o.select(F.col("o_orderkey").alias("cell_id"), F.col("o_totalprice").alias("u"))
    return rounded(fields.cell_to_point(mesh, values, ["u"]), "u", digits=4)


@query(
    f"""WITH {CELLS}, t AS (
  SELECT c_custkey AS cell_id, c_custkey * 7 % 100 AS ax, c_custkey * 5 % 40 AS ay, c_custkey * 7 % 100 + 9 AS bx, c_custkey * 5 % 40 + 2 AS by_, c_custkey * 7 % 100 + 3 AS cx, c_custkey * 5 % 40 + 8 AS cy, c_acctbal AS s FROM customer
), b AS (
  SELECT t.*, i AS x, j AS y, ((by_ - cy) * (i - cx) + (cx - bx) * (j - cy)) / CAST((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS DOUBLE) AS u,
         ((cy - ay) * (i - cx) + (ax - cx) * (j - cy)) / CAST((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS DOUBLE) AS v FROM t, cells
) SELECT x, y, {sql6('u * s + v * s * 2 + (1 - u - v) * (s + 100)', 4)} AS s FROM b WHERE u >= 0 AND v >= 0 AND 1 - u - v >= 0 QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY cell_id) = 1"""
)
def mesh_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    px, py = (k * 7 % 100).cast("int"), (k * 5 % 40).cast("int")
    t = a.table(spark, sf_dir, "customer").select(
        k.alias("cell_id"), px.alias("ax"), py.alias("ay"), (px + 9).alias("bx"), (py + 2).alias("by"), (px + 3).alias("cx"), (py + 8).alias("cy"),
        F.col("c_acctbal").alias("a_s"), (F.col("c_acctbal") * 2).alias("b_s"), (F.col("c_acctbal") + 100).alias("c_s"),
    )
    return rounded(fields.probe(t, GX, GY, ["s"]), "s", digits=4)


@query(
    """SELECT k AS cell_id, CAST(c_nationkey AS INTEGER) AS zone, 3 AS type, concat_ws(' ', k * 4 + 2, k * 4 + 3, k * 4, k * 4 + 1) AS nodes
FROM (SELECT *, c_custkey + 1 AS k FROM customer) WHERE c_nationkey <> 7"""
)
def mesh_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quadrilateral for each customer, from edges in mixed order and direction; those of nation 7 are refined away."""
    c = a.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).cast("long").alias("k"), F.col("c_nationkey").alias("zone"))
    corner = [F.col("k") * 4 + n for n in range(4)]
    edges = [(corner[2], corner[3], True), (corner[1], corner[0], False), (corner[0], corner[3], False), (corner[1], corner[2], True)]
    none = F.lit(0).cast("long")
    faces = c.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        (F.col("k") * 4 + at).alias("face_id"), F.array(x, y).alias("nodes"),
                        (F.col("k") if mine else none).alias("c0"), (none if mine else F.col("k")).alias("c1"),
                    )
                    for at, (x, y, mine) in enumerate(edges)
                ]
            )
        )
    )
    cells = c.select(F.col("k").alias("cell_id"), F.col("zone").cast("int").alias("zone"), F.lit(3).alias("type"))
    whole = mesh.require_complete(mesh.cells_from_faces(faces, cells, cells.where("zone = 7")))
    return whole.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), " "))


@query(
    f"""WITH {CELLS}, q AS (SELECT c_custkey AS cell_id, c_custkey * 7 % 100 AS x, c_custkey * 5 % 40 AS y, c_acctbal AS s FROM customer),
t AS (
  SELECT cell_id, x AS ax, y AS ay, x + 9 AS bx, y + 1 AS by_, x + 8 AS cx, y + 6 AS cy, s AS sa, s * 2 AS sb, s + 100 AS sc FROM q
  UNION ALL SELECT cell_id, x, y, x + 8, y + 6, x + 1, y + 7, s, s + 100, s - 50 FROM q
), b AS (
  SELECT t.*, i AS x, j AS y, ((by_ - cy) * (i - cx) + (cx - bx) * (j - cy)) / CAST((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS DOUBLE) AS u,
         ((cy - ay) * (i - cx) + (ax - cx) * (j - cy)) / CAST((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy) AS DOUBLE) AS v FROM t, cells
) SELECT x, y, {sql6('any_value(u * sa + v * sb + (1 - u - v) * sc)', 4)} AS s FROM b WHERE u >= 0 AND v >= 0 AND 1 - u - v >= 0
GROUP BY x, y, cell_id QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY cell_id) = 1"""
)
def mesh_probe_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of quadrilaterals at pixels, each as a fan of triangles."""
    k = F.col("c_custkey")
    c = a.table(spark, sf_dir, "customer").select(k.alias("cell_id"), (k * 7 % 100).alias("x"), (k * 5 % 40).alias("y"), F.col("c_acctbal").alias("s"))
    s, corners = F.col("s"), ((0, 0), (9, 1), (8, 6), (1, 7))
    values = (s, s * 2, s + 100, s - 50)
    nodes = c.select(
        F.inline(
            F.array(
                *[
                    F.struct((F.col("cell_id") * 4 + n).alias("node_id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), v.alias("s"))
                    for n, ((dx, dy), v) in enumerate(zip(corners, values, strict=True))
                ]
            )
        )
    )
    quads = c.select("cell_id", F.array(*[F.col("cell_id") * 4 + n for n in range(4)]).alias("nodes"))
    return rounded(fields.probe(mesh.triangles(quads, nodes, ["s"]), GX, GY, ["s"]), "s", digits=4)


@query(
    f"""WITH {ORDER_MAP} SELECT CAST(count(*) FILTER (WHERE vx * 3 + 0.5e0 <> 0) AS BIGINT) AS nonzero,
  {sql6('min(vx * 3 + 0.5e0)')} AS low_x, {sql6('max(vx * 3 + 0.5e0)')} AS high_x, {sql6('min(vy * 3 - 1)')} AS low_y, {sql6('max(vy * 3 - 1)')} AS high_y FROM omap"""
)
def require_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes scaled, then shifted, how many have an x other than 0, and where they lie."""
    moved = fields.transform_mesh(a.order_map(spark, sf_dir).select(F.col("vx").alias("x"), F.col("vy").alias("y")), 3.0, 0.5, -1.0)
    ends = moved.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))])
    return rounded(fields.require_nonzero(moved, "x").join(F.broadcast(ends)), *ends.columns)  # aggregates without keys: one row each


_U32 = 4294967296


def _hash_sql(seed: str) -> str:
    prime = f"CAST(2654435769 AS HUGEINT)"
    return f"""
h1 AS (SELECT *, CAST(xor({seed}, 12345391) * {prime} % {_U32} AS BIGINT) AS i FROM t),
h2 AS (SELECT * EXCLUDE (i), xor(i, xor((i << 6) % {_U32}, i >> 26)) AS i FROM h1),
h3 AS (SELECT * EXCLUDE (i), CAST(i * {prime} % {_U32} AS BIGINT) AS i FROM h2),
h4 AS (SELECT * EXCLUDE (i), (i + xor((i << 5) % {_U32}, i >> 12)) % {_U32} AS hash FROM h3)"""


@query(f"WITH t AS (SELECT o_orderkey, o_orderkey % {_U32} AS seed FROM orders), {_hash_sql('seed')} SELECT o_orderkey, hash, {sql6('hash / 4294967295.0')} AS u FROM h4")
def hash_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = a.table(spark, sf_dir, "orders").select("o_orderkey")
    return rounded(o.select("o_orderkey", naming.integer_hash(F.col("o_orderkey")).alias("hash"), naming.uniform(F.col("o_orderkey")).alias("u")), "u")


@query(
    f"""WITH {ORDER_MAP} SELECT x, y, CASE WHEN path_index = 1000 THEN 21 ELSE r END AS r, CASE WHEN path_index = 1000 THEN 31 ELSE g END AS g, CASE WHEN path_index = 1000 THEN 47 ELSE b END AS b
FROM omap"""
)
def water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = a.order_map(spark, sf_dir).withColumn("status", cell.status_of(F.col("path_index")))
    return color.fill_water(pixels).select("x", "y", *"rgb")


@query(None)
def poisson_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point a cell, about, over the map's grid, and of these the ones in modelled cells; their least distance is tested."""
    modelled = a.order_map(spark, sf_dir).where(F.col("path_index") == cell.INTERIOR).select(F.col("x").alias("ci"), F.col("y").alias("cj"))
    return sampling.sample_grid(spark, MAP_WIDTH, a.map_height(spark, sf_dir), per_cell=1).join(modelled, ["ci", "cj"], "left_semi")
