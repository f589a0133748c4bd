"""Registered queries over images: frames, running state, prepared maps and colour bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..operators import colouring, nodes, scatter
from . import adapters as a
from .adapters import CELLS, IMAGE, MAP_PX, ORDER_MAP, PARTICLES, PRM, STENCIL, sql6
from .field_queries import _BASE, _FRAME, _MASKED, _NUDGE, _lookup_sql, _masked, _merge_sql, _zeroed
from .particle_queries import _GRID, _MOMENTUM, _NODES, _TAU

QUERIES = {}
ORACLES = {}

_WATER = tuple(map(str, color.WATER))
_BACK = ("r", "g", "b")


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _tuples(rows: list[tuple[str, str, tuple[str, ...]]], key: str, name: str, table: str, back: tuple[str, ...] | None = None) -> str:
    """One SELECT for each (label, condition, colours); elsewhere the background."""
    out = []
    for label, where, colours in rows:
        shown = colours if back is None else [f"CASE WHEN {where} THEN {c} ELSE {b} END" for c, b in zip(colours, back, strict=True)]
        out.append(f"SELECT {key}, '{label}' AS {name}, " + ", ".join(f"CAST({e} AS INTEGER) AS {c}" for e, c in zip(shown, "rgb", strict=True)) + f" FROM {table}")
    return " UNION ALL ".join(out)


def _frame_sql(variable: str, scale: float, base: tuple[str, ...]) -> tuple[str, ...]:
    ground, mask = _merge_sql(_WATER, base, "mask"), "mask"
    speed = f"(sqrt(zx * zx + zy * zy) / {scale!r})"
    return {
        "jpinv": lambda: _merge_sql(ground, _lookup_sql("Pressure", f"0.5 * (zj / {scale!r}) + 0.5"), f"abs(zj / {scale!r} * mask)"),
        "ridges": lambda: _merge_sql(ground, _lookup_sql("Ridges", f"zj / {scale!r}"), f"CASE WHEN zj > 0 THEN mask * (zj / {scale!r}) ELSE 0 END"),
        "p": lambda: _merge_sql(_WATER, _lookup_sql("Pressure", f"0.5 * zp / {scale!r} + 0.5"), mask),
        "q": lambda: _merge_sql(_WATER, _lookup_sql("ANSYS", f"zq / {scale!r}"), mask),
        "speed": lambda: _merge_sql(_WATER, _merge_sql(base, _lookup_sql("ANSYS", speed), f"least({speed}, 1)"), mask),
        "colors": lambda: ground,
    }[variable]()


#: Fields of a frame are rounded first, as truncated colours would show the order of summation.
_DIGITS = {"jpinv": 6, "p": 3, "q": 3, "vx": 6, "vy": 6}
_SHOWN = (
    "shown AS (SELECT i, j, CAST(mask AS DOUBLE) AS mask, "
    + ", ".join(_zeroed(c, z, _DIGITS[c]) for c, z in (("jpinv", "zj"), ("p", "zp"), ("q", "zq"), ("vx", "zx"), ("vy", "zy")))
    + ", "
    + ", ".join(f"{e} AS {n}" for e, n in zip(_BASE, ("br", "bg", "bb"), strict=True))
    + ", density FROM masked)"
)


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir).withColumns({n: F.round(n, d) + _NUDGE for n, d in _DIGITS.items()})


_FRAME_SCALES = {"jpinv": -1.0, "ridges": -1.0, "p": 5.0, "q": 4.0, "speed": -1.0, "colors": 0.0}
_PIXELS = f"""
pixels AS (
  SELECT image.x, image.y, image.r, image.g, image.b, path_index, coalesce(mask, 0) AS mask, coalesce(zj, 0) AS zj, coalesce(zp, 0) AS zp, coalesce(zq, 0) AS zq,
         coalesce(zx, 0) AS zx, coalesce(zy, 0) AS zy, coalesce(br, {_WATER[0]}) AS br, coalesce(bg, {_WATER[1]}) AS bg, coalesce(bb, {_WATER[2]}) AS bb
  FROM image LEFT JOIN map_px USING (x, y) LEFT JOIN shown ON shown.i + 3 = image.x AND shown.j + 2 = image.y
)"""


@query(
    f"WITH {PARTICLES}, {STENCIL}, {_FRAME}, {CELLS}, {IMAGE}, {MAP_PX}, {_MASKED}, {_SHOWN}, {_PIXELS} "
    + _tuples([(v, "path_index = 1000", _frame_sql(v, 10.0**e, ("br", "bg", "bb"))) for v, e in _FRAME_SCALES.items()], "x, y", "variable", "pixels", _BACK)
)
def frame_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames over the background image where the path index says so; the grid's corner is at (3, 2)."""
    return colouring.frame_image(_shown(spark, sf_dir), a.map_px(spark), a.image(spark), _FRAME_SCALES, 3, 2)


_GRID_SCALES = {
    "v_norm": -1.0, "v_u": -1.0, "v_v": -1.0, "grid_mass": 8.0, "grid_pointdensity": 0.0, "grid_colors": 0.0, "grid_Jpinv": -1.0,
    "grid_P": 5.0, "grid_Q": 4.0, "grid_vnorm": -1.0, "regions": 0.0, "grid_force": 7.0, "Jp_inv": 0.0,
}


def _grid_sql() -> str:
    s = {k: 10.0**e for k, e in _GRID_SCALES.items()}
    inside, outside, base = "status = 100", "status <> 100", ("br", "bg", "bb")
    rows = [
        ("v_norm", inside, _lookup_sql("ANSYS", f"sqrt(cvx * cvx + cvy * cvy) / {s['v_norm']!r}")),
        ("v_u", inside, _lookup_sql("ANSYS", f"cvx / {s['v_u']!r} + 0.5")),
        ("v_v", inside, _lookup_sql("ANSYS", f"cvy / {s['v_v']!r} + 0.5")),
        ("grid_mass", inside, _lookup_sql("P2", f"mass / {s['grid_mass']!r}")),
        ("grid_pointdensity", inside, _lookup_sql("ANSYS", f"density / 5 / {s['grid_pointdensity']!r}")),
        ("grid_colors", inside, base),
        ("grid_Jpinv", inside, _frame_sql("jpinv", s["grid_Jpinv"], base)),
        ("grid_P", inside, _frame_sql("p", s["grid_P"], base)),
        ("grid_Q", inside, _frame_sql("q", s["grid_Q"], base)),
        ("grid_vnorm", inside, _frame_sql("speed", s["grid_vnorm"], base)),
        ("regions", outside, _lookup_sql("Pastel", "status % 13 / CAST(12 AS DOUBLE)")),
        ("grid_force", outside, _lookup_sql("ANSYS", f"sqrt(fx * fx + fy * fy) / {s['grid_force']!r}")),
        ("Jp_inv", "FALSE", base),
    ]
    return _tuples(rows, "x, y", "option", "state", _BACK)


_STATE = f"""
state AS (
  SELECT x, y, image.r, image.g, image.b, cells.status, cells.cvx, cells.cvy, coalesce(shown.mask, 0) AS mask, coalesce(zj, 0) AS zj, coalesce(zp, 0) AS zp, coalesce(zq, 0) AS zq, coalesce(zx, 0) AS zx, coalesce(zy, 0) AS zy,
         coalesce(br, {_WATER[0]}) AS br, coalesce(bg, {_WATER[1]}) AS bg, coalesce(bb, {_WATER[2]}) AS bb, {sql6('coalesce(density, 0)')} + {_NUDGE} AS density,
         {sql6('coalesce(nodes.mass, 0)', 0)} AS mass, {sql6('coalesce(nodes.fx, 0)', -4)} AS fx, {sql6('coalesce(nodes.fy, 0)', -4)} AS fy
  FROM image JOIN cells ON x = cells.i AND y = cells.j LEFT JOIN shown ON x = shown.i AND y = shown.j LEFT JOIN nodes ON x = nodes.i AND y = nodes.j
)"""


@query(f"WITH {PARTICLES}, {_TAU}, {_MOMENTUM}, {_GRID}, {CELLS}, {_NODES}, {_FRAME}, {IMAGE}, {_MASKED}, {_SHOWN}, {_STATE} {_grid_sql()}")
def live_grid_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a running model shows of its grid, for every option, one of the points' included."""
    shown = _shown(spark, sf_dir)
    updated = nodes.update_nodes(scatter.particles_to_grid(a.particles(spark, sf_dir), PRM), a.cells(spark), PRM, 3600.0).drop("vx", "vy", "status")
    full = a.cells(spark).join(shown, ["i", "j"], "left").join(updated, ["i", "j"], "left")
    digits = {"mass": 0, "fx": -4, "fy": -4}
    full = full.withColumns(
        {
            **{c: F.round(F.coalesce(c, F.lit(0.0)), n) for c, n in digits.items()},
            **{c: F.coalesce(c, F.lit(0.0)) for c in _DIGITS},
            **{c: F.coalesce(c, F.lit(w)) for c, w in zip("rgb", color.WATER, strict=True)},
            "mask": F.coalesce("mask", F.lit(0)),
            "density": F.round(F.coalesce("density", F.lit(0.0)), 6) + _NUDGE,
        }
    )
    return colouring.grid_images(full, a.image(spark), _GRID_SCALES)


_POINT_SCALES = {
    "none": 0.0, "regions": 0.0, "color": 0.0, "status": 0.0, "Jp_inv": 0.0, "ridges": 0.0, "P": 5.0, "Q": 4.0, "thickness": 0.0, "partitions": 0.0, "grid_P": 0.0,
}


def _points_sql() -> str:
    s, own = {k: 10.0**e for k, e in _POINT_SCALES.items()}, ("r", "g", "b")

    def leaning(palette: str, value: str, scale: float) -> tuple[str, ...]:
        return _merge_sql(own, _lookup_sql(palette, f"{value} / {scale!r} + 0.5"), f"abs({value}) / {scale!r}")

    plain = tuple(map(str, colouring.PLAIN_POINT))
    rows = [
        ("none", "", plain),
        ("regions", "", plain),
        ("color", "", own),
        ("status", "", _lookup_sql("NCD", "CASE WHEN disabled THEN CAST(1 AS DOUBLE) WHEN crushed THEN 0.5 ELSE 0 END")),
        ("Jp_inv", "", leaning("Pressure", "(jp_inv - 1)", s["Jp_inv"])),
        ("ridges", "", _merge_sql(own, _lookup_sql("Ridges", f"(jp_inv - 1) / {s['ridges']!r}"), "CASE WHEN jp_inv > 1 THEN 1.0 ELSE 0 END")),
        ("P", "", leaning("Pressure", "p", s["P"])),
        ("Q", "", leaning("P2", "q", s["Q"])),
        ("thickness", "", _lookup_sql("ANSYS", "(thickness - CAST(0.8 AS DOUBLE)) / CAST(0.2 AS DOUBLE)")),
        ("partitions", "", _lookup_sql("NCD", "part / CAST(8 AS DOUBLE)")),
        ("grid_P", "", ("NULL", "NULL", "NULL")),
    ]
    return _tuples(rows, "okey, line", "option", "pp")


@query(f"WITH {PARTICLES}, pp AS (SELECT *, CAST(okey % 8 AS INTEGER) AS part FROM p) {_points_sql()}")
def live_point_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a running model shows of its points, for every option, one of the grid's included."""
    points = a.particles(spark, sf_dir).withColumn("part", (F.col("okey") % 8).cast("int"))
    return colouring.point_colours(points, ["okey", "line"], _POINT_SCALES)


def _diverging_sql(value: str) -> tuple[str, ...]:
    d = f"least(greatest({value}, -1), 1)"
    fading = f"CAST(floor((1 - abs({d})) * 255) AS INTEGER)"
    return (f"CASE WHEN {d} <= 0 THEN {fading} ELSE 255 END", fading, f"CASE WHEN {d} <= 0 THEN 255 ELSE {fading} END")


#: Twenty colours of path indices.
_CATEGORY = (
    "[[255, 87, 51], [46, 204, 113], [52, 152, 219], [155, 89, 182], [241, 196, 15], [231, 76, 60], [26, 188, 156], [52, 73, 94], [46, 204, 64], [142, 68, 173],"
    " [230, 126, 34], [44, 62, 80], [39, 174, 96], [192, 57, 43], [41, 128, 185], [243, 156, 18], [22, 160, 133], [189, 195, 199], [211, 84, 0], [127, 140, 141]]"
)


def _map_sql() -> str:
    category = tuple(f"{_CATEGORY}[(path_index + CASE WHEN path_index >= 1000 THEN 5 ELSE 0 END) % 20 + 1][{k}]" for k in (1, 2, 3))
    speed = _diverging_sql("sqrt(vx * vx + vy * vy) * 4")
    either = tuple(f"CASE WHEN path_index = 1000 THEN {v} ELSE {c} END" for v, c in zip(speed, category, strict=True))
    t = "least(greatest((ice_thickness - CAST(0.8 AS DOUBLE)) / (CAST(1 AS DOUBLE) - CAST(0.8 AS DOUBLE)), 0), 1)"
    ice = _merge_sql(("255", "0", "0"), ("255", "255", "255"), t)
    tones = tuple(
        f"CASE ice_status WHEN 0 THEN {w} WHEN 1 THEN {c} WHEN 2 THEN {i} ELSE 0 END" for w, c, i in zip((0, 0, 139), (0, 128, 0), ice, strict=True)
    )
    any_path = "path_index <> -1"
    rows = [
        ("boundaries", any_path, category),
        ("speed", any_path, either),
        ("vx", any_path, _diverging_sql("vx / CAST(0.25 AS DOUBLE)")),
        ("vy", any_path, _diverging_sql("vy / CAST(0.25 AS DOUBLE)")),
        ("thickness", "path_index = 1000", tones),
    ]
    return _tuples(rows, "x, y", "option", "prepared", _BACK)


@query(
    f"WITH {ORDER_MAP}, prepared AS (SELECT * FROM omap) {_map_sql()}"
)
def map_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the preparation shows of a map: boundaries, flow and ice."""
    whole = a.order_map(spark, sf_dir)
    return colouring.map_images(whole.drop("r", "g", "b"), whole.select("x", "y", "r", "g", "b"))


def _bars_sql() -> str:
    out = []
    for name, colours in color.PALETTES.items():
        last = len(colours) - 1
        at = f"(CAST(entry AS DOUBLE) / CAST(255 AS DOUBLE) * {last})"
        low = f"CAST(least(floor({at}), {last - 1}) AS INTEGER)"
        tones = ["[" + ", ".join(f"CAST({x[c]!r} AS DOUBLE)" for x in colours) + "]" for c in range(3)]
        mixed = [sql6(f"(1 - ({at} - {low})) * {t}[{low} + 1] + ({at} - {low}) * {t}[{low} + 2]") for t in tones]
        out.append(f"SELECT vec_id, entry, '{name}' AS palette, " + ", ".join(f"{e} AS {c}" for e, c in zip(mixed, "rgb", strict=True)) + " FROM bar")
    return "WITH bar AS (SELECT vec_id, least(greatest(CAST(floor((CAST(embedding[1] AS DOUBLE) + 0.5e0) * 256) AS BIGINT), 0), 255) AS entry FROM embeddings) " + " UNION ALL ".join(out)


@query(_bars_sql())
def color_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of a value in a bar of 256 colours from end to end of every palette, looked up in the bars' table."""
    bars = colouring.colour_bars(spark.range(color.BAR).withColumnRenamed("id", "entry"))
    entry = F.floor((F.element_at("embedding", 1).cast("double") + 0.5) * color.BAR)
    values = a.table(spark, sf_dir, "embeddings").select("vec_id", F.least(F.greatest(entry, F.lit(0)), F.lit(color.BAR - 1)).alias("entry"))
    found = values.join(F.broadcast(bars), "entry")  # BAR rows for each palette
    return found.select("vec_id", "entry", "palette", *[F.round(c, 6).alias(c) for c in "rgb"])
