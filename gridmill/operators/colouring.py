"""Images of frames, of the running state and of prepared maps, each by the name of what it shows.

An image is (x, y, r, g, b). Rules are tables from a name to colours and to
the condition under which they apply; elsewhere the background shows. Scales
are powers of ten, given by their exponent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MODELLED
from ..functions.color import BAR, PALETTES, WATER, Blend, Rgb, category, diverging, frame_blend, frame_color, merge, rgb, water
from ..plans.lineage import cut

#: Path index of the pixels on which a frame is shown.
SHOWN_PATH = 1000
#: Points in a full cell, colour of points without a variable, and the colours of ice.
FULL_CELL = 5
PLAIN_POINT = (240, 122, 122)
OPEN_WATER, CRUSHED_ICE, THIN_ICE, THICK_ICE = (0, 0, 139), (0, 128, 0), (255, 0, 0), (255, 255, 255)

#: A rule: the colours, and where they apply, for a scale.
Rule = tuple[Callable[[float], Rgb], Callable[[], Column]]


def scale_of(exponent: float) -> float:
    return 10.0**exponent


def colour_bars(bars: DataFrame, palettes: tuple[str, ...] = tuple(PALETTES), size: int = BAR) -> DataFrame:
    """(palette, entry, r, g, b) for bars(entry), entries 0 to size - 1; channels from 0 to 1."""
    rows = []
    for name in palettes:
        last = len(PALETTES[name]) - 1
        at = F.col("entry") / F.lit(float(size - 1)) * last
        low = F.least(F.floor(at), F.lit(last - 1)).cast("int")

        def channel(c: int, name=name, at=at, low=low) -> Column:
            tones = F.array(*[F.lit(float(x[c])) for x in PALETTES[name]])
            return (1 - (at - low)) * F.element_at(tones, low + 1) + (at - low) * F.element_at(tones, low + 2)

        rows.append(F.struct(F.lit(name).alias("palette"), *[channel(c).alias(n) for c, n in enumerate("rgb")]))
    return bars.select("entry", F.inline(F.array(*rows)))


def _painted(pixels: DataFrame, colours: Rgb, where: Column) -> list[Column]:
    applies = F.coalesce(where, F.lit(False))
    return [F.when(applies, c).otherwise(F.col(f"back_{n}")).cast("int").alias(n) for c, n in zip(colours, "rgb", strict=True)]


def _backed(image: DataFrame) -> DataFrame:
    return image.select("x", "y", *[F.col(n).alias(f"back_{n}") for n in "rgb"])


def frame_image(
    frame: DataFrame, paths: DataFrame, image: DataFrame, variables: dict[str, float], ox: int = 0, oy: int = 0
) -> DataFrame:
    """(x, y, variable, r, g, b): a frame over the background, for variables with their scales' exponents.

    A pixel shows the frame where its path index is SHOWN_PATH. Cells that the
    frame doesn't touch are open water there; every other pixel keeps its own
    colour. frame(i, j, mask, …) may have gaps; (ox, oy) is the grid's corner.
    """
    cells = frame.withColumns({"x": F.col("i") + ox, "y": F.col("j") + oy})
    near = _backed(image).join(paths.select("x", "y", "path_index"), ["x", "y"], "left").join(cells, ["x", "y"], "left")
    fields = {c: F.coalesce(c, F.lit(0.0)) for c in ("jpinv", "p", "q", "vx", "vy")}
    near = cut(near.withColumns({**fields, "mask": F.coalesce("mask", F.lit(0)), **{n: F.coalesce(n, F.lit(w)) for n, w in zip("rgb", WATER, strict=True)}}))
    shown = F.col("path_index") == SHOWN_PATH
    frames = near.where(shown)
    passes = [frames.select("x", "y", F.lit(v).alias("variable"), *frame_color(v, scale_of(e), rgb()).named()) for v, e in variables.items()]
    around = near.where(~F.coalesce(shown, F.lit(False))).withColumn("variable", F.explode(F.array(*map(F.lit, variables))))
    passes.append(around.select("x", "y", "variable", *[F.col(f"back_{n}").cast("int").alias(n) for n in "rgb"]))
    return reduce(DataFrame.unionByName, passes)


def frame_colours(frame: DataFrame, scales: dict[str, float]) -> DataFrame:
    """(i, j, variable, r, g, b) of a frame's cells, for variables with the values that span their palettes.

    The frame is kept, and every variable is a pass of its own, as code for all
    of them in one would be too large to be compiled.
    """
    kept = cut(frame)
    passes = [kept.select("i", "j", F.lit(v).alias("variable"), *frame_color(v, scale, rgb()).named()) for v, scale in scales.items()]
    return reduce(DataFrame.unionByName, passes)


def _norm(x: str, y: str) -> Column:
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))


def _modelled() -> Column:
    return F.col("status") == MODELLED


def _full(palette: str, value: Column) -> Blend:
    return Blend(rgb(), palette, value)


#: What a running model shows of its grid, and where. Columns: status, mask, the frame's fields and colours, cvx, cvy, mass, density, fx and fy.
GRID_RULES: dict[str, tuple[Callable[[float], Blend], Callable[[], Column]]] = {
    "v_norm": (lambda s: _full("ANSYS", _norm("cvx", "cvy") / s), _modelled),
    "v_u": (lambda s: _full("ANSYS", F.col("cvx") / s + 0.5), _modelled),
    "v_v": (lambda s: _full("ANSYS", F.col("cvy") / s + 0.5), _modelled),
    "grid_mass": (lambda s: _full("P2", F.col("mass") / s), _modelled),
    "grid_pointdensity": (lambda s: _full("ANSYS", F.col("density") / FULL_CELL / s), _modelled),
    "grid_colors": (lambda s: Blend(rgb()), _modelled),
    "grid_Jpinv": (lambda s: frame_blend("jpinv", s, rgb()), _modelled),
    "grid_P": (lambda s: frame_blend("p", s, rgb()), _modelled),
    "grid_Q": (lambda s: frame_blend("q", s, rgb()), _modelled),
    "grid_vnorm": (lambda s: frame_blend("speed", s, rgb()), _modelled),
    "regions": (lambda s: _full("Pastel", F.col("status") % 13 / 12.0), lambda: ~_modelled()),
    "grid_force": (lambda s: _full("ANSYS", _norm("fx", "fy") / s), lambda: ~_modelled()),
}


def grid_images(cells: DataFrame, image: DataFrame, options: dict[str, float], ox: int = 0, oy: int = 0) -> DataFrame:
    """(x, y, option, r, g, b): GRID_RULES, with their scales' exponents, over the background.

    Options that aren't among the rules show the background alone. What the
    rules read is joined once and kept; then every option is a pass of its own
    over the columns that it needs, as code for all of them in one would be too
    large to be compiled.
    """
    placed = cells.withColumns({"x": F.col("i") + ox, "y": F.col("j") + oy}).drop("i", "j")
    near = cut(_backed(image).join(placed, ["x", "y"], "left"))
    nothing = (lambda s: Blend(water()), lambda: F.lit(False))
    passes = []
    for option, exponent in options.items():
        blend, where = GRID_RULES.get(option, nothing)
        passes.append(near.select("x", "y", F.lit(option).alias("option"), *_painted(near, blend(scale_of(exponent)).painted(), where())))
    return reduce(DataFrame.unionByName, passes)


def _own(palette: str, lookup_at: Column, value: Column, scale: float) -> Blend:
    """A point's own colour blended towards a palette's, the more the larger the value."""
    return Blend(rgb(), palette, lookup_at, F.abs(value) / scale)


def _plain() -> Blend:
    return Blend(Rgb(*[F.lit(c) for c in PLAIN_POINT]))


#: What a running model shows of its points. Columns: jp_inv, p, q, thickness, crushed, disabled, part and colours.
POINT_RULES: dict[str, Callable[[float], Blend]] = {
    "none": lambda s: _plain(),
    "regions": lambda s: _plain(),
    "color": lambda s: Blend(rgb()),
    "status": lambda s: _full("NCD", F.when(F.col("disabled"), 1.0).when(F.col("crushed"), 0.5).otherwise(0.0)),
    "Jp_inv": lambda s: _own("Pressure", (F.col("jp_inv") - 1) / s + 0.5, F.col("jp_inv") - 1, s),
    "ridges": lambda s: Blend(rgb(), "Ridges", (F.col("jp_inv") - 1) / s, F.when(F.col("jp_inv") > 1, 1.0).otherwise(0.0)),
    "P": lambda s: _own("Pressure", F.col("p") / s + 0.5, F.col("p"), s),
    "Q": lambda s: _own("P2", F.col("q") / s + 0.5, F.col("q"), s),
    "thickness": lambda s: _full("ANSYS", (F.col("thickness") - 0.8) / 0.2),
    "partitions": lambda s: _full("NCD", F.col("part") / 8.0),
}


def point_colours(points: DataFrame, key: list[str], options: dict[str, float]) -> DataFrame:
    """(key…, option, r, g, b) of points for POINT_RULES, with their scales' exponents.

    Colours are null, which hides the points, for options of the grid. Every
    option is a pass of its own over the columns that it needs.
    """
    hidden = Rgb(*[F.lit(None).cast("int")] * 3)
    passes = []
    for option, exponent in options.items():
        colours = POINT_RULES[option](scale_of(exponent)).painted() if option in POINT_RULES else hidden
        passes.append(points.select(*key, F.lit(option).alias("option"), *colours.named()))
    return reduce(DataFrame.unionByName, passes)


def _ice(crushed: float, solid: float) -> Rgb:
    t = F.least(F.greatest((F.col("ice_thickness") - crushed) / (solid - crushed), F.lit(0.0)), F.lit(1.0))
    thin, thick = (Rgb(*[F.lit(c) for c in tone]) for tone in (THIN_ICE, THICK_ICE))
    ice = merge(thin, thick, t)
    status = F.col("ice_status")
    tones = zip(OPEN_WATER, CRUSHED_ICE, ice, strict=True)
    return Rgb(*[F.when(status == 0, w).when(status == 1, c).when(status == 2, i).otherwise(0) for w, c, i in tones])


def _path() -> Column:
    return F.col("path_index")


#: What the preparation shows of a map. Columns: path_index, ice_status, ice_thickness and the flow (vx, vy).
MAP_RULES: dict[str, Rule] = {
    "boundaries": (lambda s: category(_path()), lambda: _path() != -1),
    "speed": (
        lambda s: Rgb(
            *[F.when(_path() == SHOWN_PATH, v).otherwise(c) for v, c in zip(diverging(_norm("vx", "vy") * 4), category(_path()), strict=True)]
        ),
        lambda: _path() != -1,
    ),
    "vx": (lambda s: diverging(F.col("vx") / 0.25), lambda: _path() != -1),
    "vy": (lambda s: diverging(F.col("vy") / 0.25), lambda: _path() != -1),
    "thickness": (lambda s: _ice(0.8, 1.0), lambda: _path() == SHOWN_PATH),
}


def map_images(pixels: DataFrame, image: DataFrame, options: tuple[str, ...] = tuple(MAP_RULES)) -> DataFrame:
    """(x, y, option, r, g, b) of MAP_RULES over the background."""
    near = cut(_backed(image).join(pixels, ["x", "y"], "left"))
    passes = [near.select("x", "y", F.lit(o).alias("option"), *_painted(near, MAP_RULES[o][0](1.0), MAP_RULES[o][1]())) for o in options]
    return reduce(DataFrame.unionByName, passes)
