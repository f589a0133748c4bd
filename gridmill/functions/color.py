"""Palettes, blends and colour codes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import MODELLED


def _hex(*codes: str) -> list[tuple[float, float, float]]:
    return [tuple(int(c[k : k + 2], 16) / 255 for k in (0, 2, 4)) for c in codes]


# The palettes, and the colour of open water.
PALETTES: dict[str, list[tuple[float, float, float]]] = {
    "SpecialJ": [
        (0.342992, 0.650614, 0.772702),
        (0.688376, 0.931066, 0.963615),
        (0.836049, 0.882901, 0.85903),
        *_hex("ee6eba", "940058"),
    ],
    "P2": _hex("eddfd6", "c6b8af", "9c8b7b", "7a6355", "524032", "2d1e17"),
    "Pressure": _hex("0336b3", "275d96", "80acd9", "779aae", "dfa7ac", "c2666e", "b72430"),
    "ANSYS": _hex(
        "0000ff", "0033ff", "0066ff", "0099ff", "00ccff", "00ffff", "00ffbf", "00ff7f", "00ff3f", "00ff00",
        "3fff00", "7fff00", "bfff00", "ffff00", "ffd500", "ffaa00", "ff7f00", "ff5500", "ff2a00", "ff0000",
    ),
    "Pastel": [
        tuple(c / 255 for c in rgb)
        for rgb in (
            (196, 226, 252), (136, 119, 187), (190, 125, 183), (243, 150, 168), (248, 187, 133),
            (156, 215, 125), (198, 209, 143), (129, 203, 178), (114, 167, 219), (224, 116, 129),
            (215, 201, 226), (245, 212, 229), (240, 207, 188), (247, 247, 213), (197, 220, 204),
            (198, 207, 180), (135, 198, 233), (179, 188, 221), (241, 200, 206), (145, 217, 213),
            (166, 200, 166), (199, 230, 186), (252, 246, 158), (250, 178, 140), (225, 164, 195),
            (196, 160, 208), (145, 158, 203), (149, 217, 230), (193, 220, 203), (159, 220, 163),
            (235, 233, 184), (237, 176, 145), (231, 187, 212), (209, 183, 222), (228, 144, 159),
            (147, 185, 222), (158, 213, 194), (177, 201, 139), (165, 222, 141), (244, 154, 154),
        )
    ],
    "NCD": [(0.0, 0.7, 0.0), (0.7, 0.0, 0.0), (0.1, 0.1, 0.1)],
    "Ridges": [
        (0.0, 0.5, 0.0), (0.126, 0.5, 0.0), (0.251, 0.5, 0.0), (0.375, 0.5, 0.0), (0.5, 0.5, 0.0), (0.5, 0.375, 0.0),
        (0.5, 0.251, 0.0), (0.5, 0.126, 0.0), (0.5, 0.0, 0.0), (0.438, 0.0, 0.063), (0.251, 0.0, 0.251),
    ],
}
WATER = (0x15, 0x1F, 0x2F)
# Colours of path indices.
CATEGORIES = [
    (255, 87, 51), (46, 204, 113), (52, 152, 219), (155, 89, 182), (241, 196, 15),
    (231, 76, 60), (26, 188, 156), (52, 73, 94), (46, 204, 64), (142, 68, 173),
    (230, 126, 34), (44, 62, 80), (39, 174, 96), (192, 57, 43), (41, 128, 185),
    (243, 156, 18), (22, 160, 133), (189, 195, 199), (211, 84, 0), (127, 140, 141),
]


class Rgb(NamedTuple):
    r: Column
    g: Column
    b: Column

    def named(self, prefix: str = "") -> list[Column]:
        return [c.cast("int").alias(prefix + n) for c, n in zip(self, "rgb", strict=True)]


def rgb(prefix: str = "") -> Rgb:
    return Rgb(*[F.col(prefix + n) for n in "rgb"])


def water() -> Rgb:
    return Rgb(*[F.lit(c) for c in WATER])


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def lookup(palette: str, value: Column) -> Rgb:
    """Interpolated colour of a palette at a value in [0, 1], clamped, each channel 0 to 255, truncated."""
    colours = PALETTES[palette]
    last = len(colours) - 1
    at = clamp(value) * last
    k = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    part = at - k

    def channel(c: int) -> Column:
        tones = F.array(*[F.lit(float(x[c])) for x in colours])
        low, high = F.element_at(tones, k + 1), F.element_at(tones, k + 2)
        return F.floor((low + (high - low) * part) * 255).cast("int")

    return Rgb(*[channel(c) for c in range(3)])


def merge(a: Rgb, b: Rgb, alpha: Column) -> Rgb:
    """a blended towards b, truncated."""
    t = clamp(alpha)
    return Rgb(*[F.floor(x * (1 - t) + y * t).cast("int") for x, y in zip(a, b, strict=True)])


def fill_water(pixels: DataFrame) -> DataFrame:
    """Pixels(status, r, g, b) with those of modelled cells in the colour of water."""
    modelled = F.col("status") == MODELLED
    return pixels.withColumns({c: F.when(modelled, w).otherwise(F.col(c)).cast("int") for c, w in zip("rgb", WATER, strict=True)})


def diverging(value: Column) -> Rgb:
    """Blue at -1, white at 0, red at 1."""
    v = clamp(value, -1.0, 1.0)
    fading = F.floor((1 - F.abs(v)) * 255).cast("int")
    return Rgb(F.when(v <= 0, fading).otherwise(255), fading, F.when(v <= 0, 255).otherwise(fading))


def category(index: Column) -> Rgb:
    """Colour of a path index; interiors differ from boundaries by five places."""
    k = F.pmod(F.when(index >= 1000, index + 5).otherwise(index), F.lit(len(CATEGORIES))).cast("int")
    return Rgb(*[F.element_at(F.array(*[F.lit(c[n]) for c in CATEGORIES]), k + 1) for n in range(3)])


class Blend(NamedTuple):
    """A palette's colour at ``value``, of which ``part`` covers ``base`` and the rest shows it; of all that, ``over`` covers water.

    Without a value the base shows, without a part or an over all is covered.
    """

    base: Rgb
    palette: str = ""
    value: Column | None = None
    part: Column | None = None
    over: Column | None = None

    def painted(self) -> Rgb:
        out = self.base if self.value is None else lookup(self.palette, self.value)
        if self.part is not None:
            out = merge(self.base, out, self.part)
        return out if self.over is None else merge(water(), out, self.over)


def frame_blend(variable: str, scale: float, base: Rgb) -> Blend:
    """``frame_color`` as a blend."""
    alpha = F.col("mask").cast("double")
    ground = merge(water(), base, alpha)
    if variable == "jpinv":
        v = F.col("jpinv") / scale
        return Blend(ground, "Pressure", 0.5 * v + 0.5, F.abs(v * alpha))
    if variable == "p":
        return Blend(base, "Pressure", 0.5 * F.col("p") / scale + 0.5, over=alpha)
    if variable == "q":
        return Blend(base, "ANSYS", F.col("q") / scale, over=alpha)
    if variable == "speed":
        speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) / scale
        return Blend(base, "ANSYS", speed, F.least(speed, F.lit(1.0)), alpha)
    raise ValueError(f"no such variable: {variable}")


#: Entries of a colour bar.
BAR = 256


def frame_color(variable: str, scale: float, base: Rgb) -> Rgb:
    """Colour of a frame's cell for a variable; needs jpinv, p, q, vx, vy and mask.

    ``base`` is the cell's own colour, ``scale`` the value that spans the palette.
    """
    alpha = F.col("mask").cast("double")
    ground = merge(water(), base, alpha)
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) / scale
    if variable == "jpinv":
        v = F.col("jpinv") / scale
        return merge(ground, lookup("Pressure", 0.5 * v + 0.5), F.abs(v * alpha))
    if variable == "ridges":
        v = F.col("jpinv") / scale
        return merge(ground, lookup("Ridges", v), F.when(v > 0, alpha * v).otherwise(0.0))
    if variable == "p":
        return merge(water(), lookup("Pressure", 0.5 * F.col("p") / scale + 0.5), alpha)
    if variable == "q":
        return merge(water(), lookup("ANSYS", F.col("q") / scale), alpha)
    if variable == "speed":
        return merge(water(), merge(base, lookup("ANSYS", speed), F.least(speed, F.lit(1.0))), alpha)
    if variable == "colors":
        return ground
    raise ValueError(f"no such variable: {variable}")


FRAME_VARIABLES = ("jpinv", "ridges", "p", "q", "speed", "colors")
