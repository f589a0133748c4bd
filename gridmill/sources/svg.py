"""SVG paths as tables of cubic Bezier segments."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"([MmLlHhVvCcSsQqTtZz])|(-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_SCHEMA = (
    "path int, name string, closed boolean, seg int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"
)
Point = tuple[float, float]


def _mix(a: Point, b: Point, t: float) -> Point:
    return a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t


def segments(d: str) -> Iterator[tuple[bool, list[tuple[Point, Point, Point, Point]]]]:
    """(closed, cubic segments) of each subpath of a path's data; lines become cubics."""
    tokens = [m.groups() for m in _TOKEN.finditer(d)]
    if re.search(r"[Aa]", re.sub(r"[eE][-+]?\d", "", d)):
        raise ValueError("elliptical arcs are not read")
    at: Point = (0.0, 0.0)
    start, handle = at, None
    found: list[tuple[Point, Point, Point, Point]] = []
    command, k = "", 0

    def numbers(n: int) -> list[float]:
        nonlocal k
        if k + n > len(tokens) or any(tokens[k + j][1] is None for j in range(n)):
            raise ValueError("the path's data end early")
        out = [float(tokens[k + j][1]) for j in range(n)]
        k += n
        return out

    def point(relative: bool) -> Point:
        x, y = numbers(2)
        return (at[0] + x, at[1] + y) if relative else (x, y)

    while k < len(tokens):
        if tokens[k][0]:
            command = tokens[k][0]
            k += 1
        rel, kind = command.islower(), command.upper()
        if kind == "M":
            if found:
                yield False, found
                found = []
            at = start = point(rel)
            command, handle = ("l" if rel else "L"), None
        elif kind == "Z":
            if at != start:
                found.append((at, _mix(at, start, 1 / 3), _mix(at, start, 2 / 3), start))
            at = start
            if found:
                yield True, found
            found, handle = [], None
        elif kind in "LHV":
            if kind == "L":
                to = point(rel)
            else:
                (v,) = numbers(1)
                to = (at[0] * rel + v, at[1]) if kind == "H" else (at[0], at[1] * rel + v)
            found.append((at, _mix(at, to, 1 / 3), _mix(at, to, 2 / 3), to))
            at, handle = to, None
        elif kind in "CS":
            mirror = (2 * at[0] - handle[1][0], 2 * at[1] - handle[1][1]) if handle and handle[0] == "C" else at
            a = point(rel) if kind == "C" else mirror
            b, to = point(rel), point(rel)
            found.append((at, a, b, to))
            at, handle = to, ("C", b)
        elif kind in "QT":
            mirror = (2 * at[0] - handle[1][0], 2 * at[1] - handle[1][1]) if handle and handle[0] == "Q" else at
            c = point(rel) if kind == "Q" else mirror
            to = point(rel)
            found.append((at, _mix(at, c, 2 / 3), _mix(to, c, 2 / 3), to))
            at, handle = to, ("Q", c)
        else:
            raise ValueError("path data must begin with a command")
    if found:
        yield False, found


def parse(text: str) -> list[tuple]:
    """Rows of the segment table of an SVG text."""
    rows = []
    path = 0
    for element in ET.fromstring(text).iter():
        if element.tag.rsplit("}", 1)[-1] != "path":
            continue
        for closed, parts in segments(element.get("d", "")):
            rows += [(path, element.get("id", ""), closed, k, *(c for p in part for c in p)) for k, part in enumerate(parts)]
            path += 1
    return rows


def read_svg(spark: SparkSession, path: str) -> DataFrame:
    """Segments of an SVG file's paths; one drawing, parsed on the driver."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return spark.createDataFrame(parse(text), _SCHEMA)
