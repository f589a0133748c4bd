"""Operators that meet by place, against plain programs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridmill.operators import fields, layout, nearest, thinning, tiles


def distance(p, a, b):
    side = [y - x for x, y in zip(a, b, strict=True)]
    long_ = sum(s * s for s in side)
    t = min(max(sum((c - x) * s for c, x, s in zip(p, a, side, strict=True)) / long_, 0.0), 1.0) if long_ else 0.0
    return math.sqrt(sum((c - (x + s * t)) ** 2 for c, x, s in zip(p, a, side, strict=True)))


@pytest.mark.parametrize(("axes", "n", "seed", "leaf"), [("xy", 300, 1, 8), ("xy", 40, 2, 1), ("xyz", 150, 3, 4), ("xy", 1, 4, 8)])
def test_nearest_segment_equals_all_pairs(spark, monkeypatch, axes, n, seed, leaf):
    monkeypatch.setattr(nearest, "LEAF_PIECES", leaf)
    r, axes = random.Random(seed), list(axes)
    spot = lambda far=100.0: [r.uniform(0, far) for _ in axes]
    segments = []
    for k in range(n):
        a = spot()
        b = spot() if k % 10 == 0 else [x + r.uniform(-2, 2) for x in a]
        segments.append((k, a, b if k % 7 else a))
    segments += [(n + k, a, b) for k, (_, a, b) in enumerate(segments[:5])]  # repeated: the first wins
    points = [spot() for _ in range(120)] + [[x * 30 for x in spot()] for _ in range(5)] + [segments[0][1], [250.0] * len(axes)]
    points += points[:3]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(1000, None, *[1.0] * (len(axes) - 1)), (1001, float("nan"), *[1.0] * (len(axes) - 1))], "id long, " + ", ".join(f"{x} double" for x in axes))
    ends = ", ".join(f"{e}{x} double" for x in axes for e in "ab")
    lines = spark.createDataFrame([(k, *[v for pair in zip(a, b, strict=True) for v in pair]) for k, a, b in segments] + [(-5, None, *[0.0] * (2 * len(axes) - 1))], f"seg long, {ends}")
    out = nearest.nearest_segment(df.repartition(3), lines.repartition(2), axes, ["seg"])
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()
    found = {r["id"]: r["nearest"] for r in out.collect()}
    assert len(found) == len(points) + 2 and found[1000] is None and found[1001] is None
    for k, p in enumerate(points):
        best = min((distance(p, a, b), s) for s, a, b in segments)
        assert (found[k]["distance"], found[k]["name"]["seg"]) == pytest.approx(best, abs=1e-12)


def test_nearest_segment_without_segments(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    none = spark.createDataFrame([], "seg long, ax double, bx double, ay double, by double")
    assert nearest.nearest_segment(points, none, ["x", "y"], ["seg"]).first()["nearest"] is None
    assert nearest.nearest_segment(points.limit(0), none, ["x", "y"], ["seg"]).collect() == []


def test_polyline_segments(spark):
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 3.0, 4.0), (1, 5, 3.0, 10.0), (2, 0, 1.0, 1.0)], "curve int, seq int, x double, y double")
    got = [tuple(r) for r in nearest.polyline_segments(nodes, ["x", "y"]).select("curve", "seg", "done", "length", "total").orderBy("seg").collect()]
    assert got == [(1, 0, 0.0, 5.0, 11.0), (1, 1, 5.0, 6.0, 11.0)]


def inside(p, t):
    (ax, ay), (bx, by), (cx, cy) = t
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    if not det:
        return None
    u = ((by - cy) * (p[0] - cx) + (cx - bx) * (p[1] - cy)) / det
    v = ((cy - ay) * (p[0] - cx) + (ax - cx) * (p[1] - cy)) / det
    return (u, v) if u >= 0 and v >= 0 and 1 - u - v >= 0 else None


@pytest.mark.parametrize(("hot", "seed"), [(4096, 1), (4, 2), (1, 3)])
def test_probe_equals_all_pairs(spark, hot, seed):
    r = random.Random(seed)
    corner = lambda far: (r.uniform(0, far), r.uniform(0, far))
    shapes = [(9000, ((-500.0, -500.0), (900.0, -400.0), (0.0, 800.0))), (9001, ((1.0, 1.0), (2.0, 2.0), (3.0, 3.0)))]
    for k in range(150):
        x, y = corner(90)
        size = 30.0 if k % 40 == 0 else r.choice([0.3, 2.0, 5.0])
        turn = [(x, y), (x + size, y + size / 5), (x + size / 3, y + size)]
        shapes.append((k, tuple(turn if k % 2 else turn[::-1])))
    shapes.append((7000, ((10.0, 10.0), (20.0, 10.0), (10.0, 20.0))))
    points = [corner(95) for _ in range(150)] + [(5.0 + k * 1e-3, 5.0) for k in range(60)] + [(10.0, 10.0), (15.0, 15.0), (-2000.0, 3.0), (20.0, 10.0)]
    points += points[:4]
    rows = [(c, *[v for p in t for v in p], float(c), float(2 * c), 1.0) for c, t in shapes] + [(-1, None, *[0.0] * 5, 1.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "cell_id long, ax double, ay double, bx double, by double, cx double, cy double, a_s double, b_s double, c_s double")
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(5000, None, 1.0)], "id long, x double, y double")
    found = {r["id"]: (r["cell_id"], r["s"]) for r in tiles.probe_points(df.repartition(3), t, ["s"], hot).collect()}
    assert len(found) == len(points) + 1 and found[5000] == (None, None)
    for k, p in enumerate(points):
        best = min(((c, uv) for c, s in shapes if (uv := inside(p, s))), default=None)
        if best is None:
            assert found[k] == (None, None)
        else:
            c, (u, v) = best
            assert found[k][0] == c
            assert found[k][1] == pytest.approx(u * c + v * 2 * c + (1 - u - v), abs=1e-6)


def test_probe_of_nothing(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    t = spark.createDataFrame([], "cell_id long, ax double, ay double, bx double, by double, cx double, cy double, a_s double, b_s double, c_s double")
    assert tuple(tiles.probe_points(points, t, ["s"]).first()) == (1.0, 2.0, None, None)
    far = spark.createDataFrame([(1, 10.0, 10.0, 11.0, 10.0, 10.0, 11.0, 1.0, 1.0, 1.0)], t.schema)
    assert tuple(tiles.probe_points(points, far, ["s"]).first()) == (1.0, 2.0, None, None)


@pytest.mark.parametrize(("far", "seed"), [(0.05, 1), (1.0, 2), (20.0, 3)])
def test_thinning_equals_the_sequential_rule(spark, far, seed):
    r = random.Random(seed)
    points = [(k, r.random() * 10, r.random() * 10, r.randrange(60)) for k in range(300)] + [(400, 5.0, 5.0, 7), (401, 5.0, 5.0, 7), (402, -3.5, 2.0, 1)]
    kept = []
    for _, x, y, _ in sorted(points, key=lambda p: (p[3], p[1], p[2])):
        if all((x - a) ** 2 + (y - b) ** 2 >= far * far for a, b in kept):
            kept.append((x, y))
    df = spark.createDataFrame(points + [(500, None, 1.0, 0), (501, float("nan"), 1.0, 0)], "id long, x double, y double, p int").repartition(3)
    found = thinning.thin(df, far, [F.col("p")]).collect()
    assert sorted(r["id"] for r in found) == sorted(k for k, x, y, _ in points if (x, y) in set(kept))
    assert thinning.thin(df.limit(0), far, [F.col("p")]).collect() == []


@pytest.mark.parametrize("most", [1, 6, 64, 10_000])
def test_box_ranges_hold_the_box(most):
    r = random.Random(most)
    for _ in range(30):
        i0, j0 = r.randrange(200), r.randrange(200)
        i1, j1 = i0 + r.randrange(40), j0 + r.randrange(40)
        ranges = layout.box_ranges(i0, i1, j0, j1, most)
        assert len(ranges) <= max(most, 1) and ranges == sorted(ranges)
        held = lambda k: any(a <= k <= b for a, b in ranges)  # noqa: B023, E731
        assert all(held(layout._key(i, j)) for i in range(i0, i1 + 1) for j in range(j0, j1 + 1))
        if most == 10_000:
            assert sum(b - a + 1 for a, b in ranges) == (i1 - i0 + 1) * (j1 - j0 + 1)


def test_stored_layout_reads_little(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, min(int(r.expovariate(0.02)), 65535), r.randrange(400)) for k in range(8000)] + [(9000 + k, 77, 77) for k in range(3000)] + [(20_000, 0, 0), (20_001, 65535, 65535)]
    df = spark.createDataFrame(rows, "id long, ci int, cj int").repartition(5)
    path = str(tmp_path / "points")
    layout.store(df, path, zones=40)
    held = {z["zone"]: z for z in spark.read.parquet(f"{path}/zones").collect()}
    assert sum(z["n"] for z in held.values()) == len(rows) and max(z["n"] for z in held.values()) < 3 * len(rows) / 40  # the crowded cell lies in several
    order = sorted(held)
    assert all(held[a]["high"] <= held[b]["low"] for a, b in zip(order, order[1:], strict=False))
    for zone in order[::9]:  # in order within a file
        curve = [x["curve"] for x in spark.read.parquet(f"{path}/points/zone={zone}").collect()]
        assert curve == sorted(curve)
    for box in ((10, 14, 200, 204), (77, 77, 77, 77), (0, 65535, 0, 65535), (5, 4, 0, 9), (-10, 3, -10, 50), (300, 310, 0, 5)):
        found = layout.lookup(spark, path, *box)
        assert sorted(x["id"] for x in found.collect()) == sorted(k for k, i, j in rows if box[0] <= i <= box[1] and box[2] <= j <= box[3])
    files = len(df.sparkSession.read.parquet(f"{path}/points").inputFiles())
    small = layout.lookup(spark, path, 10, 14, 200, 204)
    opened = {f for (f,) in small.select(F.input_file_name()).collect()}
    plan = small._jdf.queryExecution().executedPlan().toString()
    zones = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(opened) <= files / 10 and "zone" in zones
    assert "PushedFilters: [" in plan and "curve" in plan.split("PushedFilters: [")[1]


def test_tiles_of_diffusion_equal_single_steps(spark):
    r = random.Random(3)
    width, height = 23, 17
    cells = [(x, y, r.random() < 0.8, r.random(), r.random()) for x in range(width) for y in range(height) if r.random() < 0.95]
    df = spark.createDataFrame(cells, "x int, y int, active boolean, vx double, vy double").repartition(3)
    want = {(x, y): (a, vx, vy) for x, y, a, vx, vy in cells}
    zero = (False, 0.0, 0.0)
    want = {k: v if v[0] else zero for k, v in want.items()}
    for _ in range(7):
        near = {}
        for (x, y), (active, *v) in want.items():
            around = [want.get((min(max(x + i, 0), width - 1), min(max(y + j, 0), height - 1)), zero) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            near[x, y] = (True, *[c + 0.1 * (sum(n[k + 1] for n in around) - 4 * c) for k, c in enumerate(v)]) if active else zero
        want = near
    for tile, halo in ((5, 3), (8, 7), (64, 16), (4, 1)):
        got = fields.diffuse_tiled(df, 7, 0.1, width, height, tile=tile, halo=halo).collect()
        assert len(got) == len(cells)
        assert all((g["active"], g["vx"], g["vy"]) == pytest.approx(want[g["x"], g["y"]]) for g in got)
    assert {(g["x"], g["y"]): g["vx"] for g in fields.diffuse(df, 7, 0.1, width, height).collect()} == pytest.approx({k: v[1] for k, v in want.items()})
    assert sorted(map(tuple, fields.diffuse_tiled(df, 0, 0.1, width, height).collect())) == sorted(cells)


@pytest.mark.parametrize("name", ["live_point_colors", "live_grid_colors"])
def test_live_colours_compile(spark, name):
    """Without fallback, code that is too large for a method raises an error."""
    from gridmill.plans import registry

    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").agg(F.sum("r"), F.sum("g"), F.sum("b")).first()[0] > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")
