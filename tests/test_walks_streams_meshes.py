"""Curve walks, the force stream, image strips, solid cells and refinement trees against plain programs."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.operators.walk import walk
from gridmill.sources import mesh, png, strips
from gridmill.streaming import forces


def walked(segments, width, height):
    """One path, segment after segment."""

    def place(seg, t):
        s = 1 - t
        s2, t2 = s * s, t * t
        return tuple(int(s2 * s * a + 3 * s2 * t * b + 3 * s * t2 * c + t2 * t * d) for a, b, c, d in (seg[:4], seg[4:]))

    out, last = [], place(segments[0], 0.0)
    for n, seg in enumerate(segments):
        step, t, k = 1 / max(width, height), 0.0, 1
        out.append((n, 0, *place(seg, t)))
        while t < 1:
            ahead = min(t + step, 1.0)
            x, y = place(seg, ahead)
            far = max(abs(x - last[0]), abs(y - last[1]))
            if far > 1:
                step /= 2
                assert step >= 1e-10
                continue
            t = ahead
            if far:
                out.append((n, k, x, y))
                k, last = k + 1, (x, y)
    return out


def test_walk_equals_the_sequential_program(spark, monkeypatch):
    from gridmill.operators import walk as module

    monkeypatch.setattr(module, "AT_ONCE", 5)
    r, rows, want = random.Random(4), [], {}
    for path in range(12):
        at, segments = (r.uniform(-20, 150), r.uniform(-20, 60)), []
        for _ in range(r.randrange(1, 5)):
            far = r.choice([0.0, 3.0, 60.0])
            xs = [at[0], *[at[0] + r.uniform(-far, far) for _ in range(3)]]
            ys = [at[1], *[at[1] + r.uniform(-far, far) for _ in range(3)]]
            segments.append((*xs, *ys))
            at = xs[3], ys[3]
        rows += [(path, n, *s) for n, s in enumerate(segments)]
        want[path] = walked(segments, 120, 48)
    columns = "path int, seg int, " + ", ".join(f"{c}{k} double" for c in "xy" for k in range(4))
    got = {}
    for g in walk(spark.createDataFrame(rows, columns).repartition(3), 120, 48).orderBy("path", "seg", "k").collect():
        got.setdefault(g["path"], []).append((g["seg"], g["k"], g["x"], g["y"]))
    assert got == want
    gap = [(0, 0, *[1.0] * 8), (0, 1, *[9.0] * 8)]
    with pytest.raises(Exception, match="step is too small"):
        walk(spark.createDataFrame(gap, columns), 10, 10).collect()
    assert walk(spark.createDataFrame([], columns), 10, 10).collect() == []


START = datetime(2024, 1, 1)
EVENTS = "ts timestamp, region int, seq long, fx double, fy double"


def series(rows):
    """Newest row of each region and frame, zeros where a region has none before its last frame."""
    newest = {}
    for ts, region, seq, fx, fy in rows:
        if ts is not None and region is not None and seq is not None:
            frame = int((ts - START).total_seconds() // forces.PERIOD)
            if frame >= 0:
                newest[region, frame] = max(newest.get((region, frame), (-1, 0.0, 0.0)), (seq, fx or 0.0, fy or 0.0))
    last = {}
    for region, frame in newest:
        last[region] = max(last.get(region, 0), frame)
    return {(r, f): newest.get((r, f), (-1, 0.0, 0.0))[1:] for r, end in last.items() for f in range(end + 1)}


def test_shuffled_and_restarted_stream_equals_the_batch(spark, tmp_path):
    origin = int((START - datetime(1970, 1, 1)).total_seconds())
    r = random.Random(2)
    rows = [(START + timedelta(hours=r.choice([3, 3, 40, r.uniform(0, 400)])), r.randrange(4), k, round(r.uniform(0, 9), 3), None if k % 9 == 0 else 1.0 * k) for k in range(150)]
    rows += [(None, 1, 900, 1.0, 1.0), (START, None, 901, 1.0, 1.0), (START - timedelta(days=3), 1, 902, 1.0, 1.0), (START + timedelta(days=30), 7, 903, 5.0, 6.0)]
    df = spark.createDataFrame(rows, EVENTS)
    found = forces.replay(spark, df, str(tmp_path), origin, "60 days", files=6, starts=2).collect()
    assert len(found) == len({(g["region"], g["frame"]) for g in found})
    assert {(g["region"], g["frame"]): (g["fx"], g["fy"]) for g in found} == series(rows)


def test_closed_frames_are_forgotten(spark, tmp_path):
    """What comes after its frame was closed changes nothing; what comes in time replaces what was written."""
    origin = int((START - datetime(1970, 1, 1)).total_seconds())
    session = spark.newSession()
    session.conf.set(*forces.STORE)
    day = lambda d, seq, fx: (START + timedelta(days=d), 1, seq, fx, 0.0)
    for batch in ([day(0, 1, 1.0), day(2, 2, 2.0)], [day(9, 3, 3.0)], [day(9.4, 9, 4.0)], [day(0, 4, 7.0), day(9, 2, 8.0), day(9.2, 5, 9.0)]):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        forces.store_changes(forces.frame_changes(stream, origin, "1 day"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {g["frame"]: g["fx"] for g in forces.current_series(spark, str(tmp_path / "out")).collect()}
    assert found == {0: 1.0, **{f: 0.0 for f in range(1, 18)}, 4: 2.0, 18: 4.0}


def check_window(part, want):
    assert part.rdd.getNumPartitions() == 1 and part.columns == ["x", "y", "g"]
    assert sorted(map(tuple, part.collect())) == sorted((x, y, c[1]) for (x, y), c in want.items() if 25 < y <= 40 and 30 <= x < 35 and c[1] % 2 == 0)


def test_strips_are_skipped_and_images_whole(spark, tmp_path):
    width, height = 37, 90
    pixels = {(x, y): ((x * 7) % 256, (y * 3) % 256, (x * y) % 256) for x in range(width) for y in range(height) if (x, y) != (5, 7)}
    rows = [(x, y, *c) for (x, y), c in pixels.items()] + [(width, 0, 1, 1, 1), (0, -1, 1, 1, 1), (None, 3, 1, 1, 1)]
    df = spark.createDataFrame(rows, "x int, y int, r int, g int, b int").repartition(4)
    uri = f"file://{tmp_path}/images/a.png"
    strips.write_png(df, uri, width, height, lines=16)
    whole = png.decode((tmp_path / "images" / "a.png").read_bytes())  # a PNG like any other
    want = {**pixels, (5, 7): (0, 0, 0)}
    assert all(tuple(whole[height - 1 - y, x]) == c for (x, y), c in want.items())
    everything = strips.read_strips(spark, uri)
    assert everything.rdd.getNumPartitions() == 6
    assert {(p["x"], p["y"]): (p["r"], p["g"], p["b"]) for p in everything.collect()} == want
    for pushed in (False, True):
        spark.conf.set(strips.PUSHDOWN[0], str(pushed).lower())
        given = {} if pushed else {"x": (30, 34), "y": (26, 40)}
        part = strips.read_strips(spark, uri, "x int, y int, g short", **given)
        if pushed:
            part = part.where("y > 25 AND y <= 40 AND x >= 30 AND x < 35")
        part = part.where("g % 2 = 0")
        check_window(part, want)
    assert strips.read_strips(spark, uri).where("y = 12 AND x = 3").count() == 1
    assert strips.read_strips(spark, uri).where("y > 500").count() == 0
    spark.conf.unset(strips.PUSHDOWN[0])
    # An image by another writer has no strips and is read whole.
    (tmp_path / "images" / "b.png").write_bytes(png.encode(np.full((3, 4, 3), 9, np.uint8)))
    both = strips.read_strips(spark, f"file://{tmp_path}/images")
    assert both.groupBy("path").count().count() == 2 and both.where("path LIKE '%b.png'").agg(F.sum("r")).first()[0] == 108
    (tmp_path / "c.png").write_bytes(b"no image at all, but long enough to look like one")
    with pytest.raises(Exception, match="no PNG"):
        strips.read_strips(spark, str(tmp_path / "c.png")).collect()


SOLIDS = {
    2: [[0, 2, 1], [0, 1, 3], [1, 2, 3], [2, 0, 3]],
    4: [[0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]],
    5: [[0, 3, 2, 1], [0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4]],
    6: [[0, 2, 1], [3, 4, 5], [0, 1, 4, 3], [1, 2, 5, 4], [2, 0, 3, 5]],
}


def test_solids_from_shuffled_faces(spark):
    """Whatever comes first and however it is turned: a base's nodes, and above each the one it shares an edge with."""
    r, faces, cells, runs = random.Random(6), [], [], {}
    for cell in range(1, 81):
        kind = r.choice(list(SOLIDS))
        cells.append((cell, kind))
        order = r.sample(SOLIDS[kind], len(SOLIDS[kind]))
        for f, run in enumerate(order):
            turn = r.randrange(len(run))
            run = [cell * 10 + n for n in run[turn:] + run[:turn]]
            mine = r.random() < 0.5
            faces.append((cell * 10 + f, run if mine else run[::-1], cell if mine else 0, 0 if mine else cell))
            runs.setdefault(cell, []).append(run)
    got = mesh.cells_from_faces(
        spark.createDataFrame(faces, "face_id long, nodes array<long>, c0 long, c1 long").repartition(3), spark.createDataFrame([(c, 0, t) for c, t in cells], "cell_id long, zone int, type int")
    )
    got = {g["cell_id"]: g["nodes"] for g in mesh.require_complete(got).collect()}
    for cell, kind in cells:
        size = {2: 3, 4: 4, 5: 4, 6: 3}[kind]
        base = next(run for run in runs[cell] if len(run) == size)
        edges = {frozenset((a, b)) for run in runs[cell] for a, b in zip(run, run[1:] + run[:1], strict=True)}
        rest = [n for n in {n for run in runs[cell] for n in run} if n not in base]
        above = [next((n for n in rest if frozenset((b, n)) in edges), None) for b in base]
        assert got[cell] == base + (above if kind in (4, 6) else rest)


def test_polyhedra_and_incomplete_solids(spark):
    faces = spark.createDataFrame(
        [(1, [1, 2, 3], 5, 0), (2, [4, 3, 2, 1], 0, 5), (3, [], 5, 0), (4, [1, 2, 3, 4], 6, 0), (5, [4, 3, 9, 8], 6, 0)], "face_id long, nodes array<long>, c0 long, c1 long"
    )
    cells = spark.createDataFrame([(5, 0, 7), (6, 0, 4)], "cell_id long, zone int, type int")
    got = {g["cell_id"]: g["nodes"] for g in mesh.cells_from_faces(faces, cells).collect()}
    assert got == {5: [2, 3, 1, 2, 3, 4, 4, 3, 2, 1], 6: None}
    with pytest.raises(Exception, match="wrong nodes in cell 6"):
        mesh.require_complete(mesh.cells_from_faces(faces, cells)).collect()


def test_trees_of_any_depth(spark):
    r = random.Random(1)
    edges = [(k - 1, k) for k in range(1, 150)] + [(r.randrange(200, k), k) for k in range(201, 400)] + [(500, 501), (500, 501)]
    up = {c: p for p, c in edges}
    got = {g["cell_id"]: (g["root"], g["depth"], g["leaf"]) for g in mesh.tree_closure(spark.createDataFrame(edges + [(None, 3), (4, None)], "parent long, child long").repartition(3)).collect()}
    want = {}
    for cell in {c for e in edges for c in e}:
        root, depth = cell, 0
        while root in up:
            root, depth = up[root], depth + 1
        want[cell] = (root, depth, cell not in up.values())
    assert got == want
    with pytest.raises(Exception, match="two parents"):
        mesh.tree_closure(spark.createDataFrame([(1, 3), (2, 3)], "parent long, child long")).collect()
    assert mesh.tree_closure(spark.createDataFrame([], "parent long, child long")).collect() == []
    values = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 100.0), (4, 5.0)], "cell_id long, u double")
    found = mesh.parent_values(spark.createDataFrame([(0, 1), (0, 2), (0, 3), (3, 4), (9, 0)], "parent long, child long"), values, ["u"])
    assert {g["cell_id"]: g["u"] for g in found.collect()} == {1: 1.0, 2: 3.0, 4: 5.0, 0: 2.0, 3: 5.0, 9: 0.0}


def test_a_circle_has_no_root(spark):
    with pytest.raises(Exception, match="their own ancestors"):
        mesh.tree_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (0, 9)], "parent long, child long"), most=5)
