"""What keeps time, memory and disk from growing faster than the input."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmill.operators import fields, gather, nearest, sampling, tiles
from gridmill.plans import adapters, registry
from gridmill.plans.lineage import cut
from gridmill.sources import mesh
from gridmill.streaming import forces

#: Bytes of a method from which on the JVM doesn't compile it.
HUGE = 8000


def method_sizes(spark, df):
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(df._jdf.queryExecution().executedPlan()))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_gathering_and_settling_are_compiled(spark):
    particles = adapters.particles(spark, "/root/testdata/sf0.001")
    nodes = adapters.cells(spark).selectExpr("i", "j", "cvx AS vx", "cvy AS vy")
    sizes = method_sizes(spark, gather.update_particles(particles, nodes, adapters.PRM, adapters.GX, adapters.GY))
    assert sizes and max(sizes) < HUGE
    sizes = method_sizes(spark, registry.QUERIES["advect"](spark, "/root/testdata/sf0.001"))
    assert sizes and max(sizes) < HUGE


def test_probed_pixels_keep_no_list_of_triangles(spark):
    rows = [(k, 0.0, 0.0, 9.0, 0.0, 0.0, 9.0, float(k), float(k), float(k)) for k in range(200, 0, -1)]
    t = spark.createDataFrame(rows, "cell_id long, ax double, ay double, bx double, by double, cx double, cy double, a_s double, b_s double, c_s double").repartition(3)
    out = fields.probe(t, 4, 4, ["s"])
    assert [r["s"] for r in out.collect()] == [1.0] * 16
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "HashAggregate(keys=[x" in plan


def test_poisson_tiles_are_filled_side_by_side(spark):
    """Tiles have hardly any bytes before they are filled, yet aren't put into one task."""
    tiled = sampling.poisson_tiles(spark, 1.0, 0.5, 0.02, side=8)  # 7 x 4 tiles
    assert sum(n > 0 for n in tiled.rdd.glom().map(len).collect()) >= 14
    alone = [sampling.poisson_disk(1.0, w, 0.03, seed) for seed, w in enumerate((0.2, 0.6))]
    side_by_side = sampling.poisson_boxes([(1.0, w, seed, None) for seed, w in enumerate((0.2, 0.6))], 0.03)
    assert all((a == b).all() for a, b in zip(alone, side_by_side, strict=True))


def test_places_and_segments_nearby_are_not_sorted(spark, monkeypatch):
    """Least distances are hash aggregates; what is sorted for its struct has the least distance already."""
    kept = []
    monkeypatch.setattr(nearest, "cut", lambda df: kept.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    points = spark.range(300).selectExpr("id % 20 * 1.0D AS x", "id * 0.1D AS y")
    lines = spark.range(90).selectExpr("id AS seg", "id % 9 * 3.0D AS ax", "id % 9 * 3.0D + 2 AS bx", "id * 0.3D AS ay", "id * 0.3D AS by")
    last = nearest.nearest_segment(points, lines, ["x", "y"], ["seg"])._jdf.queryExecution().executedPlan().toString()
    assert any("HashAggregate(keys=[x" in p and "min(distance" in p and "SortAggregate" not in p for p in kept)
    assert "(distance" in last and "least" in last


def test_state_is_asked_for_frames_not_for_rows():
    class State(dict):
        calls = 0

        def __getattr__(self, name):
            def call(*a):
                State.calls += 1
                at = a[0] if len(a) and name in ("containsKey", "getValue", "updateValue") else ()
                if name in ("exists", "containsKey"):
                    return at in self
                if name in ("update", "updateValue"):
                    self[at] = a[-1]
                return self.get(at)

            return call

        def update(self, value):
            self[()] = value

        get = dict.get

    class Value(State):
        def get(self, at=()):
            return dict.get(self, at)

    series = forces.FrameSeries(0)
    series.handle, series.ends, series.open = State(), Value(), State()
    batch = pd.DataFrame({"frame": [k % 3 * 2 for k in range(3000)], "seq": range(3000), "fx": [1.0 * k for k in range(3000)], "fy": 0.0})
    (found,) = series.handleInputRows((5,), iter([batch, batch]), None)
    assert found.values.tolist() == [[5, 0, 2997, 2997.0, 0.0], [5, 1, -1, 0.0, 0.0], [5, 2, 2998, 2998.0, 0.0], [5, 3, -1, 0.0, 0.0], [5, 4, 2999, 2999.0, 0.0]]
    assert list(series.handleInputRows((5,), iter([batch]), None)) == []
    assert State.calls < 50


def test_cells_of_a_tree_do_not_meet_at_its_root(spark, monkeypatch):
    """The most rows that one key brings into a round's join is far below the number of cells."""
    hottest = []

    def seen(df):
        out = cut(df)
        if {"cell_id", "up", "depth"} <= set(out.columns):
            open_ = out.where("up IS NOT NULL").groupBy("up").count().agg({"count": "max"}).first()[0]
            hottest.append(open_ or 0)
        return out

    monkeypatch.setattr(mesh, "cut", seen)
    tree = spark.range(1, 2000).selectExpr("id DIV 2 AS parent", "id AS child")
    got = {r["cell_id"]: (r["root"], r["depth"], r["leaf"]) for r in mesh.tree_closure(tree).collect()}
    assert got == {k: (0, k.bit_length(), k > 0 and k * 2 > 1999) for k in range(2000)}
    assert hottest and max(hottest) < 300


def test_cells_above_one_that_holds_a_tile_are_not_compared(spark, monkeypatch):
    """Many cells hold every place: only the lowest of them is met with places."""
    kept = []
    monkeypatch.setattr(tiles, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    points = spark.range(100).selectExpr("id % 10 * 1.0D AS x", "id * 0.1D AS y")
    sized = spark.range(300).selectExpr("id + 7 AS cell_id", "-50.0D - id AS ax", "-50.0D AS ay", "200.0D AS bx", "-40.0D AS by", "0.0D AS cx", "300.0D + id AS cy", *[f"1.0D * id AS {k}_s" for k in "abc"])
    found = tiles.probe_points(points, sized, ["s"])
    assert {r["cell_id"] for r in found.collect()} == {7}
    assert max(df.count() for df in kept[2:]) < 50  # the first two are the cells and the places


def test_segments_are_not_cut_by_their_number(spark, monkeypatch):
    """Long segments that lie close together: what is kept grows with their number, not with its square."""
    kept = []
    monkeypatch.setattr(nearest, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    points = spark.range(40).selectExpr("id * 2.5D AS x", "id % 7 * 10.0D AS y")
    lines = spark.range(400).selectExpr("id AS seg", "0.0D AS ax", "100.0D AS bx", "id * 0.2D AS ay", "id * 0.2D + 1 AS by")
    nearest.nearest_segment(points, lines, ["x", "y"], ["seg"]).collect()
    assert max(df.count() for df in kept) <= 2 * 400


@pytest.mark.parametrize("few", [5, 100_000])
def test_search_bounded_by_a_share_equals_all_pairs(spark, monkeypatch, few):
    """Joined by shuffle and by broadcast."""
    for name, value in (("SHARE", 30), ("LEAF_PIECES", 50), ("FEW", few)):
        monkeypatch.setattr(nearest, name, value)
    points = spark.range(200).selectExpr("id", "id * 7919 % 1009 / 10 AS x", "id * 104729 % 997 / 20 AS y").cache()
    lines = spark.range(300).selectExpr("id AS seg", "id * 31 % 211 / 2 AS ax", "id * 17 % 101 / 2 AS ay").selectExpr("*", "ax + seg % 9 - 4 AS bx", "ay + seg % 5 * 6 - 12 AS by").cache()
    found = nearest.nearest_segment(points, lines, ["x", "y"], ["seg"]).select("id", "nearest.distance", "nearest.name.seg")
    t = F.expr("coalesce(least(greatest(try_divide((x - ax) * (bx - ax) + (y - ay) * (by - ay), (bx - ax) * (bx - ax) + (by - ay) * (by - ay)), 0), 1), 0)")
    apart = F.expr("sqrt((x - (ax + (bx - ax) * t)) * (x - (ax + (bx - ax) * t)) + (y - (ay + (by - ay) * t)) * (y - (ay + (by - ay) * t)))")
    pairs = points.crossJoin(lines).withColumn("t", t).withColumn("distance", apart)
    want = pairs.groupBy("id").agg(F.min(F.struct("distance", "seg")).alias("b")).select("id", "b.distance", "b.seg")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
