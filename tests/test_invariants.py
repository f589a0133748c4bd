"""What must hold whatever the data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridmill.functions import cells, color, material, naming, stencil
from gridmill.operators import classify, fields, frames, gather, nodes, partition, raster, sampling, scatter, step
from gridmill.params import PreparerParams, SimParams
from gridmill.plans import adapters, field_queries

SF = "/root/testdata/sf0.001"
PRM = adapters.PRM


def close(a, b, eps=1e-9):
    return abs(a - b) <= eps * max(1.0, abs(a), abs(b))


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([(-0.5, 0.5), (0.0, 0.0), (0.5, -0.5), (0.2, 0.37)], "fx double, fy double")
    total = sum((stencil.weight2(F.col("fx"), F.col("fy"), i, j) for i, j in stencil.STENCIL), F.lit(0.0))
    assert all(close(r[0], 1.0) for r in df.select(total).collect())
    edge = df.where("fx = 0.5").select(*[stencil.weight(F.col("fx"), d) for d in (-1, 0, 1)]).first()
    assert edge[0] == 0.0


def test_scatter_conserves_mass_and_momentum(spark):
    p = adapters.particles(spark, SF)
    live = p.where("NOT disabled")
    m = PRM.particle_mass * F.col("thickness")
    want = live.agg(F.sum(m), F.sum(m * F.col("vx")), F.sum(m * F.col("vy"))).first()
    rest = live.withColumns({f"bp{k}": F.lit(0.0) for k in material.ENTRIES}).withColumns(
        {"fe00": F.lit(1.0), "fe11": F.lit(1.0), "fe01": F.lit(0.0), "fe10": F.lit(0.0)}
    )
    got = scatter.particles_to_grid(rest, PRM).agg(F.sum("mass"), F.sum("px"), F.sum("py")).first()
    assert all(close(a, b, 1e-8) for a, b in zip(want, got, strict=True))


def test_all_disabled_gives_nothing(spark):
    p = adapters.particles(spark, SF).withColumn("disabled", F.lit(True))
    grid = scatter.particles_to_grid(p, PRM)
    assert grid.count() == 0
    totals = nodes.region_forces(nodes.update_nodes(grid, adapters.cells(spark), PRM, 0.0))
    assert totals.count() == nodes.REGIONS and totals.where("fx <> 0 OR fy <> 0").count() == 0


def test_one_particle_at_the_node(spark):
    p = spark.createDataFrame([(3, 4, 0.0, 0.0, 1.0, False)], "ci int, cj int, fx double, fy double, thickness double, disabled boolean")
    got = {(r["i"], r["j"]): r["mass"] / PRM.particle_mass for r in scatter.particle_mass(p, PRM).collect()}
    assert close(got[3, 4], 36 / 64) and close(got[2, 3], 1 / 64) and close(got[3, 5], 6 / 64) and len(got) == 9


def test_gather_of_a_constant_field(spark):
    grid = adapters.cells(spark).select("i", "j", F.lit(2.0).alias("vx"), F.lit(-1.0).alias("vy"))
    p = adapters.particles(spark, SF).where("ci BETWEEN 2 AND 110 AND cj BETWEEN 2 AND 40")
    worst = gather.gather(p, grid, PRM).agg(F.max(F.abs(F.col("gvx") - 2)), F.max(F.abs("gb01")), F.count(F.lit(1))).first()
    assert worst[0] < 1e-12 and worst[2] == p.count()


def test_svd_rebuilds_and_orders(spark):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-2, 2) for _ in range(4)) for _ in range(500)] + [(1.0, 0.0, 0.0, 1.0), (1.1, 0.0, 0.0, 0.9), (0.0, 0.0, 0.0, 0.0), (1.0, 2.0, 2.0, -1.0)]
    df = spark.createDataFrame(rows, "fe00 double, fe01 double, fe10 double, fe11 double")
    f, s = material.matrix("fe"), material.svd(material.matrix("fe"))
    back = s.rebuilt(s.s0, s.s1)
    gap = sum((F.abs(x - y) for x, y in zip(f, back, strict=True)), F.lit(0.0))
    worst = df.select(gap.alias("gap"), (s.s0 - F.abs(s.s1)).alias("order"), F.abs(s.s0 * s.s1 - f.det).alias("det")).agg(
        F.max("gap"), F.min("order"), F.max("det")
    ).first()
    assert worst[0] < 1e-12 and worst[1] > -1e-12 and worst[2] < 1e-12


def test_rest_is_not_crushed(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0)], "fe00 double, fe01 double, fe10 double, fe11 double")
    p, q = material.trial(material.matrix("fe"), SimParams())
    r = df.select(p.alias("p"), q.alias("q")).select("p", "q", material.crushed(F.col("p"), F.col("q"), SimParams()).alias("c")).first()
    assert r["p"] == 0 and r["q"] == 0 and r["c"] is False


def test_return_map_on_the_yield_surface(spark):
    """Case 3 leaves the deviator at the yield value, to the order of the strain."""
    df = spark.createDataFrame([(0.995, 0.02, 0.0, 0.99, 1.0, 1.0)], "fe00 double, fe01 double, fe10 double, fe11 double, jp_inv double, thickness double")
    back = material.return_map(df, PRM)
    assert back.first()["r_case"] == 3
    new = back.select(*[F.col(f"r_fe{k}").alias(f"fe{k}") for k in material.ENTRIES])
    p, q = material.trial(material.matrix("fe"), PRM)
    r = new.select(p.alias("p"), q.alias("q")).select("p", "q", material.yield_q(F.col("p"), PRM).alias("y")).first()
    assert abs(r["q"] - r["y"]) < 0.05 * r["y"]


def test_status_codes_are_injective(spark):
    codes = [-1, *range(99), *range(1000, 1156)]
    rows = spark.createDataFrame([(c,) for c in codes], "k int").select(cells.status_of(F.col("k")).alias("s")).collect()
    assert len({r["s"] for r in rows}) == len(codes)


def test_quantise_restores_within_half_a_step(spark):
    df = spark.range(1000).select((F.sin(F.col("id")) * 37).alias("v"), (F.sin(F.col("id")) * 37).alias("w"))
    back = fields.restore(fields.quantise(df, "v"), "v")
    assert back.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] <= 74 / 4095 / 2 + 1e-9
    flat = fields.quantise(spark.range(5).select(F.lit(3.5).alias("v")), "v")
    assert {r["v"] for r in flat.collect()} == {0}
    assert {r["v"] for r in fields.restore(flat, "v").collect()} == {3.5}


def test_diffusion_keeps_a_constant_at_the_edge(spark):
    field = spark.createDataFrame([(x, y, True, 1.0, 2.0) for x in range(4) for y in range(3)], "x int, y int, active boolean, vx double, vy double")
    out = fields.diffuse(field, 3, 0.1, 4, 3)
    assert out.count() == 12 and out.agg(F.max(F.abs(F.col("vx") - 1)), F.max(F.abs(F.col("vy") - 2))).first()[0] < 1e-12
    long_ = fields.diffuse_long(field, 5, 0.1, 4, 3, every=2)
    assert long_.count() == 12


def test_fill_precedence_equals_sequential_painting(spark):
    rng = random.Random(7)
    candidates, want = [], {}
    for x in range(600):
        marks = [(k, b) for k in range(5) for b in (False, True) if rng.random() < 0.25]
        candidates += [(x, 0, k, b) for k, b in marks]
        value = -1
        for k in range(5):
            if (k, False) in marks and (value == -1 or (value == 1000 and k)):
                value = 1000 + k
            if (k, True) in marks:
                value = k
        if marks:
            want[x] = value
    df = spark.createDataFrame(candidates, "x int, y int, path int, boundary boolean")
    assert {r["x"]: r["path_index"] for r in raster.fill_precedence(df).collect()} == want


def test_bounding_box_without_pixels_raises(spark):
    with pytest.raises(Exception, match="modelled area not found"):
        raster.bounding_box(spark.createDataFrame([(0, 0, -1)], "x int, y int, path_index int"), 10, 10).collect()


def test_missing_main_path_changes_nothing(spark):
    paths = spark.createDataFrame([(0, "a", True), (1, "b", True)], "path int, name string, closed boolean")
    assert {(r["path"], r["name"], r["is_main"]) for r in raster.main_first(paths, "zzz").collect()} == {(0, "a", False), (1, "b", False)}
    assert {(r["path"], r["name"], r["is_main"]) for r in raster.main_first(paths, "b").collect()} == {(1, "a", False), (0, "b", True)}


def test_equal_split_has_small_parts_first(spark):
    split = partition.equal_split(spark.range(10).select("id"), 3, [F.col("id")])
    assert [r["n"] for r in split.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()] == [3, 3, 4]
    assert partition.needs_squeeze(6, 100) and not partition.needs_squeeze(5, 100)


def test_first_nearest_segment_wins(spark):
    curve = ((0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (0.5, 0.5, 0.0))
    df = spark.createDataFrame([(0.5, 0.0, 0.0)], "r double, g double, b double")
    d, p = classify.project([F.col(c) for c in "rgb"], curve)
    r = df.select(d.alias("d"), p.alias("p")).first()
    assert r["d"] == 0 and close(r["p"], 0.5)


def test_frames_and_forces_on_disk(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2, 0.5, 1.0, 2.0, 0.1, 0.2, 1, 2, 3, 1)], "i int, j int, jpinv double, p double, q double, vx double, vy double, r int, g int, b int, mask int")
    path = str(tmp_path / "frames")
    for n in (2, 5, 2):
        frames.write_frame(frame, path, n)
    assert sorted(r[0] for r in frames.frame_numbers(spark, path).collect()) == [2, 5]
    assert frames.read_frame(spark, path, 5).count() == 1
    plan = frames.read_frame(spark, path, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(frame" in plan
    forces = spark.createDataFrame([(3, 1.0, 2.0)], "region int, fx double, fy double")
    for n in (2, 5):
        frames.write_forces(forces, str(tmp_path / "forces"), n)
    series = frames.force_series(spark.read.parquet(str(tmp_path / "forces")), 4).collect()
    assert len(series) == 24 and sum(r["fx"] for r in series) == 2.0
    assert frames.force_series(spark.createDataFrame([], "frame int, region int, fx double, fy double"), 4).count() == 0


def test_every_part_is_a_curve(spark, tmp_path):
    part = spark.createDataFrame([(k, 1 + k % 50, 900.0 + k) for k in (1, 200, 201, 20_000)], "p_partkey long, p_size int, p_retailprice double")
    part.write.parquet(str(tmp_path / "part.parquet"))
    out = field_queries.bezier_eval(spark, str(tmp_path)).collect()
    assert sorted((r["seg"], r["k"]) for r in out) == [(s, k) for s in (1, 200, 201, 20_000) for k in range(9)]
    ends = {(r["seg"], r["k"]): (r["x"], r["y"]) for r in out if r["k"] in (0, 8)}
    for seg, size, price in part.collect():
        assert ends[seg, 0] == (size, price / 20) and ends[seg, 8] == (2 * size, 40 - size)


def test_every_event_is_a_force(spark, tmp_path):
    at = [(0, "view", 3), (1, "view", 3), (1, "click", 4), (2, "click", 4), (4, "click", 4), (4, "view", 10)]  # frame 3 is a gap
    rows = [(k, frame, kind, user, 2.0 ** (k + 1)) for k, (frame, kind, user) in enumerate(at)]
    events = spark.createDataFrame(rows, "event_id long, frame int, event_type string, user_id long, value double")
    ts = F.timestamp_seconds((F.col("frame") + 19723 * 2) * 43200 + 60)
    events.withColumn("ts", ts).drop("frame").write.parquet(str(tmp_path / "events.parquet"))
    out = {(r["frame"], r["region"]): (r["fx"], r["fy"]) for r in field_queries.force_series_zero_fill(spark, str(tmp_path)).collect()}
    assert set(out) == {(f, r) for f in range(5) for r in range(10)}
    assert {k: fx for k, (fx, _) in out.items() if fx} == {(0, 3): 2.0, (1, 3): 4.0, (1, 4): 8.0, (2, 4): 16.0, (4, 4): 32.0, (4, 3): 64.0}
    assert all(fy == -fx / 2 for fx, fy in out.values())


def test_snapshot_round_trip(spark, tmp_path):
    p = adapters.particles(spark, SF).withColumns({"pid": F.monotonically_increasing_id(), "grain": F.lit(0)})
    frames.write_snapshot(p, str(tmp_path), 3, 77, 1.5)
    back, at, time = frames.read_snapshot(spark, str(tmp_path), 3)
    assert (back.count(), at, time) == (p.count(), 77, 1.5)
    with pytest.raises(ValueError, match="lacks columns"):
        spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "s00003/points"))
        frames.read_snapshot(spark, str(tmp_path), 3)


def test_path_ids(spark, tmp_path):
    ids = spark.createDataFrame([(1, "b"), (0, "a")], "k int, name string")
    frames.write_path_ids(ids, str(tmp_path / "ids"))
    assert [tuple(r) for r in frames.read_path_ids(spark, str(tmp_path / "ids")).orderBy("k").collect()] == [(0, "a"), (1, "b")]


def test_two_steps_conserve_particles(spark):
    p = adapters.particles(spark, SF)
    out = step.run_steps(p, adapters.cells(spark), PRM, 2, adapters.GX, adapters.GY).particles
    assert out.count() == p.count() and out.columns == p.columns
    assert out.where("abs(fx) > 0.5 OR abs(fy) > 0.5 OR isnan(fe00)").count() == 0


def test_poisson_points_keep_their_distance(spark, tmp_path):
    points = sampling.poisson_disk(1.0, 0.5, 0.05)
    table = spark.createDataFrame([(x / 0.05, y / 0.05) for x, y in points.tolist()], "x double, y double")
    assert len(points) > 100 and sampling.nearest_gap(table).first()[0] >= 1 - 1e-9
    tiled = sampling.poisson_tiles(spark, 1.0, 0.5, 0.02, side=8)
    again = sampling.poisson_tiles(spark, 1.0, 0.5, 0.02, side=8)
    assert sorted(map(tuple, tiled.collect())) == sorted(map(tuple, again.collect()))
    assert sampling.nearest_gap(tiled.select(F.col("x") / 0.02, F.col("y") / 0.02).toDF("x", "y")).first()[0] >= 1 - 1e-9
    assert abs(tiled.count() / len(sampling.poisson_disk(1.0, 0.5, 0.02)) - 1) < 0.1
    first = sampling.cached_points(spark, str(tmp_path), 12, 8)
    assert first.count() == sampling.cached_points(spark, str(tmp_path), 12, 8).count() > 12 * 8 * 4


def test_integer_hash_equals_the_sampler(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 1, 2, 12345, 2**32 - 1)], "s long").select("s", naming.integer_hash(F.col("s")).alias("h"))
    assert all(r["h"] == sampling._hash(r["s"]) for r in rows.collect())


def test_parameters():
    p = SimParams.parse('{"InputPNG": "a.png", "InputMap": "m.h5", "YoungsModulus": 1e9, "tpb_P2G": 1}')
    assert p.youngs_modulus == 1e9 and p.snapshot_period == 25 and close(p.kappa, p.lame_mu * 2 / 3 + p.lame_lambda)
    with pytest.raises(ValueError, match="InputMap"):
        SimParams.parse('{"InputPNG": "a.png"}')
    with pytest.raises(ValueError, match="solidColors"):
        PreparerParams.parse('{"Height": 1, "Width": 2, "openWaterColors": [[0, 0, 0]], "solidColors": [[0, 0]]}')
    assert close(SimParams(dimension_horizontal=430000).on_map(2000).cellsize, 215.1076, 1e-4)
    assert SimParams(dt=0.17, frame_period=300).steps_per_frame == 1764


def test_palette_ends_and_clamps(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,)], "v double")
    got = [tuple(r) for r in df.select(*color.lookup("ANSYS", F.col("v")).named()).collect()]
    assert got == [(0, 0, 255), (0, 0, 255), (255, 0, 0), (255, 0, 0)]
    assert math.isclose(color.PALETTES["Ridges"][-1][2], 0.251)


def test_fixed_colours():
    """Sizes and ends of the palettes, and the colours of water and paths, as plain values."""
    from gridmill.functions import color

    ends = {name: (len(c), tuple(round(v * 255) for v in c[0]), tuple(round(v * 255) for v in c[-1])) for name, c in color.PALETTES.items()}
    assert ends == {
        "SpecialJ": (5, (87, 166, 197), (148, 0, 88)),
        "P2": (6, (237, 223, 214), (45, 30, 23)),
        "Pressure": (7, (3, 54, 179), (183, 36, 48)),
        "ANSYS": (20, (0, 0, 255), (255, 0, 0)),
        "Pastel": (40, (196, 226, 252), (244, 154, 154)),
        "NCD": (3, (0, 178, 0), (26, 26, 26)),
        "Ridges": (11, (0, 128, 0), (64, 0, 64)),
    }
    assert color.WATER == (21, 31, 47) and color.CATEGORIES[0] == (255, 87, 51) and color.CATEGORIES[-1] == (127, 140, 141)


def test_quantised_frames_restore_within_half_a_step(spark, tmp_path):
    path = str(tmp_path / "frames")
    rows = [(i, j, i * 0.37 - j, (i * j) % 7 * 1e5, 4.0, -1e-3 * i, 0.0, i % 256, j % 256, 3, (i + j) % 2) for i in range(20) for j in range(15)]
    frame = spark.createDataFrame(rows, "i int, j int, jpinv double, p double, q double, vx double, vy double, r int, g int, b int, mask int")
    frames.write_quantised_frame(frame, path, 4)
    frames.write_quantised_frame(frame.withColumn("q", F.lit(8.0)), path, 11)
    frames.write_quantised_frame(frame.withColumn("q", F.lit(9.0)), path, 11)  # replaced
    assert [r["frame"] for r in frames.frame_numbers(spark, path).collect()] == [4, 11]
    kinds = dict(spark.read.parquet(path).dtypes)
    assert {kinds[c] for c in frames.FIELDS} == {"int"}
    back = {(r["i"], r["j"]): r for r in frames.read_quantised_frame(spark, path, 4).collect()}
    assert len(back) == len(rows)
    for n, c in enumerate(frames.FIELDS):
        span = max(r[2 + n] for r in rows) - min(r[2 + n] for r in rows)
        assert all(abs(back[r[0], r[1]][c] - r[2 + n]) <= span / 4095 / 2 + 1e-12 for r in rows)
    assert all((back[r[0], r[1]]["r"], back[r[0], r[1]]["mask"]) == (r[7], r[10]) for r in rows)
    assert {r["q"] for r in frames.read_quantised_frame(spark, path, 11).collect()} == {9.0}
    assert "frame" in frames.read_quantised_frame(spark, path, 11)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]


def test_frame_numbers_come_from_names(spark, tmp_path):
    for name in ("frame=3", "frame=12", "frame=x", "frames=4", "other"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.parquet").write_bytes(b"not a table")  # never opened
    (tmp_path / "frame=99").write_text("no folder")
    assert [r["frame"] for r in frames.frame_numbers(spark, str(tmp_path)).collect()] == [3, 12]


def test_a_snapshot_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    p = adapters.particles(spark, "/root/testdata/sf0.001").limit(20)
    full = p.withColumns({c: F.lit(0).cast(t) for c, t in ((f.name, f.dataType) for f in frames.schema.PARTICLES.fields) if c not in p.columns})
    frames.write_snapshot(full, str(tmp_path), 1, 10, 0.5)
    broken = full.withColumn("pid", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        frames.write_snapshot(broken, str(tmp_path), 1, 11, 0.6)
    assert frames.read_snapshot(spark, str(tmp_path), 1)[1:] == (10, 0.5)
    frames.write_snapshot(full.limit(7), str(tmp_path), 1, 12, 0.7)
    points, step_, time = frames.read_snapshot(spark, str(tmp_path), 1)
    assert (points.count(), step_, time) == (7, 12, 0.7)
