"""Whole steps and cycles against a sequential program."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridmill.operators import frames, nodes, step
from gridmill.plans import adapters

SF = "/root/testdata/sf0.001"
PRM, GX, GY = adapters.PRM, adapters.GX, adapters.GY
STATE = ("fx", "fy", "vx", "vy", "fe00", "fe01", "fe10", "fe11", "bp00", "bp01", "bp10", "bp11", "jp_inv", "p", "q")


def weights(f):
    return {-1: 0.5 * (0.5 - f) ** 2, 0: 0.75 - f * f, 1: 0.5 * (0.5 + f) ** 2}


def yield_q(x):
    top, low = PRM.compressive_strength, -PRM.tensile_strength
    if x >= top:
        return 0.0
    cap = 2 * math.sqrt(max((top - x) * (x - low), 0)) * PRM.shear_strength / (top - low)
    return min(cap, max(0.0, (x - PRM.dp_threshold) * PRM.tan_phi))


def outside_surface(p, q):
    top, low = PRM.compressive_strength, -PRM.tensile_strength
    if p < 0:
        q0 = 2 * math.sqrt(-top * low) * PRM.shear_strength / (top - low)
        low2 = -PRM.tensile_strength2
        return p < low2 or q > -(q0 / low2) * (p - low2)
    return (1 + 2 * PRM.beta) * q * q + PRM.m_squared * (p + PRM.beta * top) * (p - top) > 0


def returned(x, fe, p, q):
    """(fe, jp_inv) of crushed material."""
    det = np.linalg.det(fe)
    u, s, vt = np.linalg.svd(fe)
    if p < PRM.dp_threshold:
        if x["jp_inv"] < 0.1:
            return math.sqrt(max(det, 0)) * u @ vt, x["jp_inv"]
        return u @ vt, x["jp_inv"] / det
    if q <= yield_q(p):
        return fe, x["jp_inv"]
    pn = min(p, PRM.ridge_coeff * 9.8 * PRM.ice_density * x["thickness"] * x["jp_inv"])
    jn = math.sqrt(max(1 - 2 * pn / PRM.kappa, 0))
    lean = yield_q(pn) * 0.5 * abs(det) / PRM.lame_mu * np.sign(s[0] ** 2 - s[1] ** 2)
    pushed = np.sqrt(np.maximum([jn + lean, jn - lean], 0))
    return u @ np.diag(pushed) @ vt, x["jp_inv"] * jn / det


def sequential_step(points, cells, time):
    grid = {}
    for x in points:
        if x["disabled"]:
            continue
        m = PRM.particle_mass * x["thickness"]
        fe = np.array([[x["fe00"], x["fe01"]], [x["fe10"], x["fe11"]]])
        bp = np.array([[x["bp00"], x["bp01"]], [x["bp10"], x["bp11"]]])
        j, c = np.linalg.det(fe), fe @ fe.T
        tau = PRM.lame_mu / j * (c - np.eye(2) * np.trace(c) / 2) + 0.5 * PRM.kappa * (j * j - 1) * np.eye(2)
        pull = m * bp - PRM.dt_vol_dp_inv * x["jp_inv"] * x["thickness"] * tau
        wx, wy = weights(x["fx"]), weights(x["fy"])
        for i in (-1, 0, 1):
            for k in (-1, 0, 1):
                w = wx[i] * wy[k]
                d = np.array([i - x["fx"], k - x["fy"]]) * PRM.cellsize
                node = grid.setdefault((x["ci"] + i, x["cj"] + k), np.zeros(3))
                node += w * np.array([m, *(m * np.array([x["vx"], x["vy"]]) + pull @ d)])
    velocity, forces = {}, {}
    for at, (mass, px, py) in grid.items():
        if mass == 0:
            continue
        status, cvx, cvy = cells.get(at, (0, 0.0, 0.0))
        if status != 100:
            region = status - 99 if status >= 100 else status
            forces[region] = forces.get(region, np.zeros(2)) + np.array([px, py])
            velocity[at] = np.zeros(2)
            continue
        v = np.array([px, py]) / mass
        to = np.array([cvx, cvy]) * (1 + min(time / 7200, 2.0)) - v
        v = v + min(PRM.dt * (PRM.drag_linear + PRM.drag_quadratic * np.linalg.norm(to)), 0.1) * to
        velocity[at] = np.zeros(2) if v @ v > 0.5 * PRM.vmax**2 else v
    out = []
    for x in points:
        x = dict(x)
        out.append(x)
        if x["disabled"]:
            continue
        wx, wy = weights(x["fx"]), weights(x["fy"])
        v, b = np.zeros(2), np.zeros((2, 2))
        for i in (-1, 0, 1):
            for k in (-1, 0, 1):
                at = velocity.get((x["ci"] + i, x["cj"] + k), np.zeros(2))
                v += wx[i] * wy[k] * at
                b += 4 / PRM.cellsize * wx[i] * wy[k] * np.outer(at, [i - x["fx"], k - x["fy"]])
        hopped = False
        for c, f, one in (("ci", "fx", v[0]), ("cj", "fy", v[1])):
            x[f] += one * PRM.dt / PRM.cellsize
            hop = 1 if x[f] > 0.5 else -1 if x[f] < -0.5 else 0
            x[f], x[c], hopped = x[f] - hop, x[c] + hop, hopped or hop != 0
        if hopped and (x["ci"] <= 1 or x["cj"] <= 1 or x["ci"] >= GX - 2 or x["cj"] >= GY - 2):
            x["disabled"] = True
        fe = (np.eye(2) + PRM.dt * b) @ np.array([[x["fe00"], x["fe01"]], [x["fe10"], x["fe11"]]])
        det, c = np.linalg.det(fe), fe @ fe.T
        p = -0.5 * PRM.kappa * (det * det - 1)
        q = math.sqrt(2) * PRM.lame_mu / det * np.linalg.norm(c - np.eye(2) * np.trace(c) / 2)
        x["crushed"] = x["crushed"] or bool(outside_surface(p, q))
        if x["crushed"]:
            fe, x["jp_inv"] = returned(x, fe, p, q)
        x.update({"vx": v[0], "vy": v[1], "p": p, "q": q})
        x.update({f"fe{r}{c}": fe[r, c] for r in (0, 1) for c in (0, 1)} | {f"bp{r}{c}": b[r, c] for r in (0, 1) for c in (0, 1)})
    return out, forces


def test_two_steps_and_their_forces_equal_a_sequential_program(spark):
    p = adapters.particles(spark, SF).where("okey < 1500").withColumn("pid", F.monotonically_increasing_id())
    p = spark.createDataFrame(p.collect(), p.schema)
    state = step.run_steps(p, adapters.cells(spark), PRM, 2, GX, GY)
    cells = {(r["i"], r["j"]): (r["status"], r["cvx"], r["cvy"]) for r in adapters.cells(spark).collect()}
    points, total = [r.asDict() for r in p.collect()], {}
    for k in range(2):
        points, forces = sequential_step(points, cells, k * PRM.dt)
        for region, f in forces.items():
            total[region] = total.get(region, np.zeros(2)) + f
    want = {x["pid"]: x for x in points}
    got = state.particles.collect()
    assert len(got) == len(want) and sum(x["crushed"] for x in points) > 100
    for r in got:
        x = want[r["pid"]]
        assert (r["ci"], r["cj"], r["crushed"], r["disabled"]) == (x["ci"], x["cj"], x["crushed"], x["disabled"])
        np.testing.assert_allclose([r[c] for c in STATE], [x[c] for c in STATE], rtol=1e-6, atol=1e-3)
    sums = {r["region"]: (r["fx"], r["fy"]) for r in state.forces.collect()}
    assert len(sums) == nodes.REGIONS and state.step == 2
    for region, f in sums.items():
        np.testing.assert_allclose(f, total.get(region, np.zeros(2)), rtol=1e-6, atol=1e3)


def test_cycles_write_frames_and_squeeze(spark, tmp_path):
    p = adapters.particles(spark, SF).withColumn("grain", F.lit(0)).withColumn("pid", F.monotonically_increasing_id())
    state, done = step.simulate(p, adapters.cells(spark), PRM, 2, 1, GX, GY, path=str(tmp_path), snapshots=True)
    assert [c.step for c in done] == [1, 2] and done[0].points == p.count() and done[0].squeezed
    assert done[0].disabled >= p.where("disabled").count() and done[1].points == done[0].points - done[0].disabled
    assert {r["frame"] for r in frames.frame_numbers(spark, f"{tmp_path}/frames").collect()} == {1, 2}
    points, at, _ = frames.read_snapshot(spark, str(tmp_path), 2)
    assert at == 2 and points.count() == done[1].points and state.particles.where("disabled").count() == done[1].disabled


def test_an_error_ends_the_run(spark):
    p = adapters.particles(spark, SF).withColumn("vx", F.when(F.col("okey") == 3, F.lit(float("nan"))).otherwise(F.col("vx")))
    _, done = step.simulate(p, adapters.cells(spark), PRM, 3, 1, GX, GY)
    assert len(done) == 1 and done[0].code & nodes.VELOCITY_NAN and done[0].code & nodes.MOMENTUM_NAN
