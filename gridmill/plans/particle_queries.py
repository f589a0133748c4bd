"""Registered queries over particles and grid nodes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as cell
from ..functions import material
from ..operators import classify, fields, gather, nodes, partition, scatter, step
from . import adapters as a
from .adapters import CELLS, DIGITS, GX, GY, IMAGE, MAP_PX, PARTICLES, PRM, STENCIL, r6, sql6

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: r6(F.col(n), digits) for n in names})


_MASS = f"({PRM.particle_mass!r} * thickness)"


@query(f"WITH {PARTICLES}, {STENCIL} SELECT i, j, {sql6(f'sum(w * {_MASS})', 3)} AS mass FROM s WHERE NOT disabled GROUP BY i, j")
def p2g_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scatter.particle_mass(a.particles(spark, sf_dir), PRM), "mass", digits=3)


_TAU = f"""
k AS (
  SELECT *, fe00 * fe11 - fe01 * fe10 AS det, fe00 * fe00 + fe01 * fe01 AS c00, fe00 * fe10 + fe01 * fe11 AS c01, fe10 * fe10 + fe11 * fe11 AS c11 FROM p
), tau AS (
  SELECT *, {PRM.lame_mu!r} / det * (c00 - c11) / 2 + {PRM.kappa!r} / 2 * (det * det - 1) AS t00,
         {PRM.lame_mu!r} / det * c01 AS t01,
         {PRM.lame_mu!r} / det * (c11 - c00) / 2 + {PRM.kappa!r} / 2 * (det * det - 1) AS t11
  FROM k
)"""
_MOMENTUM = STENCIL.replace("FROM p, o", "FROM tau p, o")


def _force(v: str, b0: str, b1: str, t0: str, t1: str) -> str:
    pull = f"{PRM.dt_vol_dp_inv!r} * jp_inv * thickness"
    return (
        f"sum(w * ({_MASS} * {v} + ({_MASS} * {b0} - {pull} * {t0}) * (di - fx) * {PRM.cellsize!r}"
        f" + ({_MASS} * {b1} - {pull} * {t1}) * (dj - fy) * {PRM.cellsize!r}))"
    )


_GRID = f"""
grid AS (
  SELECT i, j, sum(w * {_MASS}) AS mass, {_force('vx', 'bp00', 'bp01', 't00', 't01')} AS px, {_force('vy', 'bp10', 'bp11', 't01', 't11')} AS py
  FROM s WHERE NOT disabled GROUP BY i, j
)"""


@query(f"WITH {PARTICLES}, {_TAU}, {_MOMENTUM}, {_GRID} SELECT i, j, {sql6('mass', 0)} AS mass, {sql6('px', -4)} AS px, {sql6('py', -4)} AS py FROM grid")
def p2g_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = scatter.particles_to_grid(a.particles(spark, sf_dir), PRM)
    return rounded(rounded(grid, "mass", digits=0), "px", "py", digits=-4)


_FRAME = f"""
frame AS (
  SELECT i, j, sum(w) AS density, sum(w * {_MASS} * vx) / nullif(sum(w * {_MASS}), 0) AS vx, sum(w * {_MASS} * vy) / nullif(sum(w * {_MASS}), 0) AS vy,
         sum(w * jp_inv) / nullif(sum(w), 0) - 1 AS jpinv, sum(w * p) / nullif(sum(w), 0) AS p, sum(w * q) / nullif(sum(w), 0) AS q,
         sum(w * r) / nullif(sum(w), 0) AS r, sum(w * g) / nullif(sum(w), 0) AS g, sum(w * b) / nullif(sum(w), 0) AS b
  FROM s WHERE NOT disabled GROUP BY i, j
)"""
_FIELDS = ("density", "vx", "vy", "jpinv", "p", "q", "r", "g", "b")


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scatter.rasterise(a.particles(spark, sf_dir), PRM)


@query(f"WITH {PARTICLES}, {STENCIL}, {_FRAME} SELECT i, j, {', '.join(f'{sql6(c)} AS {c}' for c in _FIELDS)} FROM frame")
def frame_rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_frame(spark, sf_dir), *_FIELDS)


#: Whole-number colours are cut off a little above the ties of equal sums taken in another order.
_NUDGE = 1e-7
_MASKED = """
masked AS (
  SELECT frame.i, frame.j, CASE WHEN density > 0.1 THEN 1 ELSE 0 END AS mask, status,
         least(greatest(density, 0), 1) AS alpha, frame.* EXCLUDE (i, j) FROM frame LEFT JOIN cells ON frame.i = cells.i AND frame.j = cells.j
)"""


def _blend(c: str, w: int) -> str:
    return f"CAST(floor(alpha * floor(least(greatest({c} + {_NUDGE}, 0), 255)) + (1 - alpha) * {w} + {_NUDGE}) AS INTEGER)"


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _frame(spark, sf_dir)
    nudged = frame.withColumns({c: F.col(c) + _NUDGE for c in "rgb"})
    return scatter.masked(nudged, a.cells(spark))


@query(
    f"WITH {PARTICLES}, {STENCIL}, {_FRAME}, {CELLS}, {_MASKED} SELECT i, j, mask, "
    + ", ".join(f"{sql6(f'CASE WHEN mask = 1 AND status = 100 THEN {c} ELSE 0 END')} AS {c}" for c in ("jpinv", "p", "q", "vx", "vy"))
    + " FROM masked"
)
def frame_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_masked(spark, sf_dir), "jpinv", "p", "q", "vx", "vy").drop("r", "g", "b", "density")


@query(f"WITH {PARTICLES} SELECT ci, cj, count(*) AS n, count(*) % 256 AS n_byte FROM p GROUP BY ci, cj")
def points_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scatter.points_per_cell(a.particles(spark, sf_dir)).withColumn("n_byte", F.col("n") % 256)


@query(
    f"""WITH {PARTICLES}, c AS (SELECT count(*) AS n FROM p GROUP BY ci, cj), f AS (SELECT n, count(*) AS cells FROM c GROUP BY n)
SELECT * FROM f UNION ALL SELECT 0, {GX * GY} - CAST(sum(cells) AS BIGINT) FROM f"""
)
def fill_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scatter.fill_histogram(a.particles(spark, sf_dir), GX, GY)


@query(
    f"WITH {PARTICLES}, {STENCIL}, {_FRAME} "
    + " UNION ALL ".join(f"SELECT '{c}' AS field, {sql6(f'min({c})')} AS low, {sql6(f'max({c})')} AS high FROM frame" for c in ("jpinv", "p", "q", "vx", "vy"))
)
def field_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fields.extremes(_frame(spark, sf_dir), ["jpinv", "p", "q", "vx", "vy"]), "low", "high")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.update_nodes(scatter.particles_to_grid(a.particles(spark, sf_dir), PRM), a.cells(spark), PRM, 3600.0)


_NODES = f"""
n0 AS (
  SELECT grid.*, coalesce(status, 0) AS status, px / mass AS v0x, py / mass AS v0y,
         1.5 * coalesce(cvx, 0) AS cx, 1.5 * coalesce(cvy, 0) AS cy
  FROM grid LEFT JOIN cells ON grid.i = cells.i AND grid.j = cells.j WHERE mass <> 0
), n1 AS (
  SELECT *, least({PRM.dt!r} * ({PRM.drag_linear!r} + {PRM.drag_quadratic!r} * sqrt((cx - v0x) * (cx - v0x) + (cy - v0y) * (cy - v0y))), 0.1) AS k FROM n0
), n2 AS (
  SELECT *, v0x + k * (cx - v0x) AS wx, v0y + k * (cy - v0y) AS wy FROM n1
), nodes AS (
  SELECT i, j, status, mass,
         CASE WHEN status = 100 AND (isnan(wx * wx + wy * wy) OR NOT wx * wx + wy * wy > {0.5 * PRM.vmax**2!r}) THEN wx ELSE 0 END AS vx,
         CASE WHEN status = 100 AND (isnan(wx * wx + wy * wy) OR NOT wx * wx + wy * wy > {0.5 * PRM.vmax**2!r}) THEN wy ELSE 0 END AS vy,
         CASE WHEN status = 100 THEN 0 ELSE px END AS fx, CASE WHEN status = 100 THEN 0 ELSE py END AS fy
  FROM n2
)"""
_TO_NODES = f"{PARTICLES}, {_TAU}, {_MOMENTUM}, {_GRID}, {CELLS}, {_NODES}"


@query(f"WITH {_TO_NODES} SELECT i, j, status, {sql6('vx', 3)} AS vx, {sql6('vy', 3)} AS vy, {sql6('fx', -4)} AS fx, {sql6('fy', -4)} AS fy FROM nodes")
def node_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(_nodes(spark, sf_dir).drop("mass"), "vx", "vy", digits=3), "fx", "fy", digits=-4)


_FORCES = f"""
forces AS (
  SELECT region, coalesce(sum(fx), 0) / 300.0 AS fx, coalesce(sum(fy), 0) / 300.0 AS fy
  FROM (SELECT CAST(range AS INTEGER) AS region FROM range({nodes.REGIONS})) r
  LEFT JOIN (SELECT CASE WHEN status >= 100 THEN status - 99 ELSE status END AS region, fx, fy FROM nodes) n USING (region) GROUP BY region
)"""


def _forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.region_forces(_nodes(spark, sf_dir), 300.0)


@query(f"WITH {_TO_NODES}, {_FORCES} SELECT region, {sql6('fx', -4)} AS fx, {sql6('fy', -4)} AS fy FROM forces")
def force_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_forces(spark, sf_dir), "fx", "fy", digits=-4)


@query(
    f"WITH {_TO_NODES}, {_FORCES} SELECT region, {sql6('fx', -4)} AS fx, {sql6('fy', -4)} AS fy, n_name AS name FROM forces LEFT JOIN nation ON n_nationkey + 1 = region"
)
def region_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = a.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return rounded(nodes.labelled(_forces(spark, sf_dir), ids), "fx", "fy", digits=-4)


#: Particles some of which are broken: what isn't a number, a jump, and cells outside.
_BREAKS = {
    "vx": ("vx", "okey % 501 = 3", "'NaN'"),
    "fe01": ("fe01", "okey % 499 = 7", "'NaN'"),
    "bp10": ("bp10", "okey % 503 = 11", "'NaN'"),
    "fy": ("fy", "okey % 509 = 13", "'NaN'"),
    "thickness": ("thickness", "okey % 521 = 17", "'NaN'"),
    "fx": ("fx", "okey % 97 = 5", "fx + 0.6"),
}
_BROKEN = PARTICLES.replace("), p AS (", "), whole AS (") + ", p AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {when} THEN CAST({value} AS DOUBLE) ELSE {c} END AS {name}" for name, (c, when, value) in _BREAKS.items()
) + ") FROM whole)"
_POINT_BITS = (
    "CAST(isnan(fx) OR isnan(fy) AS INTEGER) + 2 * CAST(isnan(vx) OR isnan(vy) AS INTEGER)"
    " + 4 * CAST((NOT isnan(fx) AND abs(fx) > 0.5) OR (NOT isnan(fy) AND abs(fy) > 0.5) AS INTEGER)"
    " + 8 * CAST(ci < 1 OR cj < 1 OR ci > 98 OR cj > 33 AS INTEGER)"
    " + 16 * CAST(isnan(bp00) OR isnan(bp01) OR isnan(bp10) OR isnan(bp11) AS INTEGER)"
    " + 32 * CAST(isnan(fe00) OR isnan(fe01) OR isnan(fe10) OR isnan(fe11) AS INTEGER)"
)
_ERROR_BITS = (1, 2, 4, 8, 16, 32, 256, 512, 1024)


@query(
    f"""WITH {_TO_NODES.replace(PARTICLES, _BROKEN)}, b AS (
  SELECT {_POINT_BITS} AS bits FROM p WHERE NOT disabled
  UNION ALL SELECT 256 * CAST(isnan(px) OR isnan(py) AS INTEGER) + 512 * CAST(isnan(mass) AS INTEGER) FROM grid
  UNION ALL SELECT 1024 * CAST(isnan(vx) OR isnan(vy) AS INTEGER) FROM nodes
) SELECT CAST(bit_or(bits) AS INTEGER) AS code, count(*) FILTER (WHERE bits <> 0) AS faulty, """
    + ", ".join(f"count(*) FILTER (WHERE bits & {b} <> 0) AS n_{b:x}" for b in _ERROR_BITS)
    + " FROM b"
)
def error_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error code of a step over particles some of which are broken, on a grid of 100 x 35."""
    broken = {name: F.when(F.expr(when.replace("=", "==")), F.expr(value).cast("double")).otherwise(F.col(c)) for name, (c, when, value) in _BREAKS.items()}
    p = a.particles(spark, sf_dir).withColumns(broken)
    grid = scatter.particles_to_grid(p, PRM)
    return nodes.error_code(nodes.point_errors(p, 100, 35), nodes.node_errors(grid, nodes.update_nodes(grid, a.cells(spark), PRM, 3600.0)))


@query(f"WITH {PARTICLES} SELECT count(*) FILTER (WHERE disabled) AS disabled, count(*) AS particles FROM p")
def disabled_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.disabled_share(a.particles(spark, sf_dir))


@query(f"WITH {PARTICLES} SELECT okey, line, ci, cj, {sql6('fx')} AS fx, {sql6('fy')} AS fy, CAST(cj AS BIGINT) * 65536 + ci AS packed, CAST(ci AS BIGINT) * {GY} + cj AS linear FROM p")
def cell_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.particles(spark, sf_dir)
    return rounded(
        p.select(
            "okey", "line", "ci", "cj", "fx", "fy", cell.packed(F.col("ci"), F.col("cj")).alias("packed"), cell.linear(F.col("ci"), F.col("cj"), GY).alias("linear")
        ),
        "fx",
        "fy",
    )


@query(
    f"""WITH {PARTICLES}, f AS (SELECT okey, line, ci, cj, fx, fy, okey % 65536 + CASE WHEN crushed THEN 65536 ELSE 0 END + CASE WHEN disabled THEN 131072 ELSE 0 END AS word FROM p)
SELECT okey, line, {sql6('(fx + ci) * 215')} AS x, {sql6('(fy + cj) * 215')} AS y, CAST(word % 65536 AS INTEGER) AS grain,
       word // 65536 % 2 = 1 AS crushed, word // 131072 % 2 = 1 AS disabled, word // 262144 % 2 = 1 AS weakened, ci AS ui, cj AS uj FROM f"""
)
def cell_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.particles(spark, sf_dir)
    word = F.col("okey") % 65536 + F.when(F.col("crushed"), cell.CRUSHED).otherwise(0) + F.when(F.col("disabled"), cell.DISABLED).otherwise(0)
    ui, uj = cell.unpacked(cell.packed(F.col("ci"), F.col("cj")))
    placed = cell.decode(p, PRM.cellsize).withColumn("word", word)
    flags = [c.alias(n) for n, c in cell.flags(F.col("word")).items()]
    return rounded(placed.select("okey", "line", "x", "y", *flags, ui.alias("ui"), uj.alias("uj")), "x", "y")


@query(
    f"""WITH {PARTICLES}, {CELLS}, {IMAGE}, {MAP_PX}
SELECT okey, line, ci, cj, image.r, image.g, image.b, {sql6('ice_thickness')} AS thickness, ice_status = 1 AS crushed
FROM p JOIN map_px m ON m.x = ci AND m.y = cj AND ice_status IN (1, 2) LEFT JOIN image ON image.x = ci AND image.y = cj
WHERE NOT (ci <= 1 OR cj <= 1 OR ci >= {GX - 2} OR cj >= {GY - 2})"""
)
def point_color_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = a.particles(spark, sf_dir).select("okey", "line", "ci", "cj", "fx", "fy")
    found = classify.initial_points(points, a.map_px(spark), a.image(spark), GX, GY)
    return rounded(found.select("okey", "line", "ci", "cj", "r", "g", "b", "thickness", "crushed"), "thickness")


@query(
    f"""WITH {PARTICLES}, {CELLS}, {MAP_PX} SELECT okey, line, ci, cj FROM p
WHERE NOT (ci <= 1 OR cj <= 1 OR ci >= {GX - 2} OR cj >= {GY - 2}) AND EXISTS (SELECT 1 FROM map_px WHERE x = ci AND y = cj AND ice_status IN (1, 2))"""
)
def point_mask_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = a.particles(spark, sf_dir).select("okey", "line", "ci", "cj")
    return classify.on_ice(points, a.map_px(spark), GX, GY)


#: A plain field on the nodes, so that gathering is checked apart from scattering.
_FLOW = "vel AS (SELECT i, j, cvx + CAST(0.001 AS DOUBLE) * j AS vx, cvy - CAST(0.001 AS DOUBLE) * i AS vy FROM cells)"
_GATHERED = f"""
r AS (SELECT *, row_number() OVER () AS rid FROM p),
{STENCIL.replace('FROM p, o', 'FROM r p, o')},
got AS (
  SELECT s.rid, coalesce(sum(w * vel.vx), 0) AS gvx, coalesce(sum(w * vel.vy), 0) AS gvy,
         coalesce(sum(w * vel.vx * (di - fx)), 0) * 4 / 215 AS b00, coalesce(sum(w * vel.vx * (dj - fy)), 0) * 4 / 215 AS b01,
         coalesce(sum(w * vel.vy * (di - fx)), 0) * 4 / 215 AS b10, coalesce(sum(w * vel.vy * (dj - fy)), 0) * 4 / 215 AS b11
  FROM s LEFT JOIN vel ON vel.i = s.i AND vel.j = s.j GROUP BY s.rid
)"""


def _velocities(spark: SparkSession) -> DataFrame:
    c = a.cells(spark)
    return c.select("i", "j", (F.col("cvx") + 0.001 * F.col("j")).alias("vx"), (F.col("cvy") - 0.001 * F.col("i")).alias("vy"))


@query(
    f"WITH {PARTICLES}, {CELLS}, {_FLOW}, {_GATHERED} SELECT okey, line, {sql6('gvx', 9)} AS vx, {sql6('gvy', 9)} AS vy, "
    + ", ".join(f"{sql6(f'b{k}', 9)} AS b{k}" for k in ("00", "01", "10", "11"))
    + " FROM r JOIN got USING (rid)"
)
def gather_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gather.gather(a.particles(spark, sf_dir), _velocities(spark), PRM, (GX, GY))
    names = {"gvx": "vx", "gvy": "vy", **{f"gb{k}": f"b{k}" for k in ("00", "01", "10", "11")}}
    out = g.select("okey", "line", *[F.col(c).alias(n) for c, n in names.items()])
    return rounded(out, *names.values(), digits=9)


_H = PRM.dt / PRM.cellsize
_HOPS = "CASE WHEN m{0} > 0.5 THEN 1 WHEN m{0} < -0.5 THEN -1 ELSE 0 END"


@query(
    f"""WITH {PARTICLES}, {CELLS}, {_FLOW}, {_GATHERED}, m AS (
  SELECT r.*, got.* EXCLUDE (rid), fx + 5000 * gvx * {_H!r} AS mx, fy + 5000 * gvy * {_H!r} AS my FROM r JOIN got USING (rid)
) SELECT okey, line, ci + {_HOPS.format('x')} AS ci, cj + {_HOPS.format('y')} AS cj, {sql6(f"mx - {_HOPS.format('x')}", 9)} AS fx, {sql6(f"my - {_HOPS.format('y')}", 9)} AS fy,
  {sql6(f'(1 + {PRM.dt!r} * 5000 * b00) * fe00 + {PRM.dt!r} * 5000 * b01 * fe10', 9)} AS fe00, {sql6(f'(1 + {PRM.dt!r} * 5000 * b00) * fe01 + {PRM.dt!r} * 5000 * b01 * fe11', 9)} AS fe01,
  {sql6(f'{PRM.dt!r} * 5000 * b10 * fe00 + (1 + {PRM.dt!r} * 5000 * b11) * fe10', 9)} AS fe10, {sql6(f'{PRM.dt!r} * 5000 * b10 * fe01 + (1 + {PRM.dt!r} * 5000 * b11) * fe11', 9)} AS fe11
FROM m"""
)
def advect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities are scaled up so that particles do leave their cells."""
    fast = _velocities(spark).withColumns({c: F.col(c) * 5000 for c in ("vx", "vy")})
    out = gather.advance(gather.gather(a.particles(spark, sf_dir), fast, PRM, (GX, GY)), PRM)
    names = ("fx", "fy", "fe00", "fe01", "fe10", "fe11")
    return rounded(out.select("okey", "line", "ci", "cj", *names), *names, digits=9)


@query(f"WITH {PARTICLES}, {_TAU} SELECT okey, line, {sql6('t00', 0)} AS t00, {sql6('t01', 0)} AS t01, {sql6('t01', 0)} AS t10, {sql6('t11', 0)} AS t11 FROM tau")
def kirchhoff_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    tau = material.kirchhoff(material.matrix("fe"), PRM)
    names = ("t00", "t01", "t10", "t11")
    return rounded(a.particles(spark, sf_dir).select("okey", "line", *[t.alias(n) for t, n in zip(tau, names, strict=True)]), *names, digits=0)


_TRIAL = f"""
trial AS (
  SELECT *, -{PRM.kappa!r} / 2 * (det * det - 1) AS tp,
         {PRM.lame_mu!r} / det * sqrt((c00 - c11) * (c00 - c11) + 4 * c01 * c01) AS tq
  FROM k
)"""


@query(f"WITH {PARTICLES}, {_TAU}, {_TRIAL} SELECT okey, line, {sql6('tp', 0)} AS p, {sql6('tq', 0)} AS q FROM trial")
def trial_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = material.trial(material.matrix("fe"), PRM)
    return rounded(a.particles(spark, sf_dir).select("okey", "line", p.alias("p"), q.alias("q")), "p", "q", digits=0)


_PMAX, _PMIN, _QMAX = PRM.compressive_strength, -PRM.tensile_strength, PRM.shear_strength
_Q0 = 2 * math.sqrt(-_PMAX * _PMIN) * _QMAX / (_PMAX - _PMIN)


@query(
    f"""WITH {PARTICLES}, {_TAU}, {_TRIAL}
SELECT okey, line, CASE WHEN tp < 0 THEN tp < {_PMIN!r} OR tq > {_Q0!r} - {_Q0!r} * tp / {_PMIN!r}
  ELSE {1 + 2 * PRM.beta!r} * tq * tq + {PRM.m_squared!r} * (tp * tp + tp * {(PRM.beta - 1) * _PMAX!r} - {PRM.beta * _PMAX * _PMAX!r}) > 0 END AS crushed FROM trial"""
)
def crush_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, q = material.trial(material.matrix("fe"), PRM)
    return a.particles(spark, sf_dir).select("okey", "line", p.alias("p"), q.alias("q")).select(
        "okey", "line", material.crushed(F.col("p"), F.col("q"), PRM).alias("crushed")
    )


#: Singular values from the eigenvalues of F F^T; the smaller one takes the sign of det F.
_SIGMA = """
sigma AS (
  SELECT *, sqrt((c00 + c11 + sqrt((c00 - c11) * (c00 - c11) + 4 * c01 * c01)) / 2) AS s0,
         sign(det) * sqrt(greatest(c00 + c11 - sqrt((c00 - c11) * (c00 - c11) + 4 * c01 * c01), 0) / 2) AS s1
  FROM trial
)"""


@query(
    f"WITH {PARTICLES}, {_TAU}, {_TRIAL}, {_SIGMA} SELECT okey, line, {sql6('s0')} AS s0, {sql6('s1')} AS s1, "
    + ", ".join(f"{sql6(f'fe{k}')} AS f{k}" for k in ("00", "01", "10", "11"))
    + " FROM sigma"
)
def svd2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = material.svd(material.matrix("fe"))
    whole = s.rebuilt(s.s0, s.s1)
    names = ("f00", "f01", "f10", "f11")
    out = a.particles(spark, sf_dir).select("okey", "line", s.s0.alias("s0"), s.s1.alias("s1"), *[w.alias(n) for w, n in zip(whole, names, strict=True)])
    return rounded(out, "s0", "s1", *names)


def _qy(x: str) -> str:
    return (
        f"CASE WHEN {x} < {_PMAX!r} THEN least(2 * sqrt(greatest(({_PMAX!r} - ({x})) * (({x}) - {_PMIN!r}), 0)) * {_QMAX / (_PMAX - _PMIN)!r},"
        f" greatest(0, (({x}) - {PRM.dp_threshold!r}) * {PRM.tan_phi!r})) ELSE 0 END"
    )


_PN = f"least(tp, {PRM.ridge_coeff * 9.8 * PRM.ice_density!r} * thickness * jp_inv)"


@query(
    f"""WITH {PARTICLES}, {_TAU}, {_TRIAL}, {_SIGMA}, y AS (
  SELECT *, {_PN} AS pn, CASE WHEN tp < {PRM.dp_threshold!r} AND jp_inv < 0.1 THEN 0 WHEN tp < {PRM.dp_threshold!r} THEN 1 WHEN tq <= {_qy('tp')} THEN 2 ELSE 3 END AS kind FROM sigma
), z AS (
  SELECT *, sqrt(greatest(1 - 2 * pn / {PRM.kappa!r}, 0)) AS jn, {_qy('pn')} * abs(det) / {2 * PRM.lame_mu!r} AS lean FROM y
), g AS (
  SELECT *, CASE kind WHEN 0 THEN sqrt(det) WHEN 1 THEN 1 WHEN 2 THEN s0 ELSE sqrt(greatest(jn + lean, 0)) END AS x,
         CASE kind WHEN 0 THEN sqrt(det) WHEN 1 THEN 1 WHEN 2 THEN s1 ELSE sqrt(greatest(jn - lean, 0)) END AS y FROM z
), h AS (  -- U diag(x, y) V^T is a mix of F and its cofactors
  SELECT *, (x * s0 - y * s1) / (s0 * s0 - s1 * s1) AS u, (y * s0 - x * s1) / (s0 * s0 - s1 * s1) AS v FROM g
) SELECT okey, line, kind AS case_, {sql6('u * fe00 + v * fe11')} AS fe00, {sql6('u * fe01 - v * fe10')} AS fe01, {sql6('u * fe10 - v * fe01')} AS fe10,
         {sql6('u * fe11 + v * fe00')} AS fe11, {sql6('CASE kind WHEN 1 THEN jp_inv / det WHEN 3 THEN jp_inv * jn / det ELSE jp_inv END')} AS jp_inv FROM h"""
)
def return_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = material.return_map(a.particles(spark, sf_dir), PRM)
    names = [f"fe{k}" for k in material.ENTRIES] + ["jp_inv"]
    return rounded(back.select("okey", "line", F.col("r_case").alias("case_"), *[F.col(f"r_{n}").alias(n) for n in names]), *names)


_PARTS = 7
#: Where each part ends: part k takes what is left over the parts left, rounded down.
_ENDS = ", ".join(
    ["c0 AS (SELECT count(*) AS n, count(*) // 7 AS e0 FROM p)"] + [f"c{k} AS (SELECT *, e{k - 1} + (n - e{k - 1}) // {_PARTS - k} AS e{k} FROM c{k - 1})" for k in range(1, _PARTS)]
)


@query(
    f"""WITH {PARTICLES}, {_ENDS}, r AS (
  SELECT okey, line, ci, cj, row_number() OVER (ORDER BY ci, cj, okey, line, fx, fy) - 1 AS rank FROM p
) SELECT part, count(*) AS n, min(ci * 1000 + cj) AS first_cell, max(ci * 1000 + cj) AS last_cell FROM (
  SELECT *, CASE """
    + " ".join(f"WHEN rank < e{k} THEN {k}" for k in range(_PARTS))
    + f""" END AS part FROM r, c{_PARTS - 1}
) GROUP BY part"""
)
def equal_count_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col(c) for c in ("ci", "cj", "okey", "line", "fx", "fy")]
    split = partition.equal_split(a.particles(spark, sf_dir).select("ci", "cj", "okey", "line", "fx", "fy"), _PARTS, order)
    code = F.col("ci") * 1000 + F.col("cj")
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("first_cell"), F.max(code).alias("last_cell"))


@query(f"WITH {PARTICLES} SELECT okey, line, {sql6('fx')} AS fx, {sql6('fy')} AS fy FROM p WHERE ci = 31 AND cj = 12")
def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of one cell."""
    return rounded(partition.find_cell(a.particles(spark, sf_dir), 31, 12).select("okey", "line", "fx", "fy"), "fx", "fy")


@query(f"WITH {PARTICLES} SELECT okey, line, ci, cj FROM p WHERE NOT disabled")
def squeeze_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.squeeze(a.particles(spark, sf_dir)).select("okey", "line", "ci", "cj")


@query(None)
def step_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two whole steps; a sequential program checks them in the tests."""
    return step.run_steps(a.particles(spark, sf_dir), a.cells(spark), PRM, 2, GX, GY).particles


@query(None)
def force_accumulate_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary forces summed over two steps; checked as step_k is."""
    return step.run_steps(a.particles(spark, sf_dir), a.cells(spark), PRM, 2, GX, GY).forces
