"""Grid node update and forces on regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MODELLED, region_of
from ..params import SimParams

#: Regions whose forces are kept.
REGIONS = 100


def update_nodes(grid: DataFrame, cells: DataFrame, prm: SimParams, time: float) -> DataFrame:
    """(i, j, status, mass, vx, vy, fx, fy): velocities after drag, and momentum taken by boundaries.

    cells(i, j, status, cvx, cvy) gives region and current. Nodes outside it
    count as not modelled.
    """
    joined = grid.where(F.col("mass") != 0).join(cells.select("i", "j", "status", "cvx", "cvy"), ["i", "j"], "left")
    joined = joined.withColumn("status", F.coalesce("status", F.lit(0)))
    free = F.col("status") == MODELLED
    ramp = 1 + min(time / 7200, 2.0)
    base = joined.withColumns(
        {
            "v0x": F.try_divide("px", "mass"),
            "v0y": F.try_divide("py", "mass"),
            "ux": F.coalesce("cvx", F.lit(0.0)) * ramp,
            "uy": F.coalesce("cvy", F.lit(0.0)) * ramp,
        }
    )
    ux, uy = F.col("ux") - F.col("v0x"), F.col("uy") - F.col("v0y")
    drag = F.least(prm.dt * (prm.drag_linear + prm.drag_quadratic * F.sqrt(ux * ux + uy * uy)), F.lit(0.1))
    dragged = base.withColumns({"wx": F.col("v0x") + drag * ux, "wy": F.col("v0y") + drag * uy})
    square = F.col("wx") * F.col("wx") + F.col("wy") * F.col("wy")
    fast = ~F.isnan(square) & (square > 0.5 * prm.vmax**2)  # what isn't a number stays, to be reported

    def velocity(c: str) -> Column:
        return F.when(free & ~fast, F.col(c)).otherwise(0.0)

    return dragged.select(
        "i",
        "j",
        "status",
        "mass",
        velocity("wx").alias("vx"),
        velocity("wy").alias("vy"),
        F.when(free, 0.0).otherwise(F.col("px")).alias("fx"),
        F.when(free, 0.0).otherwise(F.col("py")).alias("fy"),
    )


def region_forces(nodes: DataFrame, elapsed: float = 1.0, regions: int = REGIONS) -> DataFrame:
    """(region, fx, fy) of every region, untouched ones with 0; normalised by the elapsed time."""
    region = region_of(F.col("status"))
    sums = nodes.groupBy(region.alias("region")).agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    every = nodes.sparkSession.range(regions).select(F.col("id").cast("int").alias("region"))
    forces = [(F.coalesce(c, F.lit(0.0)) / elapsed).alias(c) for c in ("fx", "fy")]
    return every.join(sums, "region", "left").select("region", *forces)


def labelled(forces: DataFrame, path_ids: DataFrame) -> DataFrame:
    """Forces with the names of path_ids(k, name); region k + 1 belongs to path k."""
    return forces.join(path_ids.select((F.col("k") + 1).alias("region"), "name"), "region", "left")


# Bits of the error code.
POSITION_NAN, VELOCITY_NAN, JUMPED, OUTSIDE, GRADIENT_NAN, DEFORMATION_NAN = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20
MOMENTUM_NAN, MASS_NAN, NODE_NAN = 0x100, 0x200, 0x400
POINT_ERRORS = (POSITION_NAN, VELOCITY_NAN, JUMPED, OUTSIDE, GRADIENT_NAN, DEFORMATION_NAN)
NODE_ERRORS = (MOMENTUM_NAN, MASS_NAN, NODE_NAN)


def _any_nan(*names: str) -> Column:
    found = F.isnan(names[0])
    for name in names[1:]:
        found = found | F.isnan(name)
    return found


def _bits(flags: dict[int, Column]) -> Column:
    return sum((F.coalesce(flag, F.lit(False)).cast("int") * bit for bit, flag in flags.items()), F.lit(0))


def point_errors(particles: DataFrame, gx: int, gy: int) -> DataFrame:
    """(bits) of every live particle. A particle may not enter the outermost row of nodes."""
    i, j = F.col("ci"), F.col("cj")
    far = [~F.isnan(f) & (F.abs(f) > 0.5) for f in ("fx", "fy")]
    flags = {
        POSITION_NAN: _any_nan("fx", "fy"),
        VELOCITY_NAN: _any_nan("vx", "vy"),
        JUMPED: far[0] | far[1],
        OUTSIDE: (i < 1) | (j < 1) | (i > gx - 2) | (j > gy - 2),
        GRADIENT_NAN: _any_nan("bp00", "bp01", "bp10", "bp11"),
        DEFORMATION_NAN: _any_nan("fe00", "fe01", "fe10", "fe11"),
    }
    return particles.where(~F.col("disabled")).select(_bits(flags).alias("bits"))


def node_errors(grid: DataFrame, nodes: DataFrame) -> DataFrame:
    """(bits) of every node with mass or momentum, from before and after the update."""
    before = grid.select(_bits({MOMENTUM_NAN: _any_nan("px", "py"), MASS_NAN: _any_nan("mass")}).alias("bits"))
    return before.unionByName(nodes.select(_bits({NODE_NAN: _any_nan("vx", "vy")}).alias("bits")))


def error_code(*rows: DataFrame) -> DataFrame:
    """One row: the OR of all error bits of rows(bits), how many rows have any, and how many have each."""
    whole = rows[0]
    for more in rows[1:]:
        whole = whole.unionByName(more)
    each = [F.count_if(F.col("bits").bitwiseAND(bit) != 0).alias(f"n_{bit:x}") for bit in (*POINT_ERRORS, *NODE_ERRORS)]
    return whole.agg(F.coalesce(F.bit_or("bits"), F.lit(0)).alias("code"), F.count_if(F.col("bits") != 0).alias("faulty"), *each)


def disabled_share(particles: DataFrame) -> DataFrame:
    """One row: disabled and all particles; above a twentieth it is time to squeeze."""
    return particles.agg(F.count_if("disabled").alias("disabled"), F.count(F.lit(1)).alias("particles"))
