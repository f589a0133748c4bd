"""Grid nodes to particles, and the particle update.

Each cell's nine nodes are first put side by side in one row. Particles then
meet their stencil in a single equi-join on the cell: they are neither
multiplied nor grouped, and need no id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import at_rim
from ..functions.material import ENTRIES, Matrix, crushed, matrix, return_map, trial
from ..functions.stencil import STENCIL, weight2
from ..params import SimParams
from ..plans.lineage import apart


#: Cells whose stencils are broadcast at most: of 19 numbers each.
BROADCAST_CELLS = 100_000


def stencils(grid: DataFrame, columns: tuple[str, ...] = ("vx", "vy")) -> DataFrame:
    """(ci, cj, c_0 … c_8 for each column c): the nodes around every cell that has any."""
    spread = grid.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        (F.col("i") - di).alias("ci"), (F.col("j") - dj).alias("cj"), F.lit(k).alias("k"), *[F.col(c) for c in columns]
                    )
                    for k, (di, dj) in enumerate(STENCIL)
                ]
            )
        )
    )
    return spread.groupBy("ci", "cj").agg(
        *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for c in columns for k in range(len(STENCIL))]
    )


def _node(c: str, k: int) -> Column:
    return F.coalesce(F.col(f"{c}_{k}"), F.lit(0.0))


def gather(particles: DataFrame, grid: DataFrame, prm: SimParams, size: tuple[int, int] | None = None) -> DataFrame:
    """Particles with velocity (gvx, gvy) and velocity gradient gb00 … gb11 of their nodes.

    ``size``: the grid's extent where it is known; cells beyond its rim have no
    nodes then. Up to BROADCAST_CELLS cells go to the particles, which needn't
    be shuffled; a larger grid meets them in a shuffle join.
    """
    fx, fy = F.col("fx"), F.col("fy")
    around = stencils(grid)
    if size and (size[0] + 2) * (size[1] + 2) <= BROADCAST_CELLS:
        around = F.broadcast(around.where(F.col("ci").between(-1, size[0]) & F.col("cj").between(-1, size[1])))
    joined = particles.join(around, ["ci", "cj"], "left")
    # Weights and nodes are columns of their own: written out in every sum, they make a method that is too large to be compiled.
    used = {f"{c}_{k}": _node(c, k) for c in ("vx", "vy") for k in range(len(STENCIL))}
    weights = {f"w_{k}": weight2(fx, fy, di, dj) for k, (di, dj) in enumerate(STENCIL)}
    joined = apart(joined.withColumns({**used, **weights}))
    scale = 4 / prm.cellsize

    def total(value) -> Column:
        terms = [F.col(f"w_{k}") * value(k, di, dj) for k, (di, dj) in enumerate(STENCIL)]
        return sum(terms[1:], terms[0])

    out = {f"g{c}": total(lambda k, di, dj, c=c: F.col(f"{c}_{k}")) for c in ("vx", "vy")}
    for row, c in enumerate(("vx", "vy")):
        out[f"gb{row}0"] = scale * total(lambda k, di, dj, c=c: F.col(f"{c}_{k}") * (di - fx))
        out[f"gb{row}1"] = scale * total(lambda k, di, dj, c=c: F.col(f"{c}_{k}") * (dj - fy))
    return apart(joined.withColumns(out).drop(*used, *weights))


def advance(gathered: DataFrame, prm: SimParams) -> DataFrame:
    """Move particles, hop to the next cell where one leaves its own, and update fe."""
    out = gathered
    for c, f, v in (("ci", "fx", "gvx"), ("cj", "fy", "gvy")):
        moved = F.col(f) + F.col(v) * prm.dt / prm.cellsize
        hop = F.when(moved > 0.5, 1).when(moved < -0.5, -1).otherwise(0)
        out = out.withColumns({f: moved - hop, c: (F.col(c) + hop).cast("int")})
    b, one = matrix("gb"), F.lit(1.0)
    step = Matrix(one + prm.dt * b.a, prm.dt * b.b, prm.dt * b.c, one + prm.dt * b.d)
    fe = step.times(matrix("fe"))
    out = out.withColumns({f"n{k}": e for k, e in zip(ENTRIES, fe, strict=True)})
    return out.withColumns(
        {
            "vx": F.col("gvx"),
            "vy": F.col("gvy"),
            **{f"fe{k}": F.col(f"n{k}") for k in ENTRIES},
            **{f"bp{k}": F.col(f"gb{k}") for k in ENTRIES},
        }
    ).drop("gvx", "gvy", *[p + k for p in ("n", "gb") for k in ENTRIES])


def leave_rim(before: DataFrame, gx: int, gy: int) -> DataFrame:
    """Disable particles that have hopped into the rim; needs old_ci and old_cj."""
    hopped = (F.col("ci") != F.col("old_ci")) | (F.col("cj") != F.col("old_cj"))
    return before.withColumn("disabled", F.col("disabled") | (hopped & at_rim(F.col("ci"), F.col("cj"), gx, gy)))


def settle(particles: DataFrame, prm: SimParams) -> DataFrame:
    """Pressure and deviator, crush test, and plastic return of crushed particles."""
    p, q = trial(matrix("fe"), prm)
    tested = apart(particles.withColumns({"p": p, "q": q}))
    tested = tested.withColumn("crushed", F.col("crushed") | F.coalesce(crushed(F.col("p"), F.col("q"), prm), F.lit(False)))
    back = return_map(tested, prm)
    new = {f"fe{k}": F.when(F.col("crushed"), F.col(f"r_fe{k}")).otherwise(F.col(f"fe{k}")) for k in ENTRIES}
    return back.withColumns({**new, "jp_inv": F.when(F.col("crushed"), F.col("r_jp_inv")).otherwise(F.col("jp_inv"))})


def update_particles(particles: DataFrame, grid: DataFrame, prm: SimParams, gx: int, gy: int) -> DataFrame:
    """One grid-to-particle step; disabled particles stay as they are."""
    columns = particles.columns
    live = particles.where(~F.col("disabled")).withColumns({"old_ci": F.col("ci"), "old_cj": F.col("cj")})
    moved = leave_rim(advance(gather(live, grid, prm, (gx, gy)), prm), gx, gy)
    return settle(moved, prm).select(*columns).unionByName(particles.where("disabled"))
