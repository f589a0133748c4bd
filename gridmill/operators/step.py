"""The time-step loop: particles to grid, node update, grid to particles; forces, frames and snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..params import SimParams
from ..plans.lineage import cut
from . import frames
from .gather import update_particles
from .nodes import error_code, node_errors, point_errors, region_forces, update_nodes
from .partition import needs_squeeze, squeeze
from .scatter import masked, particles_to_grid, rasterise


@dataclass(frozen=True)
class State:
    """Particles at a step, and the forces that the boundaries took since the last reset, as sums."""

    particles: DataFrame
    forces: DataFrame | None = None
    step: int = 0


@dataclass(frozen=True)
class Cycle:
    """What a cycle of steps reports."""

    step: int
    time: float
    points: int
    disabled: int
    code: int
    squeezed: bool


def step(particles: DataFrame, cells: DataFrame, prm: SimParams, time: float, gx: int, gy: int) -> tuple[DataFrame, DataFrame]:
    """(particles, nodes) after one step."""
    nodes = update_nodes(particles_to_grid(particles, prm), cells, prm, time)
    return update_particles(particles, nodes, prm, gx, gy), nodes


def run_steps(
    particles: DataFrame, cells: DataFrame, prm: SimParams, steps: int, gx: int, gy: int, every: int = 1, first: int = 0
) -> State:
    """Particles after a number of steps, and the boundary forces summed over them.

    A step's nodes are few against the particles and serve twice, for particles
    and forces, so they are stored at each step. A step also reads its
    particles twice, and the expressions of two steps are too long for one
    generated method, so particles are stored at each step as well, unless
    ``every`` says otherwise.
    """
    now, sums = particles, None
    for k in range(first, first + steps):
        nodes = cut(update_nodes(particles_to_grid(now, prm), cells, prm, k * prm.dt))
        now = update_particles(now, nodes, prm, gx, gy)
        if (k + 1 - first) % every == 0 or k + 1 == first + steps:
            now = cut(now)
        taken = region_forces(nodes)
        sums = taken if sums is None else sums.unionByName(taken)
    if sums is not None:
        sums = cut(sums.groupBy("region").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy")))
    return State(now, sums, first + steps)


def simulate(
    particles: DataFrame, cells: DataFrame, prm: SimParams, cycles: int, steps: int, gx: int, gy: int, path: str | None = None, snapshots: bool = False
) -> tuple[State, list[Cycle]]:
    """Cycles of steps, each with its frame, forces and, if asked for, a snapshot below ``path``.

    Forces are divided by the time of a cycle. Particles are squeezed and laid
    out anew when more than a twentieth of them is disabled; the run ends at
    the first cycle with an error.
    """
    state, done = State(particles), []
    for number in range(1, cycles + 1):
        state = run_steps(state.particles, cells, prm, steps, gx, gy, first=state.step)
        time = state.step * prm.dt
        counted = Observation(f"cycle-{number}")
        watched = state.particles.observe(counted, F.count(F.lit(1)).alias("points"), F.count_if("disabled").alias("disabled"))
        grid = particles_to_grid(state.particles, prm)
        code = error_code(point_errors(watched, gx, gy), node_errors(grid, update_nodes(grid, cells, prm, time))).first()["code"]
        points, disabled = counted.get["points"], counted.get["disabled"]
        if path:
            frames.write_frame(masked(rasterise(state.particles, prm), cells), f"{path}/frames", number)
            forces = state.forces.select("region", *[(F.col(c) / (steps * prm.dt)).alias(c) for c in ("fx", "fy")])
            frames.write_forces(forces, f"{path}/forces", number)
            if snapshots:
                frames.write_snapshot(state.particles, path, number, state.step, time)
        tight = needs_squeeze(disabled, points)
        if tight:
            state = State(cut(squeeze(state.particles)), state.forces, state.step)
        done.append(Cycle(state.step, time, points, disabled, code, tight))
        if code:
            break
    return state, done
