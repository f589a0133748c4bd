"""Run parameters: JSON files, defaults and derived values."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class SimParams:
    """Simulation parameters. Defaults and JSON keys are fixed values of the file format."""

    input_png: str = field(default="", metadata={"key": "InputPNG"})
    input_map: str = field(default="", metadata={"key": "InputMap"})
    input_flow: str | None = field(default=None, metadata={"key": "InputFlowVelocity"})
    title: str = field(default="sim1", metadata={"key": "SimulationTitle"})
    dimension_horizontal: float = field(default=0.0, metadata={"key": "DimensionHorizontal"})
    save_snapshots: bool = field(default=False, metadata={"key": "SaveSnapshots"})
    use_current: bool = field(default=False, metadata={"key": "UseCurrentData"})
    snapshot_period: int = field(default=25, metadata={"key": "SnapshotPeriod"})
    start_unix_time: int = field(default=0, metadata={"key": "SimulationStartUnixTime"})
    end_time: float = field(default=20000.0, metadata={"key": "SimulationEndTime"})
    dt: float = field(default=3e-5, metadata={"key": "InitialTimeStep"})
    frame_period: float = field(default=200.0, metadata={"key": "AnimationFramePeriod"})
    youngs_modulus: float = field(default=5e8, metadata={"key": "YoungsModulus"})
    poissons_ratio: float = field(default=0.3, metadata={"key": "PoissonsRatio"})
    ice_density: float = field(default=916.0, metadata={"key": "IceDensity"})
    compressive_strength: float = field(default=100e6, metadata={"key": "IceCompressiveStrength"})
    tensile_strength: float = field(default=10e6, metadata={"key": "IceTensileStrength"})
    tensile_strength2: float = field(default=10e6, metadata={"key": "IceTensileStrength2"})
    shear_strength: float = field(default=1e6, metadata={"key": "IceShearStrength"})
    dp_phi: float = field(default=62.0, metadata={"key": "DP_phi"})
    dp_threshold: float = field(default=1e4, metadata={"key": "DP_threshold_p"})
    ridge_coeff: float = field(default=30.0, metadata={"key": "RidgeFormationCoeff"})
    drag_linear: float = field(default=0.01, metadata={"key": "waterDragEffectiveLinear"})
    drag_quadratic: float = field(default=0.01, metadata={"key": "waterDragEffectiveQuadratic"})
    n_partitions: int = field(default=1, metadata={"key": "nPartitions"})
    #: Set when the map and the points are known.
    cellsize: float = 1.0
    particle_volume: float = 1.0

    @classmethod
    def parse(cls, text: str) -> SimParams:
        """From JSON text; InputPNG and InputMap are required, unknown keys are ignored."""
        given: Mapping[str, Any] = json.loads(text)
        missing = [k for k in ("InputPNG", "InputMap") if k not in given]
        if missing:
            raise ValueError(f"required parameters are missing: {', '.join(missing)}")
        known = {f.metadata["key"]: f.name for f in fields(cls) if "key" in f.metadata}
        return cls(**{known[k]: v for k, v in given.items() if k in known})

    def on_map(self, width: int) -> SimParams:
        return replace(self, cellsize=self.dimension_horizontal / (width - 1))

    @property
    def lame_mu(self) -> float:
        return self.youngs_modulus / (2 * (1 + self.poissons_ratio))

    @property
    def lame_lambda(self) -> float:
        return self.youngs_modulus * self.poissons_ratio / ((1 + self.poissons_ratio) * (1 - 2 * self.poissons_ratio))

    @property
    def kappa(self) -> float:
        return self.lame_mu * 2 / 3 + self.lame_lambda

    @property
    def particle_mass(self) -> float:
        return self.particle_volume * self.ice_density

    @property
    def dp_inv(self) -> float:
        return 4 / self.cellsize**2

    @property
    def dt_vol_dp_inv(self) -> float:
        return self.dt * self.particle_volume * self.dp_inv

    @property
    def steps_per_frame(self) -> int:
        return int(self.frame_period / self.dt)

    @property
    def vmax(self) -> float:
        return 0.25 * self.cellsize / self.dt

    # The failure surface.
    @property
    def beta(self) -> float:
        return self.tensile_strength / self.compressive_strength

    @property
    def m_squared(self) -> float:
        span = self.compressive_strength + self.tensile_strength
        return 4 * self.shear_strength**2 * (1 + 2 * self.beta) / span**2

    @property
    def tan_phi(self) -> float:
        return math.tan(math.radians(self.dp_phi))


@dataclass(frozen=True)
class PreparerParams:
    """Parameters of the map preparation."""

    height: int
    width: int
    open_water: tuple[tuple[float, float, float], ...]
    solid: tuple[tuple[float, float, float], ...]
    main_path: str = ""
    mesh_scale: float = 0.0
    mesh_offset_x: float = 0.0
    mesh_offset_y: float = 0.0

    @classmethod
    def parse(cls, text: str) -> PreparerParams:
        given = json.loads(text)

        def curve(key: str) -> tuple[tuple[float, float, float], ...]:
            points = given.get(key)
            if not isinstance(points, list) or any(not isinstance(p, list) or len(p) != 3 for p in points):
                raise ValueError(f"{key} must be an array of colours, each of 3 numbers")
            return tuple(tuple(float(c) for c in p) for p in points)

        for key in ("Height", "Width"):
            if not isinstance(given.get(key), int):
                raise ValueError(f"{key} is required")
        return cls(
            given["Height"],
            given["Width"],
            curve("openWaterColors"),
            curve("solidColors"),
            given.get("MainPathID", ""),
            float(given.get("FLUENT_Scale", 0)),
            float(given.get("FLUENT_OffsetX", 0)),
            float(given.get("FLUENT_OffsetY", 0)),
        )
