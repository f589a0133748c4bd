"""Reader of case and data files: a mesh as tables of nodes, faces and cells, and its fields.

A file is anything with the layout of an open HDF5 file: groups as mappings,
datasets as arrays, both with ``attrs``. Files are opened by h5py, which may be
absent. Ids count from 1; a face without a cell on a side has 0 there.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .hdf5 import opened
from .mesh import field_names, join_sections, phase_name

#: Cell type of a zone whose cells have types of their own.
MIXED = 0


class Mesh(NamedTuple):
    """nodes(node_id, x, y[, z]), faces(face_id, nodes, c0, c1), cells(cell_id, zone, type), and what refinement replaced."""

    nodes: DataFrame
    faces: DataFrame
    cells: DataFrame
    parents: DataFrame
    child_faces: DataFrame


def _span(group) -> tuple[int, int]:
    return int(np.ravel(group.attrs["minId"])[0]), int(np.ravel(group.attrs["maxId"])[0])


def _sections(group: Mapping) -> list:
    return [group[str(k + 1)] for k in range(int(np.ravel(group.attrs["nSections"])[0]))]


def _arrow(spark: SparkSession, columns: dict[str, pa.Array | np.ndarray]) -> DataFrame:
    return spark.createDataFrame(pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}))


def _ids(low: int, high: int) -> np.ndarray:
    return np.arange(low, high + 1, dtype=np.int64)


def _nodes(mesh: Mapping, spark: SparkSession) -> DataFrame:
    found = []
    for zone in np.ravel(mesh["nodes/zoneTopology"]["id"]).tolist():
        section = mesh["nodes/coords"][str(zone)]
        places = np.asarray(section, float)
        found.append(_arrow(spark, {"node_id": _ids(*_span(section)), **{c: places[:, k] for k, c in enumerate("xyz"[: places.shape[1]])}}))
    return join_sections(found)


def _face_cells(mesh: Mapping, side: str, count: int) -> np.ndarray:
    cells = np.zeros(count, np.int64)
    for section in _sections(mesh[f"faces/{side}"]):
        low, high = _span(section)
        cells[low - 1 : high] = np.asarray(section, np.int64)
    return cells


def _faces(mesh: Mapping, spark: SparkSession) -> DataFrame:
    count = int(np.ravel(mesh.attrs["faceCount"])[0])
    sides = {side: _face_cells(mesh, side, count) for side in ("c0", "c1")}
    found = []
    for section in _sections(mesh["faces/nodes"]):
        low, high = _span(section)
        ends = np.concatenate([[0], np.cumsum(np.asarray(section["nnodes"], np.int64))])
        nodes = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.asarray(section["nodes"], np.int64))).cast(pa.list_(pa.int64()))
        found.append(_arrow(spark, {"face_id": _ids(low, high), "nodes": nodes, **{k: v[low - 1 : high] for k, v in sides.items()}}))
    return join_sections(found)


def _cells(mesh: Mapping, spark: SparkSession) -> DataFrame:
    topology, found = mesh["cells/zoneTopology"], []
    zones = zip(*[np.ravel(topology[k]).tolist() for k in ("id", "minId", "maxId", "cellType")], strict=True)
    for zone, low, high, kind in zones:
        types = np.full(high - low + 1, kind, np.int32)
        for section in _sections(mesh["cells/ctype"]) if kind == MIXED else []:
            first, last = _span(section)
            if first <= low and last >= high:
                types = np.asarray(section["cell-types"], np.int32)[low - first : high - first + 1]
        found.append(_arrow(spark, {"cell_id": _ids(low, high), "zone": np.full(len(types), zone, np.int32), "type": types}))
    return join_sections(found)


def _refined(mesh: Mapping, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(parents, children) of cells or faces that were refined."""
    none = np.zeros(0, np.int64)
    if f"{kind}/tree" not in mesh:
        return none, none
    tree = mesh[f"{kind}/tree/1"]
    has = np.asarray(tree["nkids"]) > 0
    return _ids(*_span(tree))[has], np.asarray(tree["kids"], np.int64)


def read_case(spark: SparkSession, file: Mapping | str) -> Mesh:
    """The mesh of an open case file, or of one at a path."""
    with opened(file) as f:
        mesh = f["meshes/1"]
        parents, _ = _refined(mesh, "cells")
        _, parts = _refined(mesh, "faces")
        return Mesh(
            _nodes(mesh, spark), _faces(mesh, spark), _cells(mesh, spark), _arrow(spark, {"cell_id": parents}), _arrow(spark, {"face_id": parts})
        )


def read_fields(spark: SparkSession, file: Mapping | str, wanted: list[str] | None = None) -> dict[str, DataFrame]:
    """Fields of a data file by name: (cell_id, value), or one column per component of a vector."""
    found: dict[str, DataFrame] = {}
    with opened(file) as f:
        results, phase = f["results/1"], 1
        while f"phase-{phase}" in results:
            cells = results[f"phase-{phase}"]["cells"]
            names = np.ravel(cells["fields"])[0]
            for name in field_names(names.decode() if isinstance(names, bytes) else str(names)):
                if wanted is not None and phase_name(phase, name) not in wanted:
                    continue
                parts = []
                for section in _sections(cells[name]):
                    values = np.asarray(section, float)
                    columns = {"value": values} if values.ndim == 1 else {f"value_{k}": values[:, k] for k in range(values.shape[1])}
                    parts.append(_arrow(spark, {"cell_id": _ids(*_span(section)), **columns}))
                found[phase_name(phase, name)] = join_sections(parts)
            phase += 1
    return found
