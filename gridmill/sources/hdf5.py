"""Optional readers of HDF5 maps and flows. They need h5py, which may be absent.

A raster is read in slabs of rows, each by the task that makes its table rows,
so a whole raster is never in one place. The file must lie where all tasks can
open it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: Pixels of a slab, about.
SLAB_PIXELS = 1 << 20


@contextmanager
def opened(file: Mapping | str) -> Iterator[Mapping]:
    """A file that is open already, or one at a path."""
    if not isinstance(file, str):
        yield file
        return
    try:
        import h5py
    except ImportError as missing:
        raise RuntimeError("HDF5 files need h5py; convert them to Parquet where it is installed") from missing
    with h5py.File(file, "r") as f:
        yield f


def raster_table(spark: SparkSession, shape: tuple[int, int], read: Callable[[int, int], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(x, y, values…) of rasters of one shape (height, width); ``read`` gives their rows from the first up to the second."""
    height, width = shape
    step = max(1, SLAB_PIXELS // max(1, width))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in batch.column(0).to_pylist():
                low, high = slab * step, min(height, (slab + 1) * step)
                arrays = read(low, high)
                if any(a.shape[:2] != (high - low, width) for a in arrays.values()):
                    raise ValueError("the rasters differ in shape")
                y, x = np.mgrid[low:high, 0:width]
                columns = {"x": x, "y": y, **arrays}
                yield pa.RecordBatch.from_arrays([pa.array(columns[n].ravel()) for n in names], names)

    ship(spark)
    slabs = -(-height // step)
    return spark.range(0, slabs, 1, max(1, slabs)).mapInArrow(run, schema)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, path_index, nx, ny, ice_status, ice_thickness) of a map file; normals are 0 where it has none."""
    with opened(path) as f:
        shape, has_normals = f["path_indices"].shape, "normals" in f

    def read(low: int, high: int) -> dict[str, np.ndarray]:
        with opened(path) as f:
            normals = f["normals"][low:high].astype(np.float32) if has_normals else np.zeros((high - low, shape[1], 2), np.float32)
            return {
                "path_index": f["path_indices"][low:high].astype(np.int32),
                "nx": normals[:, :, 0],
                "ny": normals[:, :, 1],
                "ice_status": f["iceStatus"][low:high].astype(np.int16),
                "ice_thickness": f["iceThickness"][low:high].astype(np.float32),
            }

    return raster_table(spark, shape[:2], read, "x long, y long, path_index int, nx float, ny float, ice_status short, ice_thickness float")


def read_attributes(path: str, dataset: str) -> dict[str, object]:
    """Attributes of a dataset, such as a map's window and size."""
    with opened(path) as f:
        return {k: np.ravel(v)[0].item() if np.ndim(v) == 0 or np.size(v) == 1 else np.asarray(v).tolist() for k, v in f[dataset].attrs.items()}


def read_flow(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, vx, vy) of a flow file, whose velocities must be a raster of pairs."""
    with opened(path) as f:
        shape = f["velocities"].shape
    if len(shape) != 3 or shape[2] != 2:
        raise ValueError("velocities must be a raster of pairs")

    def read(low: int, high: int) -> dict[str, np.ndarray]:
        with opened(path) as f:
            v = f["velocities"][low:high].astype(float)
        return {"vx": v[:, :, 0], "vy": v[:, :, 1]}

    return raster_table(spark, shape[:2], read, "x long, y long, vx double, vy double")
