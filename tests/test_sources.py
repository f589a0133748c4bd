"""Readers and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.operators import fields, frames
from gridmill.sources import case, hdf5, mesh, png, svg
from gridmill.streaming.frames import frame_sums, store_forces


def test_png_round_trip(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(pixels))
    rows = png.read_png(spark, str(tmp_path / "a.png"), (5, 7)).collect()
    assert len(rows) == 35
    assert all((r["r"], r["g"], r["b"]) == tuple(pixels[6 - r["y"], r["x"]]) for r in rows)
    with pytest.raises(Exception, match="not 6 x 7"):
        png.read_png(spark, str(tmp_path / "a.png"), (6, 7)).collect()


def test_png_filters():
    first, line = [10, 10, 10], [1, 2, 3]  # as filtered: the first line is 10, 20, 30
    for kind, want in enumerate([[1, 2, 3], [1, 3, 6], [11, 22, 33], [6, 15, 25], [11, 22, 33]]):
        lines = np.array([first, line], np.uint8)[:, :, None]
        assert png._unfiltered(np.array([1, kind]), lines).ravel().tolist() == [10, 20, 30, *want]
    with pytest.raises(ValueError, match="unknown PNG filter 5"):
        png._unfiltered(np.array([5]), np.zeros((1, 1, 1), np.uint8))


def test_png_filters_equal_a_loop():
    rng = np.random.default_rng(2)
    lines, kinds = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8), rng.integers(0, 5, 9)
    want = np.zeros((10, 12, 3), int)
    for y in range(9):
        for x in range(11):
            for c in range(3):
                left, up, corner = want[y + 1, x, c], want[y, x + 1, c], want[y, x, c]
                p = left + up - corner
                nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                want[y + 1, x + 1, c] = (int(lines[y, x, c]) + [0, left, up, (left + up) // 2, nearest][kinds[y]]) % 256
    assert np.array_equal(png._unfiltered(kinds, lines), want[1:, 1:])


def test_svg_segments(spark, tmp_path):
    text = '<svg xmlns="http://www.w3.org/2000/svg"><g><path id="p" d="M0,0 L9,0 l0,9 z"/><path id="q" d="m1 1 c1 0 2 1 2 2 s1 2 2 2"/></g></svg>'
    (tmp_path / "a.svg").write_text(text)
    rows = svg.read_svg(spark, str(tmp_path / "a.svg")).orderBy("path", "seg").collect()
    assert [(r["name"], r["closed"], r["seg"]) for r in rows] == [("p", True, 0), ("p", True, 1), ("p", True, 2), ("q", False, 0), ("q", False, 1)]
    assert (rows[2]["x3"], rows[2]["y3"]) == (0.0, 0.0) and (rows[4]["x1"], rows[4]["y1"]) == (3.0, 4.0)
    with pytest.raises(ValueError, match="arcs"):
        list(svg.segments("M0 0 A1 1 0 0 1 2 2"))


def test_mesh_cells(spark):
    faces = spark.createDataFrame([(1, [1, 2], 1, 0), (2, [2, 3], 1, 2), (3, [3, 1], 1, 0), (4, [3, 4], 2, 0), (5, [4, 2], 2, 9)], "face_id int, nodes array<int>, c0 int, c1 int")
    cells = spark.createDataFrame([(1, 5, 1), (2, 5, 1), (9, 5, 1)], "cell_id int, zone int, type int")
    parents = spark.createDataFrame([(9,)], "cell_id int")
    got = mesh.require_complete(mesh.cells_from_faces(faces, cells, parents))
    assert {r["cell_id"]: r["nodes"] for r in got.collect()} == {1: [1, 2, 3], 2: [3, 2, 4]}
    with pytest.raises(Exception, match="wrong nodes in cell 9"):
        mesh.require_complete(mesh.cells_from_faces(faces, cells)).collect()
    values = spark.createDataFrame([(1, 10.0), (2, 20.0)], "cell_id int, u double")
    mean = {r["node_id"]: r["u"] for r in fields.cell_to_point(got, values, ["u"]).collect()}
    assert mean == {1: 10.0, 2: 15.0, 3: 15.0, 4: 20.0}
    assert mesh.field_names("SV_U;SV_V;") == ["SV_U", "SV_V"] and mesh.phase_name(2, "SV_U") == "phase_1-SV_U"
    whole = mesh.join_sections([values.where("cell_id = 1"), values.where("cell_id = 2")], ["u"])
    assert whole.count() == 2
    assert fields.require_nonzero(values, "u").first()[0] == 2
    with pytest.raises(Exception, match="zero everywhere"):
        fields.require_nonzero(values.withColumn("u", F.lit(0.0)), "u").collect()


class Node(dict):
    """An HDF5 group or dataset in memory."""

    def __init__(self, value=None, attrs=None, **members):
        super().__init__(members)
        self.value, self.attrs = value, attrs or {}

    def __getitem__(self, path):
        at = self
        for name in str(path).split("/"):
            at = dict.__getitem__(at, name)
        return at

    def __contains__(self, path):
        try:
            self[path]
        except KeyError:
            return False
        return True

    def __array__(self, dtype=None, copy=None):
        return np.asarray(self.value, dtype)


def span(low, high, value=None, **members):
    return Node(value, {"minId": [low], "maxId": [high]}, **members)


def sections(*parts):
    return Node(attrs={"nSections": [len(parts)]}, **{str(k + 1): p for k, p in enumerate(parts)})


def test_case_and_data_files(spark):
    """Two quadrilaterals beside each other, and a third that was refined away."""
    places = [[0, 0], [2, 0], [2, 2], [0, 2], [4, 0], [4, 2]]
    faces = [[1, 2], [2, 3], [3, 4], [4, 1], [2, 5], [5, 6], [6, 3]]
    mesh_ = Node(
        attrs={"faceCount": [7]},
        nodes=Node(zoneTopology=Node(id=Node([1])), coords=Node(**{"1": span(1, 6, places)})),
        faces=Node(
            nodes=sections(span(1, 4, nnodes=Node([2] * 4), nodes=Node(sum(faces[:4], []))), span(5, 7, nnodes=Node([2] * 3), nodes=Node(sum(faces[4:], [])))),
            c0=sections(span(1, 7, [1, 1, 1, 1, 2, 2, 2])),
            c1=sections(span(2, 2, [2])),
            tree=Node(**{"1": span(1, 1, nkids=Node([0]), kids=Node([]))}),
        ),
        cells=Node(
            zoneTopology=Node(id=Node([7, 8]), minId=Node([1, 3]), maxId=Node([2, 3]), cellType=Node([0, 3])),
            ctype=sections(span(1, 2, **{"cell-types": Node([3, 3])})),
            tree=Node(**{"1": span(3, 3, nkids=Node([4]), kids=Node([1, 2]))}),
        ),
    )
    found = case.read_case(spark, Node(meshes=Node(**{"1": mesh_})))
    cells = mesh.cells_from_faces(found.faces, found.cells, found.parents, found.child_faces)
    rings = {r["cell_id"]: (r["zone"], r["type"], r["nodes"]) for r in mesh.require_complete(cells).collect()}
    assert rings == {1: (7, 3, [1, 2, 3, 4]), 2: (7, 3, [3, 2, 5, 6])}
    data = Node(results=Node(**{"1": Node(**{
        "phase-1": Node(cells=Node(fields=Node(["SV_U;SV_V;"]), SV_U=sections(span(1, 2, [1.0, 3.0])), SV_V=sections(span(1, 2, [[0.0, 1.0], [2.0, 3.0]])))),
        "phase-2": Node(cells=Node(fields=Node([b"SV_U;"]), SV_U=sections(span(1, 1, [5.0]), span(2, 2, [6.0])))),
    })}))
    values = case.read_fields(spark, data)
    assert set(values) == {"SV_U", "SV_V", "phase_1-SV_U"} and values["SV_V"].columns == ["cell_id", "value_0", "value_1"]
    assert sorted(map(tuple, values["phase_1-SV_U"].collect())) == [(1, 5.0), (2, 6.0)]
    at_nodes = fields.cell_to_point(cells, values["SV_U"], ["value"]).join(found.nodes, "node_id")
    pixels = fields.probe(mesh.triangles(cells, at_nodes, ["value"]), 5, 3, ["value"]).collect()
    got = {(r["x"], r["y"]): round(r["value"], 6) for r in pixels}
    assert len(got) == 15 and got[0, 1] == 1.0 and got[2, 1] == 2.0 and got[3, 1] == 2.5 and got[4, 2] == 3.0


def test_hdf5_is_optional(spark):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            hdf5.read_flow(spark, "none.h5")
    whole = np.arange(12).reshape(4, 3)
    table = hdf5.raster_table(spark, (4, 3), lambda low, high: {"v": whole[low:high]}, "x long, y long, v long")
    assert {(r["x"], r["y"], r["v"]) for r in table.collect()} == {(x, y, 3 * y + x) for x in range(3) for y in range(4)}


def test_stored_maps_flows_and_colours(spark, tmp_path):
    pixels = spark.createDataFrame([(0, 0, 1000, 2, 0.9), (1, 0, -1, 0, 0.0)], "x int, y int, path_index int, ice_status int, ice_thickness double")
    frames.write_map(pixels, str(tmp_path / "map"))
    assert {r["nx"] for r in frames.read_map(spark, str(tmp_path / "map")).collect()} == {0.0}
    frames.write_flow(spark.createDataFrame([(0, 0, 3.0, 4.0)], "x int, y int, vx double, vy double"), str(tmp_path / "flow"))
    assert frames.read_flow(spark, str(tmp_path / "flow")).first()["norm"] == 5.0
    frames.write_point_colours(spark.createDataFrame([(5, 255, 2, 3)], "pid long, r int, g int, b int"), str(tmp_path / "colours"))
    points = spark.createDataFrame([(5, 0), (6, 0)], "pid long, r int")
    out = frames.with_point_colours(points, spark.read.parquet(str(tmp_path / "colours"))).orderBy("pid").collect()
    assert [(r["r"], r["g"], r["b"]) for r in out] == [(255, 2, 3), (0, 0, 0)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", (F.col("user_id") % 3).cast("int").alias("region"), "value")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    q = frame_sums(stream).writeStream.format("memory").queryName("frames").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["frame_start"], r["region"]): round(r["fx"], 6) for r in spark.table("frames").collect()}
    want = {(r["d"], r["region"]): round(r["fx"], 6) for r in events.groupBy(F.date_trunc("day", "ts").alias("d"), "region").agg(F.sum("value").alias("fx")).collect()}
    assert got == want
    forces = stream.select("region", F.col("value").alias("fx"), F.col("value").alias("fy"))
    store_forces(forces, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where("frame = 0").count() == 3
