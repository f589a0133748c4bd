"""Unstructured meshes: cells from faces, and fields from sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Cell types and their numbers of nodes; 7 is a polyhedron of any number.
CELL_NODES = {1: 3, 2: 4, 3: 4, 4: 8, 5: 5, 6: 6}


def cells_from_faces(faces: DataFrame, cells: DataFrame, parents: DataFrame | None = None, children: DataFrame | None = None) -> DataFrame:
    """cells(cell_id, zone, type) with their nodes in order, from faces(face_id, nodes, c0, c1).

    A face belongs to the cells on its two sides (0: none) and runs forward as
    seen from c0. The nodes of a flat cell, whose faces are edges, are the ring
    that begins with its first face; those of a solid are as ``solid_nodes`` says.
    Cells that were refined into others, parents(cell_id), and faces that are
    parts of others, children(face_id), are dropped.
    """
    whole = faces if children is None else faces.join(children.select("face_id"), "face_id", "left_anti")
    forward, back = F.struct(F.col("c0").alias("cell_id"), F.col("nodes").alias("run")), F.struct("c1", F.reverse("nodes"))
    sides = whole.select("face_id", "nodes", F.inline(F.array(forward, back.cast("struct<cell_id:bigint,run:array<bigint>>")))).where("cell_id <> 0")
    runs = sides.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("face_id", "run", "nodes"))).alias("faces"))
    runs = runs.select("cell_id", F.transform("faces", lambda r: r["run"]).alias("runs"), F.transform("faces", lambda r: r["nodes"]).alias("given"))
    live = cells if parents is None else cells.join(parents.select("cell_id"), "cell_id", "left_anti")
    found = live.join(runs, "cell_id")
    flat = F.forall("runs", lambda r: F.size(r) == 2)
    nodes = F.when(flat, _ring(F.col("runs"))).otherwise(solid_nodes(F.col("type"), F.col("runs"), F.col("given")))
    return found.withColumn("nodes", nodes).drop("runs", "given")


def _has(run: Column, *nodes: Column) -> Column:
    found = F.lit(True)
    for n in nodes:
        found = found & F.array_contains(run, n)
    return found


def _turned(run: Column, first: Column) -> Column:
    """A run that begins with one of its nodes, or as it is without that."""
    at = F.array_position(run, first).cast("int")
    return F.when(at > 1, F.concat(F.slice(run, at, F.size(run)), F.slice(run, F.lit(1), F.greatest(at - 1, F.lit(0))))).otherwise(run)


def _prism(base: Column, top: Column, sides: Column) -> Column:
    """The nodes of a base, then those of the face opposite to it, each above its own.

    The node above the first one is that which the two sides at the first one
    share; sides meet the base in its first and last edges.
    """
    first = F.element_at(base, 1)
    one = F.element_at(F.filter(sides, lambda r: _has(r, first, F.element_at(base, 2))), -1)
    other = F.element_at(F.filter(sides, lambda r: _has(r, first, F.element_at(base, -1))), -1)
    above = F.try_element_at(F.filter(one, lambda n: (n != first) & F.array_contains(other, n)), F.lit(-1))
    return F.concat(base, _turned(F.reverse(top), above))


def solid_nodes(kind: Column, runs: Column, given: Column) -> Column:
    """Nodes of a solid cell in the order of its type, from its faces' runs as seen from the cell, in the order of faces.

    Tetrahedron (2): the first face, then the apex. Hexahedron (4): the first
    face, then the one that shares no node with it, each node above its own.
    Pyramid (5): the face of four nodes, then the apex. Wedge (6): the first
    triangle, then the other as in a hexahedron. Polyhedron (7): the number of
    faces, then of each its number of nodes and these as ``given``; faces
    without nodes don't count. Cells that lack a face of their type have null.
    """
    threes, fours = F.filter(runs, lambda r: F.size(r) == 3), F.filter(runs, lambda r: F.size(r) == 4)
    first = F.try_element_at(runs, F.lit(1))

    def apex(base: Column) -> Column:
        return F.concat(base, F.slice(F.array_except(F.array_distinct(F.flatten(runs)), base), 1, 1))

    far = F.try_element_at(F.filter(runs, lambda r: ~F.arrays_overlap(r, first)), F.lit(-1))
    beside = F.slice(runs, F.lit(2), F.greatest(F.size(runs) - 1, F.lit(0)))
    low, high = F.try_element_at(threes, F.lit(1)), F.try_element_at(threes, F.lit(2))
    full = F.filter(given, lambda g: F.size(g) > 0)
    stream = F.flatten(F.transform(full, lambda g: F.concat(F.array(F.size(g).cast("long")), g)))
    return (
        F.when(kind == 2, apex(first))
        .when((kind == 4) & far.isNotNull(), _prism(first, far, beside))
        .when(kind == 5, apex(F.try_element_at(fours, F.lit(-1))))
        .when((kind == 6) & high.isNotNull(), _prism(low, high, fours))
        .when(kind == 7, F.concat(F.array(F.size(full).cast("long")), stream))
    )


def tree_closure(tree: DataFrame, most: int = 64) -> DataFrame:
    """(cell_id, root, depth, leaf) of every cell of a forest tree(parent, child), however deep.

    Each round every parent takes its ancestor's ancestor for its own, so there
    are as many rounds as the depth has bits. One that has found its root is set
    aside: else all would meet in the root's task at last. Leaves, which are
    nobody's ancestors, then ask their parents. A cell with two parents or a
    circle raises an error.
    """
    known = tree.where("parent IS NOT NULL AND child IS NOT NULL").groupBy("child").agg(F.min("parent").alias("low"), F.max("parent").alias("high"))
    one = F.when(F.col("low") != F.col("high"), F.raise_error(F.concat(F.lit("two parents of cell "), F.col("child").cast("string")))).otherwise(F.col("low"))
    edges = cut(known.select(F.col("child").alias("cell_id"), one.alias("up")))
    inner = edges.select(F.col("up").alias("_inner")).distinct()
    marked = cut(inner.join(edges, F.col("_inner") == F.col("cell_id"), "left").select(F.col("_inner").alias("cell_id"), "up"))
    done = marked.where("up IS NULL").select("cell_id", F.col("cell_id").alias("root"), F.lit(0).cast("long").alias("depth"))
    open_ = marked.where("up IS NOT NULL").select("cell_id", "up", F.lit(1).cast("long").alias("depth"))
    for _ in range(most):
        if open_.isEmpty():
            break
        # Roots are told by a null ancestor. A cell is an ancestor of many only if it has as many descendants at one distance.
        above = done.select(F.col("cell_id").alias("_cell"), F.lit(None).cast(open_.schema["up"].dataType).alias("_up"), F.col("root"), F.col("depth").alias("_depth"))
        above = above.unionByName(open_.select(F.col("cell_id").alias("_cell"), F.col("up").alias("_up"), F.lit(None).cast(open_.schema["up"].dataType).alias("root"), F.col("depth").alias("_depth")))
        now = cut(open_.join(above, F.col("up") == F.col("_cell")).select("cell_id", F.col("_up").alias("up"), "root", (F.col("depth") + F.col("_depth")).alias("depth")))
        done = done.unionByName(now.where("up IS NULL").select("cell_id", "root", "depth"))
        open_ = now.where("up IS NOT NULL").select("cell_id", "up", "depth")
    else:
        if not open_.isEmpty():
            raise ValueError("cells are their own ancestors")
    leaves = edges.join(marked.select("cell_id"), "cell_id", "left_anti")
    ends = done.select(F.col("cell_id").alias("up"), "root", "depth")
    of_leaves = leaves.join(ends, "up").select("cell_id", "root", (F.col("depth") + 1).alias("depth"), F.lit(True).alias("leaf"))
    return done.select("cell_id", "root", "depth", F.lit(False).alias("leaf")).unionByName(of_leaves)


def parent_values(tree: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """values(cell_id, names…) of the leaves, and of each parent the mean over its children that are leaves, 0 if it has none."""
    edges = tree.select("parent", "child").distinct()
    inner = edges.select(F.col("parent").alias("cell_id")).distinct()
    leaves = values.join(inner, "cell_id", "left_anti")
    held = edges.join(leaves, F.col("child") == F.col("cell_id"), "left").groupBy("parent")
    means = held.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names]).withColumnRenamed("parent", "cell_id")
    return leaves.select("cell_id", *names).unionByName(means)


def _ring(edges: Column) -> Column:
    """Nodes of edges in the order in which they join, from the first edge on."""

    def grow(ring: Column, _: Column) -> Column:
        last = F.element_at(ring, -1)
        ends = F.transform(
            edges, lambda e: F.when(e[0] == last, e[1]).when(e[1] == last, e[0])
        )
        fresh = F.filter(ends, lambda n: n.isNotNull() & ~F.array_contains(ring, n))
        return F.when(F.size(fresh) > 0, F.concat(ring, F.slice(fresh, 1, 1))).otherwise(ring)

    return F.aggregate(F.slice(edges, 3, F.greatest(F.size(edges) - 2, F.lit(0))), edges[0], grow)


def triangles(cells: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """Flat cells(cell_id, nodes) as the triangles of ``fields.probe``: a fan from each cell's first node.

    nodes(node_id, x, y, names…).
    """
    fan = cells.select("cell_id", F.explode(F.sequence(F.lit(2), F.size("nodes") - 1)).alias("k"), "nodes")
    corners = fan.select("cell_id", "k", *[F.element_at("nodes", F.lit(1) if c == "a" else F.col("k") + at).alias(f"{c}_id") for c, at in (("a", 0), ("b", 0), ("c", 1))])
    for c in "abc":
        place = nodes.select(
            F.col("node_id").alias(f"{c}_id"), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), *[F.col(n).alias(f"{c}_{n}") for n in names]
        )
        corners = corners.join(place, f"{c}_id")
    return corners.drop("k", "a_id", "b_id", "c_id")


def require_complete(cells: DataFrame) -> DataFrame:
    """Raise where a cell has no nodes, or another number of them than its type says."""
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for kv in CELL_NODES.items() for x in kv]), F.col("type"))
    wrong = wanted.isNotNull() & ~F.coalesce(F.size("nodes") == wanted, F.lit(False))
    return cells.withColumn("nodes", F.when(wrong, F.raise_error(F.concat(F.lit("wrong nodes in cell "), F.col("cell_id").cast("string")))).otherwise(F.col("nodes")))


def field_names(header: str) -> list[str]:
    """Names in a semicolon-separated field list."""
    return [name for name in header.split(";") if name]


def phase_name(phase: int, name: str) -> str:
    """Fields of the first phase keep their names; those of the second are named after phase 1, and so on."""
    return name if phase == 1 else f"phase_{phase - 1}-{name}"


def join_sections(sections: list[DataFrame], wanted: list[str] | None = None) -> DataFrame:
    """One field table from its sections, with only the wanted fields beside cell_id."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)
    return whole if wanted is None else whole.select("cell_id", *wanted)


def with_zones(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Cells with the name of their zone: zones(zone, name)."""
    return cells.join(zones, "zone", "left")
