"""Registered queries over points, curves and cells that meet by place."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames, layout, nearest, thinning, tiles, walk
from ..sources import mesh, strips
from ..streaming import forces
from . import adapters as a
from .adapters import CELLS, MAP_WIDTH, ORDER_MAP, PARTICLES, STENCIL, sql6
from .particle_queries import _FRAME, _MASKED, _masked, rounded

QUERIES = {}
ORACLES = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each row of lineitem."""
    l = a.table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("okey"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / 1000).alias("x"), (F.col("l_quantity") * 0.73).alias("y"))


_POINTS = "pts AS (SELECT l_orderkey AS okey, l_linenumber AS line, l_extendedprice / 1000 AS x, l_quantity * 0.73 AS y FROM lineitem)"

#: Curves of 25 parts each; that of the first parts spans the grid.
_NODES = """nodes AS (
  SELECT p_partkey // 25 AS curve, p_partkey AS seq,
         CASE WHEN p_partkey < 25 THEN 2.2e0 * p_size ELSE (p_partkey // 25 * 13) % 100 + p_size * 0.11e0 END AS x,
         CASE WHEN p_partkey < 25 THEN 0.36e0 * (p_retailprice - 900) ELSE (p_partkey // 25 * 7) % 36 + (p_retailprice - 900) * 0.03e0 END AS y
  FROM part
), seg AS (
  SELECT *, sum(len) OVER (PARTITION BY curve) AS total, coalesce(sum(len) OVER (PARTITION BY curve ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS len FROM (
    SELECT curve, seq AS seg, x AS ax, y AS ay, lead(x) OVER o AS bx, lead(y) OVER o AS by_ FROM nodes WINDOW o AS (PARTITION BY curve ORDER BY seq)) WHERE bx IS NOT NULL)
)"""


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice") - 900
    curve = F.floor(k / 25)
    nodes = a.table(spark, sf_dir, "part").select(
        curve.alias("curve"),
        k.alias("seq"),
        F.when(k < 25, size * 2.2).otherwise(curve * 13 % 100 + size * 0.11).alias("x"),
        F.when(k < 25, price * 0.36).otherwise(curve * 7 % 36 + price * 0.03).alias("y"),
    )
    return nearest.polyline_segments(nodes, ["x", "y"])


@query(
    f"""WITH {_POINTS}, {_NODES}, places AS (SELECT DISTINCT x, y FROM pts), m AS (
  SELECT p.x, p.y, curve, seg, done, len, total, ax, ay, bx, by_,
         coalesce(least(greatest(((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / nullif((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay), 0), 0), 1), 0) AS t FROM places p, seg
), d AS (
  SELECT x, y, curve, seg, done, len, total, t, sqrt((x - (ax + (bx - ax) * t)) * (x - (ax + (bx - ax) * t)) + (y - (ay + (by_ - ay) * t)) * (y - (ay + (by_ - ay) * t))) AS distance FROM m
), n AS (SELECT x, y, min((distance, curve, seg, t, done, len, total)) AS b FROM d GROUP BY x, y)
SELECT okey, line, {sql6('x')} AS x, y, b[2] AS curve, b[3] AS seg, {sql6('b[1]')} AS distance, {sql6('coalesce((b[5] + b[4] * b[6]) / nullif(b[7], 0), 0)')} AS position
FROM pts JOIN n USING (x, y)"""
)
def nearest_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest curve of each point and how far along it the nearest place lies, 0 to 1."""
    segments = _curves(spark, sf_dir)
    found = nearest.nearest_segment(_points(spark, sf_dir), segments, ["x", "y"], ["curve", "seg", "done", "length", "total"])
    near = F.col("nearest")
    along = F.try_divide(near["name"]["done"] + near["t"] * near["name"]["length"], near["name"]["total"])
    out = found.select(
        "okey", "line", "x", "y", near["name"]["curve"].alias("curve"), near["name"]["seg"].alias("seg"),
        near["distance"].alias("distance"), F.coalesce(along, F.lit(0.0)).alias("position"),
    )
    return rounded(out, "x", "distance", "position")


#: Triangles of customers: most are small, one in 500 is a hundred times as large, and that of the first holds the grid.
_TRIANGLES = """tri AS (
  SELECT c_custkey AS cell_id, size, x AS ax, y AS ay, x + size AS bx, y + size * 0.2e0 AS by_, x + size * 0.3e0 AS cx, y + size * 0.9e0 AS cy, s FROM (
    SELECT c_custkey, c_acctbal AS s, CASE WHEN c_custkey = 1 THEN 400e0 WHEN c_custkey % 500 = 2 THEN 60e0 ELSE 0.3e0 + (c_custkey % 17) * 0.05e0 END AS size,
           CASE WHEN c_custkey = 1 THEN -100e0 ELSE (c_custkey * 7919) % 10007 / 100e0 END AS x,
           CASE WHEN c_custkey = 1 THEN -50e0 ELSE (c_custkey * 104729) % 3511 / 100e0 END AS y FROM customer)
)"""


@query(
    f"""WITH {_POINTS}, {_TRIANGLES}, places AS (SELECT DISTINCT x, y FROM pts), b AS (
  SELECT p.x, p.y, cell_id, s, ((by_ - cy) * (p.x - cx) + (cx - bx) * (p.y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS u,
         ((cy - ay) * (p.x - cx) + (ax - cx) * (p.y - cy)) / ((by_ - cy) * (ax - cx) + (cx - bx) * (ay - cy)) AS v FROM places p, tri
), f AS (SELECT x, y, min((cell_id, u * s + v * (s * 2) + (1 - u - v) * (s + 100))) AS b FROM b WHERE u >= 0 AND v >= 0 AND 1 - u - v >= 0 GROUP BY x, y)
SELECT okey, line, {sql6('x')} AS x, y, b[1] AS cell_id, {sql6('b[2]', 4)} AS s FROM pts LEFT JOIN f USING (x, y)"""
)
def probe_any_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangle that each point lies in, and its value there."""
    k, s = F.col("c_custkey"), F.col("c_acctbal")
    sized = a.table(spark, sf_dir, "customer").select(
        k.alias("cell_id"),
        s.alias("s"),
        F.when(k == 1, 400.0).when(k % 500 == 2, 60.0).otherwise(0.3 + (k % 17) * 0.05).alias("size"),
        F.when(k == 1, -100.0).otherwise((k * 7919) % 10007 / 100.0).alias("x"),
        F.when(k == 1, -50.0).otherwise((k * 104729) % 3511 / 100.0).alias("y"),
    )
    x, y, size = F.col("x"), F.col("y"), F.col("size")
    t = sized.select(
        "cell_id", x.alias("ax"), y.alias("ay"), (x + size).alias("bx"), (y + size * 0.2).alias("by"), (x + size * 0.3).alias("cx"), (y + size * 0.9).alias("cy"),
        F.col("s").alias("a_s"), (F.col("s") * 2).alias("b_s"), (F.col("s") + 100).alias("c_s"),
    )
    return rounded(rounded(tiles.probe_points(_points(spark, sf_dir), t, ["s"]), "s", digits=4), "x")


#: Points of parts and the distance below which they are too near.
_APART = 1.5
_PARTS = "pts AS (SELECT p_partkey, (p_partkey * 7919) % 10007 / 100e0 AS x, p_size * 0.7e0 + (p_retailprice - 900) * 0.01e0 AS y, (p_partkey * 2654435761) % 4294967296 AS priority FROM part)"


@query(
    f"""WITH {_PARTS}, f AS (
  SELECT list_reduce(list([{{'k': p_partkey, 'x': x, 'y': y}}] ORDER BY priority, x, y), lambda kept, p:
           CASE WHEN len(list_filter(kept, lambda q: (q.x - p[1].x) * (q.x - p[1].x) + (q.y - p[1].y) * (q.y - p[1].y) < {_APART * _APART})) > 0 THEN kept ELSE list_concat(kept, p) END) AS kept
  FROM pts
) SELECT q.k AS p_partkey, {sql6('q.x')} AS x, {sql6('q.y')} AS y FROM (SELECT unnest(kept) AS q FROM f)"""
)
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of parts, no two too near: as if taken one by one in the order of a hash."""
    k = F.col("p_partkey")
    points = a.table(spark, sf_dir, "part").select(
        "p_partkey", ((k * 7919) % 10007 / 100.0).alias("x"), (F.col("p_size") * 0.7 + (F.col("p_retailprice") - 900) * 0.01).alias("y"), (k * 2654435761 % 4294967296).alias("priority")
    )
    return rounded(thinning.thin(points, _APART, [F.col("priority")]).select("p_partkey", "x", "y"), "x", "y")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named and everything runs in one process, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="gridmill-shared-")
    return named.rstrip("/")


#: Boxes of cells that are looked up: a single cell, a narrow strip, a square.
_BOXES = ((40, 40, 12, 12), (3, 5, 0, 40), (60, 70, 20, 30))


@query(
    "WITH c AS (SELECT l_orderkey AS okey, l_linenumber AS line, CAST(floor(l_extendedprice / 1000 + 0.5) AS INTEGER) AS ci, CAST(floor(l_quantity * 0.73 + 0.5) AS INTEGER) AS cj FROM lineitem)"
    + " UNION ALL ".join(f" SELECT {n} AS box, okey, line, ci, cj FROM c WHERE ci BETWEEN {i0} AND {i1} AND cj BETWEEN {j0} AND {j1}" for n, (i0, i1, j0, j1) in enumerate(_BOXES))
)
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points stored along a curve, and those of three boxes read back."""
    points = _points(spark, sf_dir).select("okey", "line", F.floor(F.col("x") + 0.5).cast("int").alias("ci"), F.floor(F.col("y") + 0.5).cast("int").alias("cj"))
    path = f"{shared_folder(spark)}/points-{uuid.uuid4().hex}"
    layout.store(points, path, zones=32)
    found = [layout.lookup(spark, path, *box).select(F.lit(n).alias("box"), "okey", "line", "ci", "cj") for n, box in enumerate(_BOXES)]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: Segments of curves: eight parts each, every one beginning where the one before ends.
_WALKED = """raw AS (
  SELECT p_partkey // 8 AS path, p_partkey AS seg, p_size * 1e0 AS x0, p_size + 2.5e0 AS x1, p_retailprice / 10 AS x2, p_size * 2e0 AS x3, p_retailprice / 20 AS y0, p_size * 1.5e0 AS y1, p_size + 7e0 AS y2, 40e0 - p_size AS y3 FROM part
), seg AS (SELECT path, seg, coalesce(lag(x3) OVER o, x0) AS x0, x1, x2, x3, coalesce(lag(y3) OVER o, y0) AS y0, y1, y2, y3 FROM raw WINDOW o AS (PARTITION BY path ORDER BY seg))"""
_AT_T = " ".join(f"CAST(trunc((1 - t) * (1 - t) * (1 - t) * {c}0 + 3 * ((1 - t) * (1 - t)) * t * {c}1 + 3 * (1 - t) * (t * t) * {c}2 + t * t * t * {c}3) AS BIGINT) AS n{c}," for c in "xy")


@query(
    f"""WITH RECURSIVE {_WALKED}, w AS (
  SELECT path, seg, 0e0 AS t, 1e0 / {max(a.GX, a.GY)} AS step, CAST(trunc(x0) AS BIGINT) AS px, CAST(trunc(y0) AS BIGINT) AS py, 0 AS k, TRUE AS fresh, x0, x1, x2, x3, y0, y1, y2, y3 FROM seg
  UNION ALL
  SELECT path, seg, CASE WHEN far THEN was ELSE t END, CASE WHEN far THEN step / 2 ELSE step END, CASE WHEN far THEN px ELSE nx END, CASE WHEN far THEN py ELSE ny END,
         CASE WHEN NOT far AND (nx <> px OR ny <> py) THEN k + 1 ELSE k END, NOT far AND (nx <> px OR ny <> py), x0, x1, x2, x3, y0, y1, y2, y3
  FROM (SELECT *, abs(nx - px) > 1 OR abs(ny - py) > 1 AS far FROM (SELECT {_AT_T} * FROM (SELECT * EXCLUDE (t), t AS was, least(t + step, 1e0) AS t FROM w WHERE t < 1)))
) SELECT path, CAST(seg AS INTEGER) AS seg, k, px AS x, py AS y FROM w WHERE fresh"""
)
def curve_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the parts' curves, in order."""
    k, s, r = F.col("p_partkey"), F.col("p_size").cast("double"), F.col("p_retailprice")
    raw = a.table(spark, sf_dir, "part").select(
        F.floor(k / 8).alias("path"), k.cast("int").alias("seg"), s.alias("x0"), (s + 2.5).alias("x1"), (r / 10).alias("x2"), (s * 2).alias("x3"),
        (r / 20).alias("y0"), (s * 1.5).alias("y1"), (s + 7).alias("y2"), (40 - s).alias("y3"),
    )
    before = Window.partitionBy("path").orderBy("seg")
    joined = raw.withColumns({f"{c}0": F.coalesce(F.lag(f"{c}3").over(before), F.col(f"{c}0")) for c in "xy"})
    return walk.walk(joined, a.GX, a.GY).drop("t")


_ORIGIN = 19723 * 86_400


@query(
    f"""WITH e AS (SELECT CAST(floor((epoch(ts) - {_ORIGIN}) / 43200) AS INTEGER) AS frame, CAST(user_id % 7 AS INTEGER) AS region, event_id, value FROM events),
f AS (SELECT frame, region, arg_max(value, event_id) AS fx FROM e GROUP BY frame, region),
g AS (SELECT region, CAST(unnest(range(0, last + 1)) AS INTEGER) AS frame FROM (SELECT region, max(frame) AS last FROM f GROUP BY region))
SELECT region, frame, {sql6('coalesce(fx, 0)', 4)} AS fx, {sql6('coalesce(-fx / 2, 0)', 4)} AS fy FROM g LEFT JOIN f USING (region, frame)"""
)
def force_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each region and frame, streamed from shuffled files with a restart in between; gaps are 0."""
    rows = a.table(spark, sf_dir, "events").select(
        F.timestamp_seconds(F.unix_timestamp("ts")).alias("ts"), (F.col("user_id") % 7).cast("int").alias("region"), F.col("event_id").alias("seq"),
        F.col("value").alias("fx"), (-F.col("value") / 2).alias("fy"),
    )
    found = forces.replay(spark, rows, shared_folder(spark), _ORIGIN, "60 days", files=8, starts=2)
    return rounded(found, "fx", "fy", digits=4)


@query(f"WITH {ORDER_MAP} SELECT x, y, r, b FROM omap WHERE y BETWEEN 5 AND 40 AND x >= 20")
def image_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's picture written as a PNG, and a window of it read back with two of its channels."""
    uri = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}.png"
    strips.write_png(a.order_map(spark, sf_dir), uri, MAP_WIDTH, a.map_height(spark, sf_dir), lines=16)
    pixels = strips.read_strips(spark, uri, "x int, y int, r short, b short", x=(20, MAP_WIDTH), y=(5, 40))
    last = a.table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    known = pixels.where(F.col("y") * MAP_WIDTH + F.col("x") <= F.lit(last))  # the end of the last line has no orders
    return known.select("x", "y", *[F.col(c).cast("int").alias(c) for c in "rb"])


#: Faces of solids, outward, by the numbers of their nodes.
_FACES = {
    2: [[0, 2, 1], [0, 1, 3], [1, 2, 3], [2, 0, 3]],
    4: [[0, 3, 2, 1], [4, 5, 6, 7], [0, 1, 5, 4], [1, 2, 6, 5], [2, 3, 7, 6], [3, 0, 4, 7]],
    5: [[0, 3, 2, 1], [0, 1, 4], [1, 2, 4], [2, 3, 4], [3, 0, 4]],
    6: [[0, 2, 1], [3, 4, 5], [0, 1, 4, 3], [1, 2, 5, 4], [2, 0, 3, 5]],
}
_KINDS = [2, 4, 5, 6]


@query(
    f"""WITH c AS (SELECT c_custkey + 1 AS k, CAST([2, 4, 5, 6][c_custkey % 4 + 1] AS INTEGER) AS type FROM customer),
f0 AS (SELECT k, type, unnest(CASE type {' '.join(f'WHEN {t} THEN {f}' for t, f in _FACES.items())} END) AS run, generate_subscripts(CASE type {' '.join(f'WHEN {t} THEN {f}' for t, f in _FACES.items())} END, 1) - 1 AS f FROM c),
f1 AS (SELECT k, type, f, k * 8 + (f + k) % CASE type WHEN 2 THEN 4 WHEN 4 THEN 6 ELSE 5 END AS face_id, list_transform(run, lambda n: k * 8 + n) AS run, (k + f) % len(run) AS turn FROM f0),
faces AS (SELECT k, type, face_id, list_concat(list_slice(run, turn + 1, len(run)), list_slice(run, 1, turn)) AS run FROM f1),
seen AS (SELECT k, type, face_id, run FROM faces),
base AS (SELECT k, type, run AS base FROM seen WHERE type IN (2, 4) OR (type = 5 AND len(run) = 4) OR (type = 6 AND len(run) = 3) QUALIFY row_number() OVER (PARTITION BY k ORDER BY face_id) = 1),
edges AS (SELECT k, run[i] AS a, run[i % len(run) + 1] AS b FROM (SELECT k, run, unnest(range(1, len(run) + 1)) AS i FROM seen)),
above AS (SELECT DISTINCT e.k, a, b FROM (SELECT k, a, b FROM edges UNION ALL SELECT k, b, a FROM edges) e JOIN base USING (k) WHERE list_contains(base, a) AND NOT list_contains(base, b)),
tops AS (SELECT b.k, list(above.b ORDER BY list_position(base, a)) AS top FROM base b JOIN above USING (k) GROUP BY b.k)
SELECT base.k AS cell_id, type, array_to_string(CASE WHEN type IN (2, 5) THEN list_concat(base, top[1:1]) ELSE list_concat(base, top) END, ' ') AS nodes FROM base JOIN tops USING (k)"""
)
def solid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solid for each customer, from faces in mixed order, turned, and seen from either side."""
    k = F.col("k")
    kinds = F.array(*[F.lit(t) for t in _KINDS])
    c = a.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("k"), F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("type"))

    def of_kind(t: int):
        return F.array(*[F.array(*[F.lit(n).cast("long") for n in run]) for run in _FACES[t]])

    runs = F.when(F.col("type") == 2, of_kind(2)).when(F.col("type") == 4, of_kind(4)).when(F.col("type") == 5, of_kind(5)).otherwise(of_kind(6))
    listed = c.select("k", "type", F.size(runs).alias("n"), F.posexplode(runs).alias("f", "run"))
    turn = ((k + F.col("f")) % F.size("run")).cast("int")
    run = F.transform("run", lambda n: k * 8 + n)
    turned = listed.select("k", "n", "f", F.concat(F.slice(run, turn + 1, F.size("run")), F.slice(run, F.lit(1), turn)).alias("run"))
    mine, none = (k + F.col("f")) % 2 == 0, F.lit(0).cast("long")
    faces = turned.select(
        (k * 8 + (F.col("f") + k) % F.col("n")).alias("face_id"),
        F.when(mine, F.col("run")).otherwise(F.reverse("run")).alias("nodes"),
        F.when(mine, k).otherwise(none).alias("c0"),
        F.when(mine, none).otherwise(k).alias("c1"),
    )
    cells = c.select(k.alias("cell_id"), F.lit(1).alias("zone"), "type")
    whole = mesh.require_complete(mesh.cells_from_faces(faces, cells))
    return whole.select("cell_id", "type", F.array_join(F.col("nodes").cast("array<string>"), " ").alias("nodes"))


@query(
    f"""WITH RECURSIVE t AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey // 3 ELSE o_orderkey - o_orderkey % 4 END AS parent, o_orderkey AS child, o_totalprice AS u FROM orders WHERE o_orderkey > 0),
w AS (SELECT 0::BIGINT AS cell_id, 0::BIGINT AS root, 0::BIGINT AS depth UNION ALL SELECT child, root, depth + 1 FROM w JOIN t ON parent = cell_id),
inner_ AS (SELECT DISTINCT parent AS cell_id FROM t),
v AS (SELECT o_orderkey AS cell_id, o_totalprice AS u FROM orders WHERE o_orderkey NOT IN (SELECT cell_id FROM inner_)
  UNION ALL SELECT parent, coalesce(avg(t.u) FILTER (WHERE child NOT IN (SELECT cell_id FROM inner_)), 0) FROM t GROUP BY parent)
SELECT cell_id, root, depth, cell_id NOT IN (SELECT cell_id FROM inner_) AS leaf, {sql6('u', 4)} AS u FROM w JOIN v USING (cell_id)"""
)
def refinement_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every cell of a tree of orders, and values of its parents."""
    k = F.col("o_orderkey")
    o = a.table(spark, sf_dir, "orders")
    tree = o.where(k > 0).select(F.when(k % 4 == 0, F.floor(k / 3)).otherwise(k - k % 4).alias("parent"), k.alias("child"))
    values = mesh.parent_values(tree, o.select(k.alias("cell_id"), F.col("o_totalprice").alias("u")), ["u"])
    return rounded(mesh.tree_closure(tree).join(values, "cell_id"), "u", digits=4)


#: Digits to which fields are rounded before they are stored, as the order of summation shows beyond.
_STORED = {"jpinv": 6, "p": 3, "q": 3, "vx": 6, "vy": 6}


def _restored_sql(c: str, n: int) -> str:
    return sql6(f"CASE WHEN high_{c} - low_{c} < 1e-9 THEN low_{c} ELSE low_{c} + round(({c} - low_{c}) * 4095 / (high_{c} - low_{c})) * (high_{c} - low_{c}) / 4095 END", n) + f" AS {c}"


@query(
    f"WITH {PARTICLES}, {STENCIL}, {_FRAME}, {CELLS}, {_MASKED}, f AS (SELECT i, j, mask, "
    + ", ".join(f"{sql6(f'CASE WHEN mask = 1 AND status = 100 THEN {c} ELSE 0 END', n)} AS {c}" for c, n in _STORED.items())
    + " FROM masked), e AS (SELECT "
    + ", ".join(f"min({c}) AS low_{c}, max({c}) AS high_{c}" for c in _STORED)
    + " FROM f) SELECT i, j, mask, "
    + ", ".join(_restored_sql(c, n) for c, n in _STORED.items())
    + " FROM f, e"
)
def stored_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame stored with quantised fields, and what is read back."""
    frame = _masked(spark, sf_dir).withColumns({c: F.round(c, n) + 0.0 for c, n in _STORED.items()})
    path = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    frames.write_quantised_frame(frame, path, 7)
    back = frames.read_quantised_frame(spark, path, 7).select("i", "j", F.col("mask").cast("int").alias("mask"), *_STORED)
    for c, n in _STORED.items():
        back = rounded(back, c, digits=n)
    return back
