"""Domain tables made from the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import encode
from ..params import SimParams

#: Parameters of the registered queries; positions are in cells.
PRM = SimParams(
    dimension_horizontal=430000.0, dt=0.17, frame_period=300.0, tensile_strength=3e6, tensile_strength2=3e6,
    shear_strength=2.5e6, dp_threshold=-1e4, ridge_coeff=0.5, drag_linear=0.001, drag_quadratic=0.25, cellsize=215.0,
    particle_volume=9000.0,
)
#: The grid that holds all positions.
GX, GY = 120, 48
DIGITS = 6


def r6(c: Column, digits: int = DIGITS) -> Column:
    return F.round(c, digits)


def sql6(e: str, digits: int = DIGITS) -> str:
    return f"(round({e}, {digits}) + 0.0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles from lineitem: positions from price and quantity, state from the other numbers."""
    l = table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    raw = l.select(
        F.col("l_orderkey").alias("okey"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") / 1000).alias("x"),
        (q * 0.73).alias("y"),
        (t - 0.04).alias("vx"),
        (d - 0.05).alias("vy"),
        (0.8 + d).alias("thickness"),
        (0.9537 + d).alias("fe00"),
        (t - 0.04).alias("fe01"),
        ((q - 25) / 500).alias("fe10"),
        (0.96 + t).alias("fe11"),
        t.alias("bp00"),
        (d / 2).alias("bp01"),
        (-t / 2).alias("bp10"),
        (q / 5000).alias("bp11"),
        (0.9 + d).alias("jp_inv"),
        (q * 1000).alias("p"),
        (F.col("l_extendedprice") / 10).alias("q"),
        (F.col("l_returnflag") == "R").alias("crushed"),
        (F.col("l_linenumber") == 7).alias("disabled"),
        F.floor(q * 5).cast("int").alias("r"),
        F.floor(d * 2000).cast("int").alias("g"),
        F.floor(t * 2000).cast("int").alias("b"),
    )
    return encode(raw, 1.0)


PARTICLES = """
p0 AS (
  SELECT l_orderkey AS okey, l_linenumber AS line, l_extendedprice / 1000 AS x, l_quantity * 0.73 AS y,
         l_tax - 0.04 AS vx, l_discount - 0.05 AS vy, 0.8 + l_discount AS thickness,
         0.9537 + l_discount AS fe00, l_tax - 0.04 AS fe01, (l_quantity - 25) / 500 AS fe10, 0.96 + l_tax AS fe11,
         l_tax AS bp00, l_discount / 2 AS bp01, -l_tax / 2 AS bp10, l_quantity / 5000 AS bp11,
         0.9 + l_discount AS jp_inv, l_quantity * 1000 AS p, l_extendedprice / 10 AS q,
         l_returnflag = 'R' AS crushed, l_linenumber = 7 AS disabled,
         CAST(floor(l_quantity * 5) AS INTEGER) AS r, CAST(floor(l_discount * 2000) AS INTEGER) AS g, CAST(floor(l_tax * 2000) AS INTEGER) AS b
  FROM lineitem
), p AS (
  SELECT * EXCLUDE (x, y), CAST(floor(x + 0.5) AS INTEGER) AS ci, CAST(floor(y + 0.5) AS INTEGER) AS cj,
         x - floor(x + 0.5) AS fx, y - floor(y + 0.5) AS fy
  FROM p0
)"""

#: The nine node offsets and their weights for each particle, as a join.
STENCIL = """
o AS (SELECT a.d AS di, b.d AS dj FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)),
s AS (
  SELECT p.*, ci + di AS i, cj + dj AS j, di, dj,
         (CASE di WHEN -1 THEN 0.5 * (0.5 - fx) * (0.5 - fx) WHEN 0 THEN 0.75 - fx * fx ELSE 0.5 * (0.5 + fx) * (0.5 + fx) END)
       * (CASE dj WHEN -1 THEN 0.5 * (0.5 - fy) * (0.5 - fy) WHEN 0 THEN 0.75 - fy * fy ELSE 0.5 * (0.5 + fy) * (0.5 + fy) END) AS w
  FROM p, o
)"""


def cells(spark: SparkSession) -> DataFrame:
    """(i, j, status, cvx, cvy) of the grid: strips of boundaries and interiors, the rest modelled."""
    i, j = F.floor(F.col("id") / GY).cast("int"), (F.col("id") % GY).cast("int")
    status = F.when((F.col("i") + F.col("j")) % 17 == 0, 0).when(F.col("i") % 10 == 0, F.col("j") % 5 + 1).when(F.col("i") % 10 == 5, F.col("j") % 3 + 101)
    return spark.range(GX * GY).select(i.alias("i"), j.alias("j")).select(
        "i",
        "j",
        status.otherwise(100).cast("int").alias("status"),
        ((F.col("i") % 7 - 3) * 0.01).alias("cvx"),
        ((F.col("j") % 5 - 2) * 0.02).alias("cvy"),
    )


CELLS = f"""
cells AS (
  SELECT i, j, CAST(CASE WHEN (i + j) % 17 = 0 THEN 0 WHEN i % 10 = 0 THEN j % 5 + 1 WHEN i % 10 = 5 THEN j % 3 + 101 ELSE 100 END AS INTEGER) AS status,
         (i % 7 - 3) * CAST(0.01 AS DOUBLE) AS cvx, (j % 5 - 2) * CAST(0.02 AS DOUBLE) AS cvy
  FROM (SELECT CAST(range // {GY} AS INTEGER) AS i, CAST(range % {GY} AS INTEGER) AS j FROM range({GX * GY}))
)"""


def image(spark: SparkSession) -> DataFrame:
    """(x, y, r, g, b) of a picture as large as the grid."""
    c = cells(spark).select(F.col("i").alias("x"), F.col("j").alias("y"))
    return c.select(
        "x", "y", ((F.col("x") * 2) % 256).alias("r"), ((F.col("x") + F.col("y") * 3) % 256).alias("g"), ((F.col("x") * F.col("y")) % 256).alias("b")
    )


IMAGE = "image AS (SELECT i AS x, j AS y, (i * 2) % 256 AS r, (i + j * 3) % 256 AS g, (i * j) % 256 AS b FROM cells)"


def map_px(spark: SparkSession) -> DataFrame:
    """(x, y, path_index, ice_status, ice_thickness) as large as the grid."""
    c = cells(spark).select(F.col("i").alias("x"), F.col("j").alias("y"))
    return c.select(
        "x",
        "y",
        F.when((F.col("x") < 5) | (F.col("y") < 3), -1).when(F.col("x") % 9 == 0, F.col("y") % 4).otherwise(1000 + F.col("y") % 3).cast("int").alias("path_index"),
        ((F.col("x") + F.col("y")) % 4).cast("int").alias("ice_status"),
        (0.8 + (F.col("x") % 5) * 0.05).alias("ice_thickness"),
    )


MAP_PX = """
map_px AS (
  SELECT i AS x, j AS y, CASE WHEN i < 5 OR j < 3 THEN -1 WHEN i % 9 = 0 THEN j % 4 ELSE 1000 + j % 3 END AS path_index,
         (i + j) % 4 AS ice_status, 0.8 + (i % 5) * CAST(0.05 AS DOUBLE) AS ice_thickness
  FROM cells
)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, r, g, b) in [0, 1] from the first three dimensions of the embeddings."""
    e = table(spark, sf_dir, "embeddings")
    tone = [F.least(F.greatest(F.element_at("embedding", k + 1).cast("double") + 0.5, F.lit(0.0)), F.lit(1.0)).alias(c) for k, c in enumerate("rgb")]
    return e.select("vec_id", *tone)


COLOURS = "colours AS (SELECT vec_id, " + ", ".join(
    f"least(greatest(CAST(embedding[{k + 1}] AS DOUBLE) + 0.5, 0.0), 1.0) AS {c}" for k, c in enumerate("rgb")
) + " FROM embeddings)"

#: Colour curves of open water and of ice.
OPEN_WATER = ((0.0, 0.0, 0.0), (0.08235, 0.12157, 0.18431), (0.11373, 0.16078, 0.22745), (0.15686, 0.23137, 0.32157))
SOLID = ((0.67451, 0.69020, 0.69412), (0.76863, 0.78431, 0.79608), (0.78431, 0.78824, 0.79216))


#: Width of the map whose pixels are the orders; its height grows with their number.
MAP_WIDTH = 120


def order_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, path_index, ice_status, ice_thickness, vx, vy, r, g, b): a pixel of a map, a flow and a picture for each order."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.floor("o_totalprice")
    x, y = k % MAP_WIDTH, F.floor(k / MAP_WIDTH)
    path = F.when((x < 3) | (y < 2), -1).when(c % 11 == 0, F.floor(c / 11) % 7).when(c % 7 == 0, 1000 + F.floor(c / 7) % 9)
    return table(spark, sf_dir, "orders").select(
        x.cast("int").alias("x"),
        y.cast("int").alias("y"),
        path.otherwise(1000).cast("int").alias("path_index"),
        (price % 4).cast("int").alias("ice_status"),
        (0.8 + (price % 5) * 0.05).alias("ice_thickness"),
        ((c % 101 - 50) * 0.01).alias("vx"),
        ((price % 89 - 44) * 0.02).alias("vy"),
        (c * 2 % 256).cast("int").alias("r"),
        (price % 256).cast("int").alias("g"),
        (x * y % 256).cast("int").alias("b"),
    )


def map_height(spark: SparkSession, sf_dir: str) -> int:
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return 0 if last is None else int(last) // MAP_WIDTH + 1


ORDER_MAP = f"""
omap AS (
  SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(CASE WHEN x < 3 OR y < 2 THEN -1 WHEN c % 11 = 0 THEN c // 11 % 7 WHEN c % 7 = 0 THEN 1000 + c // 7 % 9 ELSE 1000 END AS INTEGER) AS path_index,
         price % 4 AS ice_status, 0.8e0 + (price % 5) * 0.05e0 AS ice_thickness, (c % 101 - 50) * 0.01e0 AS vx, (price % 89 - 44) * 0.02e0 AS vy,
         CAST(c * 2 % 256 AS INTEGER) AS r, CAST(price % 256 AS INTEGER) AS g, CAST(x * y % 256 AS INTEGER) AS b
  FROM (SELECT o_orderkey % {MAP_WIDTH} AS x, o_orderkey // {MAP_WIDTH} AS y, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)
)"""

#: Corners of a polygon, and the directions in which they lie from its centre.
CORNERS = 16
DIRECTIONS = [(8, 0), (7, 3), (6, 6), (3, 7), (0, 8), (-3, 7), (-6, 6), (-7, 3), (-8, 0), (-7, -3), (-6, -6), (-3, -7), (0, -8), (3, -7), (6, -6), (7, -3)]


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, seq, x, y): closed polylines with a corner for each customer, overlapping, in rows of eight; their number grows with the table."""
    k = F.col("c_custkey")
    path, seq, far = F.floor(k / CORNERS), (k % CORNERS).cast("int"), 1 + F.col("c_nationkey") % 3

    def corner(axis: int) -> Column:
        return F.element_at(F.array(*[F.lit(d[axis]) for d in DIRECTIONS]), seq + 1) * far

    return table(spark, sf_dir, "customer").select(
        path.cast("int").alias("path"), seq.alias("seq"), (corner(0) + 30 + path % 8 * 22).cast("int").alias("x"), (corner(1) + 30 + F.floor(path / 8) * 22).cast("int").alias("y")
    )


def _directions(axis: int) -> str:
    return "[" + ", ".join(str(d[axis]) for d in DIRECTIONS) + "]"


POLYGON_SQL = f"""
poly AS (
  SELECT CAST(k // {CORNERS} AS INTEGER) AS path, CAST(k % {CORNERS} AS INTEGER) AS seq,
         CAST({_directions(0)}[k % {CORNERS} + 1] * far + 30 + k // {CORNERS} % 8 * 22 AS INTEGER) AS x, CAST({_directions(1)}[k % {CORNERS} + 1] * far + 30 + k // {CORNERS} // 8 * 22 AS INTEGER) AS y
  FROM (SELECT c_custkey AS k, 1 + c_nationkey % 3 AS far FROM customer)
), edges AS (
  SELECT path, x AS xa, y AS ya, coalesce(lead(x) OVER o, first_value(x) OVER o) AS xb, coalesce(lead(y) OVER o, first_value(y) OVER o) AS yb
  FROM poly WINDOW o AS (PARTITION BY path ORDER BY seq)
)"""
