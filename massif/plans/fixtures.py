"""The driver's tables as points, pixels, keys, meshes and boxes, in Spark and as the same common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.functions import octree
from massif.operators import mesh

UNIT = octree.Space(-1.0, 2.0)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[e[i].cast("double").alias(n) for i, n in enumerate("xyz")], F.col("label").cast("long").alias("label"))


PT = "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS label FROM embeddings)"


def sql_morton(x: str, y: str, z: str, bits: int) -> str:
    return "CAST((" + " + ".join(["0"] + [f"((({c} >> {b}) & 1) << {3 * b + d})" for b in range(bits) for d, c in enumerate((x, y, z))]) + ") AS BIGINT)"


def sql_coord(index: str, axis: int, bits: int) -> str:
    return "CAST((" + " + ".join(f"((({index} >> {3 * b + axis}) & 1) << {b})" for b in range(bits)) + ") AS BIGINT)"


def sql_at(p: str, level: int) -> str:
    return f"CAST(floor(({p} + 1) / (2.0 / {2**level})) AS BIGINT)"


def sql_cell(level: int, x: str = "x", y: str = "y", z: str = "z") -> str:
    return sql_morton(sql_at(x, level), sql_at(y, level), sql_at(z, level), level)


def leaves(spark: SparkSession, sf: str, level: int = 5) -> DataFrame:
    """Distinct cells of the points on a level."""
    p = points(spark, sf)
    cell = octree.cell_of(UNIT, F.lit(level), F.col("x"), F.col("y"), F.col("z"))
    return p.select(F.lit(level).cast("long").alias("level"), cell.alias("index")).distinct()


LEAF = f"leaf AS (SELECT DISTINCT CAST(5 AS BIGINT) AS level, {sql_cell(5)} AS index FROM pt)"


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """32 by 32 pixels with an integer value, an attribution and a validity."""
    li = read(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    p = li.groupBy((k % 32).cast("long").alias("px"), (F.floor(k / 32) % 32).cast("long").alias("py"))
    p = p.agg(F.sum("l_quantity").cast("long").alias("v"), (F.min("l_suppkey") % 25).cast("long").alias("attr"))
    return p.withColumn("valid", F.col("v") % 7 != 0)


PX = """px AS (SELECT *, v % 7 <> 0 AS valid FROM (SELECT CAST(l_orderkey % 32 AS BIGINT) AS px, CAST((l_orderkey // 32) % 32 AS BIGINT) AS py,
  CAST(sum(l_quantity) AS BIGINT) AS v, CAST(min(l_suppkey) % 25 AS BIGINT) AS attr FROM lineitem GROUP BY 1, 2))"""


def quad_keys(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    y = ((F.dayofmonth(ts) - 1) * 24 + F.hour(ts)) % 64
    return read(spark, sf, "events").select(F.lit(6).cast("long").alias("zoom"), (F.col("user_id") % 64).cast("long").alias("x"), y.cast("long").alias("y")).distinct()


QK = "qk AS (SELECT DISTINCT CAST(6 AS BIGINT) AS zoom, CAST(user_id % 64 AS BIGINT) AS x, CAST(((day(ts) - 1) * 24 + hour(ts)) % 64 AS BIGINT) AS y FROM events)"


def tree_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Leaves on level 3 of even points, and on level 4 of odd ones."""
    p = points(spark, sf)

    def of(parity: int, level: int) -> DataFrame:
        cell = octree.cell_of(UNIT, F.lit(level), F.col("x"), F.col("y"), F.col("z"))
        return p.filter(F.col("id") % 2 == parity).select(F.lit(level).cast("long").alias("level"), cell.alias("index")).distinct()

    return of(0, 3), of(1, 4)


PAIR = f"""lp AS (SELECT DISTINCT CAST(3 AS BIGINT) AS level, {sql_cell(3)} AS index FROM pt WHERE id % 2 = 0),
rp AS (SELECT DISTINCT CAST(4 AS BIGINT) AS level, {sql_cell(4)} AS index FROM pt WHERE id % 2 = 1)"""


def sql_closure(physical: str, name: str, depth: int) -> str:
    """Status of every key of a physical set and of its ancestors."""
    return f"""{name} AS (SELECT level, index, CASE WHEN max(own) = 1 AND max(below) = 1 THEN 'Inner' WHEN max(own) = 1 THEN 'Leaf' ELSE 'Virtual' END AS status
  FROM (SELECT level - k AS level, index >> CAST(3 * k AS BIGINT) AS index, CASE WHEN k = 0 THEN 1 ELSE 0 END AS own, CASE WHEN k > 0 THEN 1 ELSE 0 END AS below
    FROM {physical}, (SELECT unnest(range(0, {depth + 1})) AS k) WHERE k <= level) GROUP BY 1, 2)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("label").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"])


BOX = "bx AS (SELECT label, min(x) AS lo_x, min(y) AS lo_y, min(z) AS lo_z, max(x) AS hi_x, max(y) AS hi_y, max(z) AS hi_z FROM pt GROUP BY label)"


def grid_mesh(spark: SparkSession, sf: str) -> DataFrame:
    """Triangles (a, b, c) over the valid pixels; vertex ids are py * 32 + px."""
    return mesh.meshify(pixels(spark, sf), width=32).select("a", "b", "c")


MESH = """ok AS (SELECT px, py, v FROM px WHERE valid),
quad AS (SELECT q.x AS x, q.y AS y, a.v IS NOT NULL AS c0, b.v IS NOT NULL AS c1, c.v IS NOT NULL AS c2, d.v IS NOT NULL AS c3
  FROM (SELECT DISTINCT px - dx AS x, py - dy AS y FROM ok, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) o(dx, dy) WHERE px - dx BETWEEN 0 AND 30 AND py - dy BETWEEN 0 AND 30) q
  LEFT JOIN ok a ON a.px = x AND a.py = y LEFT JOIN ok b ON b.px = x + 1 AND b.py = y
  LEFT JOIN ok c ON c.px = x + 1 AND c.py = y + 1 LEFT JOIN ok d ON d.px = x AND d.py = y + 1),
q4 AS (SELECT y * 32 + x AS i, c0, c1, c2, c3 FROM quad),
tri AS (
  SELECT i AS a, i + 1 AS b, i + 33 AS c FROM q4 WHERE c0 AND c1 AND c2
  UNION ALL SELECT i + 33, i + 32, i FROM q4 WHERE c2 AND c3 AND c0
  UNION ALL SELECT i + 1, i + 33, i + 32 FROM q4 WHERE NOT c0 AND c1 AND c2 AND c3
  UNION ALL SELECT i + 32, i, i + 1 FROM q4 WHERE c0 AND c1 AND NOT c2 AND c3)"""
HALF_EDGES = "he AS (SELECT a AS u, b AS v, a, b, c FROM tri UNION ALL SELECT b, c, a, b, c FROM tri UNION ALL SELECT c, a, a, b, c FROM tri)"
VERTS = "vert AS (SELECT CAST(py * 32 + px AS BIGINT) AS vid, CAST(px AS DOUBLE) AS x, CAST(py AS DOUBLE) AS y, CAST(v AS DOUBLE) AS z FROM px WHERE valid)"


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    p = pixels(spark, sf).filter("valid")
    return p.select((F.col("py") * 32 + F.col("px")).alias("vid"), *[F.col(a).cast("double").alias(b) for a, b in (("px", "x"), ("py", "y"), ("v", "z"))])


# Fixtures that grow with the tables: a point for each line item, and a raster of 256 columns with a pixel for each order.


def grown_points(spark: SparkSession, sf: str) -> DataFrame:
    o, n, p, q = (F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    at = {"x": o * 7919 + n * 104729, "y": p * 15485863 + q * 32452843 + n * 611953, "z": o * 49979687 + n * 86028121}
    return read(spark, sf, "lineitem").select((o * 8 + n).alias("id"), *[((v % 100003) / 50001.5 - 1).alias(c) for c, v in at.items()], (n % 3).alias("mesh"))


GROWN_PT = """pt AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_orderkey * 7919 + l_linenumber * 104729) % 100003 / 50001.5::DOUBLE - 1 AS x,
  (l_partkey * 15485863 + l_suppkey * 32452843 + l_linenumber * 611953) % 100003 / 50001.5::DOUBLE - 1 AS y, (l_orderkey * 49979687 + l_linenumber * 86028121) % 100003 / 50001.5::DOUBLE - 1 AS z FROM lineitem)"""


def grown_pixels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey")
    p = read(spark, sf, "lineitem").groupBy((k % 256).cast("long").alias("px"), F.floor(k / 256).cast("long").alias("py"))
    return p.agg(F.sum("l_quantity").cast("long").alias("v"), (F.min("l_suppkey") % 25).cast("long").alias("attr")).withColumn("valid", F.col("v") % 7 != 0)


GROWN_PX = """px AS (SELECT *, v % 7 <> 0 AS valid FROM (SELECT CAST(l_orderkey % 256 AS BIGINT) AS px, CAST(l_orderkey // 256 AS BIGINT) AS py,
  CAST(sum(l_quantity) AS BIGINT) AS v, CAST(min(l_suppkey) % 25 AS BIGINT) AS attr FROM lineitem GROUP BY 1, 2))"""
