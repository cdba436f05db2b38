"""Queries on hierarchy indexes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from massif.functions import octree
from massif.operators import index
from massif.plans import fixtures as fx
from massif.plans.registry import query

CLOSED = f"WITH {fx.PT}, {fx.LEAF}, {fx.sql_closure('leaf', 'ix', 5)}"
# Stored: the leaves and, of every second level-3 ancestor, that too.
MIXED = f"{fx.PT}, {fx.LEAF}, mixed AS (SELECT level, index FROM leaf UNION SELECT DISTINCT CAST(3 AS BIGINT), index >> 6 FROM leaf WHERE (index >> 6) % 2 = 0)"


def closed(spark, sf):
    return index.closure(fx.leaves(spark, sf))


def mixed(spark, sf):
    leaf = fx.leaves(spark, sf)
    up = leaf.select(F.lit(3).cast("long").alias("level"), F.shiftright("index", 6).alias("index")).filter("index % 2 = 0")
    return leaf.union(up).distinct()


@query("index_status_counts", f"{CLOSED} SELECT level, status, count(*) AS n FROM ix GROUP BY level, status")
def index_status_counts(spark, sf):
    return closed(spark, sf).groupBy("level", "status").agg(F.count(F.lit(1)).alias("n"))


@query("index_with_inner", f"WITH {MIXED}, {fx.sql_closure('mixed', 'ix', 5)} SELECT * FROM ix")
def _(spark, sf):
    return index.closure(mixed(spark, sf))


@query("index_add", f"WITH {MIXED}, {fx.sql_closure('mixed', 'ix', 5)} SELECT * FROM ix")
def _(spark, sf):
    leaf = fx.leaves(spark, sf)
    up = leaf.select(F.lit(3).cast("long").alias("level"), F.shiftright("index", 6).alias("index")).filter("index % 2 = 0").distinct()
    return index.add(index.closure(leaf), up)


@query("index_after_remove", f"WITH {fx.PT}, {fx.LEAF}, kept AS (SELECT * FROM leaf WHERE index % 3 <> 0), {fx.sql_closure('kept', 'ix', 5)} SELECT * FROM ix")
def _(spark, sf):
    ix = closed(spark, sf)
    return index.remove(ix, ix.filter("level = 5 and index % 3 = 0"))


@query("index_violations", f"""{CLOSED}, broken AS (SELECT * FROM ix WHERE NOT (level = 5 AND index % 5 = 0) AND NOT (level = 2 AND index % 4 = 1)),
kid AS (SELECT DISTINCT level - 1 AS level, index >> 3 AS index FROM broken WHERE level > 0)
SELECT coalesce(b.level, k.level) AS level, coalesce(b.index, k.index) AS index,
  CASE WHEN b.status IS NULL THEN 'missing parent' WHEN b.status = 'Leaf' THEN 'leaf with child' ELSE 'no child' END AS rule
FROM broken b FULL OUTER JOIN kid k ON b.level = k.level AND b.index = k.index
WHERE b.status IS NULL OR (b.status = 'Leaf' AND k.level IS NOT NULL) OR (b.status <> 'Leaf' AND k.level IS NULL)""")
def _(spark, sf):
    return index.violations(closed(spark, sf).filter("not (level = 5 and index % 5 = 0) and not (level = 2 and index % 4 = 1)"))


@query("sf_inner_violations", f"WITH {MIXED}, {fx.sql_closure('mixed', 'ix', 5)} SELECT level, index FROM ix WHERE status = 'Inner'")
def _(spark, sf):
    return index.inner_nodes(index.closure(mixed(spark, sf))).select("level", "index")


@query("traverse_bfs", f"{CLOSED} SELECT level, index, row_number() OVER (ORDER BY level, index) AS place FROM ix")
def _(spark, sf):
    # Numbered within a level, then levels one after another: no task orders all nodes of a deep tree.
    ix = closed(spark, sf)
    base = ix.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("level")) - F.col("n"))
    n = ix.withColumn("r", F.row_number().over(Window.partitionBy("level").orderBy("index")))
    return n.join(base, "level").select("level", "index", (F.col("base") + F.col("r")).alias("place"))


@query("traverse_dfs_preorder", f"""{CLOSED}, o AS (SELECT level, index, index << CAST(3 * (5 - level) AS BIGINT) AS k FROM ix)
SELECT level, index, row_number() OVER (ORDER BY k, level) AS place FROM o""")
def _(spark, sf):
    # Numbered within each branch below level 1, then branches one after another behind the nodes above them.
    ix = closed(spark, sf).withColumn("top", F.when(F.col("level") >= 2, octree.up(F.col("index"), F.col("level") - 2)))
    ix = ix.withColumn("top", F.coalesce("top", octree.down(F.col("index"), 2 - F.col("level"))))
    n = ix.withColumn("r", F.row_number().over(Window.partitionBy("top").orderBy(*index.depth_first())))
    base = ix.groupBy("top").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("top")) - F.col("n"))  # one row a branch
    return n.join(base, "top").select("level", "index", (F.col("base") + F.col("r")).alias("place"))


@query("traverse_refine_pruned", f"""{CLOSED}, stop AS (SELECT level, index FROM ix WHERE level >= 2 AND index % 3 = 1)
SELECT level, index, status FROM ix WHERE NOT EXISTS (SELECT 1 FROM stop WHERE stop.level < ix.level AND ix.index >> CAST(3 * (ix.level - stop.level) AS BIGINT) = stop.index)""")
def _(spark, sf):
    return index.traverse(closed(spark, sf), ~((F.col("level") >= 2) & (F.col("index") % 3 == 1)))


@query("tree_drilldown", f"{CLOSED} SELECT level, index, status, row_number() OVER (PARTITION BY level, index >> 3 ORDER BY index) - 1 AS nth FROM ix")
def _(spark, sf):
    return index.number_children(closed(spark, sf)).withColumn("nth", F.col("nth").cast("long"))


@query("deepest_root", f"""{CLOSED}, k AS (SELECT level - 1 AS level, index >> 3 AS index, count(*) AS n FROM ix WHERE level > 0 GROUP BY 1, 2)
SELECT ix.level, ix.index, coalesce(n, 0) AS n_children FROM ix LEFT JOIN k ON ix.level = k.level AND ix.index = k.index
WHERE coalesce(n, 0) <> 1 ORDER BY 1, 2 LIMIT 1""")
def _(spark, sf):
    return index.deepest_root(closed(spark, sf))


@query("hash_validation", f"""{CLOSED}, h AS (SELECT level, CASE WHEN index % 11 = 0 THEN index + 1000000 ELSE index END AS index FROM leaf)
SELECT level, index, 'no hash' AS rule FROM leaf WHERE (level, index) NOT IN (SELECT (level, index) FROM h)
UNION ALL SELECT level, index, 'no node' FROM h WHERE (level, index) NOT IN (SELECT (level, index) FROM leaf)""")
def _(spark, sf):
    h = fx.leaves(spark, sf).select("level", F.when(F.col("index") % 11 == 0, F.col("index") + 1000000).otherwise(F.col("index")).alias("index"))
    return index.unhashed(closed(spark, sf), h)


_CENTRE = " + ".join(f"power(-1 + ({fx.sql_coord('index', k, 5)} + 0.5) * (2.0 / (1 << CAST(level AS INTEGER))) - {e}, 2)" for k, e in enumerate((0.05, 0.0, -0.05)))


@query("refine_view", f"""{CLOSED}, s AS (SELECT level, index, sqrt({_CENTRE}) / (2.0 / (1 << CAST(level AS INTEGER)) * sqrt(3)) <= 1.5 AND status <> 'Leaf' AS split FROM ix)
SELECT level, index FROM s WHERE NOT split AND NOT EXISTS (
  SELECT 1 FROM s a WHERE NOT a.split AND a.level < s.level AND s.index >> CAST(3 * (s.level - a.level) AS BIGINT) = a.index)""")
def _(spark, sf):
    return index.refine_by_distance(closed(spark, sf), fx.UNIT, (0.05, 0.0, -0.05), 1.5).select("level", "index")


@query("ancestor_rollup", f"WITH {fx.PT}, a AS (SELECT {fx.sql_cell(5)} AS index, label FROM pt) SELECT 5 - k AS level, index >> CAST(3 * k AS BIGINT) AS index, count(*) AS n, sum(label) AS total FROM a, (SELECT unnest(range(0, 6)) AS k) GROUP BY 1, 2".replace("sum(label)", "CAST(sum(label) AS BIGINT)"))
def _(spark, sf):
    p = fx.points(spark, sf)
    cell = octree.cell_of(fx.UNIT, F.lit(5), F.col("x"), F.col("y"), F.col("z"))
    leaf = p.groupBy(cell.alias("index")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("total"))
    up = index.with_ancestors(leaf.withColumn("level", F.lit(5).cast("long")))
    return up.groupBy("level", "index").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("crawl_frontier", f"""WITH RECURSIVE {fx.QK}, have AS (SELECT DISTINCT zoom - k AS zoom, x >> CAST(k AS BIGINT) AS x, y >> CAST(k AS BIGINT) AS y FROM qk, (SELECT unnest(range(0, 7)) AS k) WHERE (x + y) % 5 <> 0),
c AS (SELECT CAST(0 AS BIGINT) AS zoom, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y
  UNION ALL SELECT c.zoom + 1, 2 * c.x + i, 2 * c.y + j FROM c JOIN have ON c.zoom = have.zoom AND c.x = have.x AND c.y = have.y, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE c.zoom < 6)
SELECT c.zoom, c.x, c.y, CASE WHEN have.x IS NULL THEN 'Absent' ELSE 'Fetched' END AS status FROM c LEFT JOIN have ON c.zoom = have.zoom AND c.x = have.x AND c.y = have.y""")
def _(spark, sf):
    k = fx.quad_keys(spark, sf).filter((F.col("x") + F.col("y")) % 5 != 0).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    up = [F.call_function("shiftright", F.col(c), F.col("k")).alias(c) for c in "xy"]
    have = k.select((F.col("zoom") - F.col("k")).alias("zoom"), *up).distinct()
    root = spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in ("zoom", "x", "y")])
    return index.crawl(root, have, 6)


@query("crawl_fraction", f"WITH {fx.QK} SELECT round(sum(power(4.0, -zoom)), 6) AS done FROM qk")
def _(spark, sf):
    return fx.quad_keys(spark, sf).agg(F.round(F.sum(F.pow(F.lit(4.0), -F.col("zoom"))), 6).alias("done"))
