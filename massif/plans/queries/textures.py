"""Queries on textures."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.operators import texture
from massif.plans import fixtures as fx
from massif.plans.registry import query, rounded


@query("texture_dedup", "SELECT p_type, row_number() OVER (ORDER BY f) - 1 AS texture_id FROM (SELECT p_type, min(p_partkey) AS f FROM part GROUP BY p_type)")
def _(spark, sf):
    return texture.deduplicate(fx.read(spark, sf, "part"), "p_type", "p_partkey")


@query("texture_shared", "SELECT p_partkey % 700 AS node, min(p_type) AS p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1")
def _(spark, sf):
    p = fx.read(spark, sf, "part").select((F.col("p_partkey") % 700).alias("node"), "p_type")
    return texture.shared(p, "node", "p_type")


_IMG = "i AS (SELECT p_partkey % 50 AS node, p_partkey AS id, 8 + p_partkey % 40 AS w, 4 + p_partkey % 30 AS h FROM part)"


def _images(spark, sf):
    k = F.col("p_partkey")
    return fx.read(spark, sf, "part").select((k % 50).alias("node"), k.alias("id"), (8 + k % 40).alias("w"), (4 + k % 30).alias("h"))


@query("atlas_strip", f"WITH {_IMG} SELECT node, id, w, h, CAST(sum(w) OVER (PARTITION BY node ORDER BY id) - w AS BIGINT) AS x, CAST(sum(w) OVER (PARTITION BY node) AS BIGINT) AS atlas_w, max(h) OVER (PARTITION BY node) AS atlas_h FROM i")
def _(spark, sf):
    return texture.strip_plan(_images(spark, sf), "node", "id")


@query("atlas_uv", f"WITH {_IMG}, s AS (SELECT id, w, h, sum(w) OVER (PARTITION BY node ORDER BY id) - w AS x, sum(w) OVER (PARTITION BY node) AS aw, max(h) OVER (PARTITION BY node) AS ah FROM i) SELECT id, round((x + 0.25 * w) / CAST(aw AS DOUBLE), 6) AS u, round(0.5 * h / CAST(ah AS DOUBLE), 6) AS v FROM s")
def _(spark, sf):
    d = texture.strip_plan(_images(spark, sf), "node", "id").withColumns({"u": F.lit(0.25).cast("double"), "v": F.lit(0.5).cast("double")})
    u, v = rounded(F.col("u"), F.col("v"))
    return texture.remap_uv(d).select("id", u.alias("u"), v.alias("v"))


_T = f"{fx.QK}, t AS (SELECT zoom, x, y FROM qk WHERE (x + y) % 2 = 0 UNION SELECT zoom - 2, x >> 2, y >> 2 FROM qk WHERE x % 3 = 0), c AS (SELECT *, (x * 31 + y * 17 + zoom) % 256 AS v FROM t)"


@query("texture_splat", f"WITH {_T} SELECT x * (1 << CAST(6 - zoom AS INTEGER)) + a AS x, y * (1 << CAST(6 - zoom AS INTEGER)) + b AS y, max_by(v, zoom) AS v FROM c, (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b) WHERE a < (1 << CAST(6 - zoom AS INTEGER)) AND b < (1 << CAST(6 - zoom AS INTEGER)) GROUP BY 1, 2")
def _(spark, sf):
    k = fx.quad_keys(spark, sf)
    up = k.filter("x % 3 = 0").select((F.col("zoom") - 2).alias("zoom"), F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y"))
    tiles = k.filter("(x + y) % 2 = 0").union(up).distinct()
    return texture.splat(tiles.withColumn("v", (F.col("x") * 31 + F.col("y") * 17 + F.col("zoom")) % 256), 6, "v")


@query("atlas_square")
def _(spark, sf):
    k = F.col("p_partkey")
    images = fx.read(spark, sf, "part").select(F.floor(k / 40).alias("node"), k.alias("id"), (8 + k * 7 % 40).alias("w"), (4 + k * 11 % 30).alias("h"))
    return texture.square_plan(images, "node", "id")
