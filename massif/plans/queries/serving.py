"""Queries of lookups, links, regions, tile providers, images and attribution."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from massif.functions import images, regions, srs
from massif.operators.index import closure
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import _NODES, nodes
from massif.plans.registry import query
from massif.plans.shared import fresh_dir, shuffle_width
from massif.sources import files, raster_store, store

PT = f"WITH {fx.PT}"


@query("index_lookup", f"{PT}, {fx.LEAF}, {fx.sql_closure('leaf', 'ix', 5)}, k AS (SELECT level, index + 1 AS index FROM ix) SELECT k.level, k.index, coalesce(ix.status, 'Missing') AS status, coalesce(ix.status IN ('Leaf', 'Inner'), false) AS present FROM k LEFT JOIN ix ON k.level = ix.level AND k.index = ix.index")
def _(spark, sf):
    ix = closure(fx.leaves(spark, sf))
    return store.lookup(ix, ix.select("level", (F.col("index") + 1).alias("index")))


@query("index_set_status", f"{PT}, {fx.LEAF}, {fx.sql_closure('leaf', 'ix', 5)} SELECT level, index, CASE WHEN level = 5 AND index % 4 = 1 THEN 'Virtual' ELSE status END AS status FROM ix WHERE NOT (level = 5 AND index % 4 = 2)")
def _(spark, sf):
    ix = closure(fx.leaves(spark, sf))
    changed = ix.filter("level = 5 and index % 4 in (1, 2)").select("level", "index", F.when(F.col("index") % 4 == 1, "Virtual").otherwise("Missing").alias("status"))
    return store.set_status(ix, changed)


@query("link_with_hash", f"SELECT level, index, n FROM ({_NODES}) WHERE index % 3 = 0")
def _(spark, sf):
    """Nodes of a published snapshot, linked into another attempt and read from there."""
    n = nodes(spark, sf).withColumn("hash", store.content_hash(F.col("n")))
    final, other = fresh_dir(spark, "linked"), fresh_dir(spark, "linking")
    store.save_nodes(n, attempt := store.create_attempt(final))
    store.publish(spark, attempt, final)
    source = spark.read.parquet(f"{final}/nodes")
    store.save_nodes(store.link_hashed(source, source.filter("index % 3 = 0"), "n"), attempt := store.create_attempt(other))
    store.publish(spark, attempt, other)
    return spark.read.parquet(f"{other}/nodes").select("level", "index", "n")


_H = 20037508.342789244


@query("region_texts", f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 20 AS z, p_size AS s FROM part)
SELECT k, CASE WHEN k % 7 <> 0 THEN k * 0.5::DOUBLE + s END AS hi_x, CASE WHEN s < (1 << z) THEN round(s * ({2 * _H!r} / (1 << z)) - {_H!r}, 4) + 0.0 END AS tile_x,
  CASE WHEN s < (1 << z) AND z <= 20 THEN {fx.sql_morton('s', '0', '0', 6)} END AS index FROM p""")
def _(spark, sf):
    k, z, s = F.col("p_partkey"), (F.col("p_partkey") % 20).cast("string"), F.col("p_size").cast("string")
    p = fx.read(spark, sf, "part").select(k.alias("k"), z.alias("z"), s.alias("s"), (k * 0.5).cast("string").alias("x"))
    p = p.repartition(shuffle_width(spark))  # few bytes are much work
    values = F.concat_ws(",", "x", "s", F.lit("1"), F.when(F.col("k") % 7 == 0, "wide").otherwise(" 2"))
    b, t, n = regions.bounds_of_values(values), regions.bounds_of_tile(F.concat_ws(",", "z", "s", F.lit("0"))), regions.node_of(F.concat_ws(",", "z", "s", F.lit("0"), F.lit("0")))
    return p.select("k", b["hi_x"].alias("hi_x"), (F.round(t["lo_x"], 4) + 0.0).alias("tile_x"), n["index"].alias("index"))


@query("zoom_estimate", "SELECT p_partkey, CAST(round_even(log2(p_partkey * 1.5::DOUBLE), 0) AS BIGINT) AS zoom FROM part WHERE p_partkey > 0")
def _(spark, sf):
    return fx.read(spark, sf, "part").filter("p_partkey > 0").select("p_partkey", srs.zoom_of(F.col("p_partkey") * 1.5).alias("zoom"))


@query("tile_provider", f"WITH {fx.QK}, t AS (SELECT *, 't' || x || '.' || y AS content FROM qk WHERE (x + y) % 3 = 0) SELECT qk.zoom, qk.x, qk.y, t.content FROM qk LEFT JOIN t USING (zoom, x, y)")
def _(spark, sf):
    q = fx.quad_keys(spark, sf)
    tiles = q.filter((F.col("x") + F.col("y")) % 3 == 0).withColumn("content", F.concat(F.lit("t"), F.col("x").cast("string"), F.lit("."), F.col("y").cast("string")))
    return files.provided(q, tiles)


@query("png_roundtrip", f"WITH {fx.GROWN_PX} SELECT py, CAST(count(*) AS INTEGER) AS width, 4 AS bands, string_agg(lpad(to_hex(v % 256), 2, '0') || lpad(to_hex(px), 2, '0') || lpad(to_hex(attr), 2, '0') || 'FF', '' ORDER BY px) AS hex FROM px GROUP BY py")
def _(spark, sf):
    """Each row of the raster as an image of red, green, blue and alpha, encoded and decoded."""
    def byte(c):
        return F.lpad(F.hex(c), 2, "0")

    text = F.concat(byte(F.col("v") % 256), byte(F.col("px")), byte(F.col("attr")), F.lit("FF"))
    rows = fx.grown_pixels(spark, sf).groupBy("py").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("px", text.alias("t")))), lambda s: s["t"]), "").alias("h"), F.count(F.lit(1)).cast("int").alias("w"))
    png = rows.select("py", images.encoded(F.col("w"), F.lit(4), F.unhex("h")).alias("png"))
    return png.select("py", images.decoded("png").alias("i")).select("py", "i.width", "i.bands", F.hex("i.data").alias("hex"))


_ATTR = "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS idx, p_size / 4.0::DOUBLE AS spatial_resolution, p_name AS copyright FROM part WHERE p_partkey <= 200"


@query("attribution_copied", _ATTR)
def _(spark, sf):
    """An attribution table made of parts, copied from above one index to beside another and read there."""
    rows = fx.read(spark, sf, "part").filter("p_partkey <= 200").orderBy("p_partkey").collect()  # 200 rows
    table = [{"spatial_resolution": r.p_size / 4, "acquisition_date": "", "ingestion_date": "", "copyright": r.p_name, "copyright_link": "", "license": ""} for r in rows]
    source, target = fresh_dir(spark, "attribution"), fresh_dir(spark, "attribution")
    raster_store._write_bytes(spark, f"{source}/source_attribution_table.json", json.dumps(table).encode())
    raster_store.copy_attribution(spark, f"{source}/zoom/index", target)
    return store.read_attribution(spark, f"{target}/index").select("idx", "spatial_resolution", "copyright")
