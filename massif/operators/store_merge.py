"""Merging and cutting of stored datasets by a mask: what the mask doesn't cut is linked, the rest is written, part by part.

A store is a published snapshot with two tables, both in preorder of the tree: `index` (level, index, first, hash, home), a
row a leaf, and `nodes` (level, index, first, hash, content), the content of the leaves that the store itself holds. `first`
is the first cell below a key on the deepest level, so a subtree is one range of it. `home` is null for own content, else
the path of the store that holds it: a link costs an index row and no content. Stores that others link to must stay;
`compact` writes one that links to none. Content is an array of (id, polygon)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massif.functions import octree
from massif.operators import masks, merge, spatial
from massif.operators.index import closure, with_ancestors
from massif.plans.shared import qualified, stash
from massif.sources import store

KEY = ("level", "index")
LINK = "level bigint, index bigint, first bigint, hash bigint, home string"


def first_below(level: Column, index: Column) -> Column:
    return octree.down(index, octree.MAX_LEVEL - level)


def _nodes(rows: DataFrame) -> DataFrame:
    """A row a node from polygons (level, index, id, polygon), whatever their order."""
    content = F.sort_array(F.collect_list(F.struct("id", "polygon"))).alias("content")
    return rows.groupBy(*KEY).agg(content).select(*KEY, first_below(F.col("level"), F.col("index")).alias("first"), store.content_hash(F.col("content")).alias("hash"), "content")


def _save(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("first", "level").sortWithinPartitions("first", "level").write.mode("overwrite").parquet(path)


def _require_leaves(index: DataFrame, what: str) -> None:
    if not closure(index).filter("status = 'Inner'").isEmpty():
        raise store.InvalidData(f"{what} holds a node above another one")
    if not index.groupBy(*KEY).count().filter("count > 1").isEmpty():
        raise store.AlreadyExists(f"{what} holds a key twice")


def write_store(rows: DataFrame, final: str) -> None:
    """Publish polygons (level, index, id, polygon) as a store. Keys must be leaves; no rows make an empty store."""
    spark, attempt = rows.sparkSession, store.create_attempt(final)
    _save(_nodes(rows), f"{attempt}/nodes/part=0")
    _finish(spark, attempt, final, None)


def _finish(spark: SparkSession, attempt: str, final: str, links: DataFrame | None) -> None:
    own = spark.read.parquet(f"{attempt}/nodes").select(*KEY, "first", "hash", F.lit(None).cast("string").alias("home"))
    _save(own if links is None else own.unionByName(links), f"{attempt}/index")
    _require_leaves(spark.read.parquet(f"{attempt}/index"), final)
    store.publish(spark, attempt, final)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of a store; homes are always named."""
    return spark.read.schema(LINK).parquet(f"{path}/index").withColumn("home", F.coalesce("home", F.lit(qualified(spark, path))))


def subtree(rows: DataFrame, level: int, index: int) -> DataFrame:
    """Rows of a node and all below it: one range of `first`, which reaches the scan."""
    low = index << 3 * (octree.MAX_LEVEL - level)
    return rows.filter(F.col("first").between(low, low + (1 << 3 * (octree.MAX_LEVEL - level)) - 1) & (F.col("level") >= level))


def read_content(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """(level, index, id, polygon) of leaves (level, index, first, hash, home) of an index, from where they are stored. Content
    that lacks its recorded hash is an error, raised by the tasks that meet it, and so is content that is gone.

    Each home is one scan, narrowed to the range of what is wanted from it. Homes are stores, as many as were merged."""
    wanted = stash(wanted.select(*KEY, "first", "hash", "home"), "merge-wanted")
    homes = wanted.groupBy("home").agg(F.min("first").alias("lo"), F.max("first").alias("hi")).collect()  # a row a store
    parts = []
    for h in sorted(homes, key=lambda h: h["home"]):
        n = spark.read.parquet(f"{h['home']}/nodes").filter(F.col("first").between(h["lo"], h["hi"])).select(*KEY, F.col("hash").alias("found"), "content")
        parts.append(wanted.filter(F.col("home") == h["home"]).join(n, list(KEY), "left"))
    if not parts:
        return spark.createDataFrame([], "level bigint, index bigint, id bigint, polygon array<struct<x:double,y:double,z:double>>")
    rows = reduce(DataFrame.unionByName, parts)
    same = F.coalesce((F.col("hash") == F.col("found")) & (F.col("hash") == store.content_hash(F.col("content"))), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("CorruptData: node "), F.col("level").cast("string"), F.lit("/"), F.col("index").cast("string"), F.lit(" does not have its hash")))
    return rows.select(*KEY, F.explode(F.when(same, F.col("content")).otherwise(broken)).alias("c")).select(*KEY, "c.id", "c.polygon")


def compact(spark: SparkSession, path: str, final: str) -> None:
    """Publish a store with the same content that links to no other."""
    write_store(read_content(spark, read_index(spark, path)), final)


def merge_plan(left: DataFrame, right: DataFrame, rings: DataFrame, space: octree.Space) -> DataFrame:
    """(level, index, side, action, found_level, found_index) of what a merge of two indexes takes from each: `link` the leaf
    itself, `clip` what a leaf above the key has in its cell, `cut` what the leaf there or above has in the cell, by the
    mask. A key that both sides are cut at has a row for each."""
    leaves = {"left": left.select(*KEY), "right": right.select(*KEY)}
    acted = stash(masks.masked_merge(leaves["left"], leaves["right"], rings, space).select(*KEY, "action"), "merge-plan")
    out = []
    for side, own in leaves.items():
        taken = acted.filter(F.col("action") == side.capitalize()).select(F.col("level").alias("al"), F.col("index").alias("ai"))
        below = with_ancestors(own.withColumn("at", F.struct(*KEY))).select(F.col("level").alias("al"), F.col("index").alias("ai"), "at").join(taken, ["al", "ai"])
        out.append(below.select("at.level", "at.index", F.lit(side).alias("side"), F.lit("link").alias("action"), F.col("at.level").alias("found_level"), F.col("at.index").alias("found_index")))
        alone = taken.join(below.select("al", "ai").distinct(), ["al", "ai"], "left_anti").select(F.col("al").alias("level"), F.col("ai").alias("index"), F.lit("clip").alias("action"))
        mixed = acted.filter("action = 'Merge'").select(*KEY, F.lit("cut").alias("action"))
        load = alone.union(mixed)
        found = spatial.nearest_ancestor(load.select(*KEY), own).filter("found_level is not null")
        out.append(found.join(load, list(KEY)).select(*KEY, F.lit(side).alias("side"), "action", "found_level", "found_index"))
    return reduce(DataFrame.unionByName, out)


def _dealt(plan: DataFrame, nodes_per_part: int) -> DataFrame:
    """The plan with `part`, null for links: keys to write in preorder, cut into parts of about one size by the quantiles of
    `first`; all rows of a key are in one part."""
    work = plan.filter("action <> 'link'")
    n = work.count()
    k = -(-n // nodes_per_part)
    bounds = work.select(F.percentile_approx("first", [i / k for i in range(1, k)], F.lit(100 * k))).first()[0] if k > 1 else []
    part = reduce(lambda c, b: c + (F.col("first") > b).cast("int"), sorted(set(bounds)), F.lit(0))
    return plan.withColumn("part", F.when(F.col("action") != "link", part))


def _written(spark: SparkSession, work: DataFrame, kinds: set[tuple[str, str]], indexes: dict[str, DataFrame], pieces: DataFrame, space: octree.Space, cell: float) -> DataFrame:
    """Polygons (level, index, id, polygon) of the keys of a part, which has rows of these sides and actions."""
    out = []
    for side, index in indexes.items():
        actions = sorted(a for s, a in kinds if s == side)
        if not actions:
            continue
        own = work.filter(F.col("side") == side).select(*KEY, "action", "found_level", "found_index")
        wanted = index.join(own.select(F.col("found_level").alias("level"), F.col("found_index").alias("index")).distinct(), list(KEY), "left_semi")
        content = read_content(spark, wanted).select(F.col("level").alias("found_level"), F.col("index").alias("found_index"), "id", "polygon")
        for action in actions:
            rows = masks.in_cells(own.filter(F.col("action") == action).join(content, ["found_level", "found_index"]), space)
            if action == "cut":
                rows = stash(rows.withColumn("id", F.struct("level", "index", "id")), "merge-mixed")
                rows = masks.cut(rows, pieces, cell, keep_inside=side == "right").select(*KEY, F.col("id.id").alias("id"), "polygon")
            out.append(rows.select(*KEY, "id", "polygon"))
    return reduce(DataFrame.unionByName, out)


def merge_stores(
    spark: SparkSession, left: str | None, right: str | None, final: str, rings: DataFrame, space: octree.Space, cell: float, *, nodes_per_part: int = 1 << 20,
) -> None:
    """Publish the merge of two stores at `final`: right inside the mask, left outside. Without a right store the mask is cut
    out of the left one, without a left one the right one is cut to the mask.

    Leaves that the mask doesn't cut are linked: their content is neither read nor written. The others are written in parts
    of about `nodes_per_part` nodes, each kept once finished. A later call with the same inputs (content hashes of both
    stores, mask, parameters) goes on with the newest attempt left behind, its plan and its finished parts; an attempt at
    other inputs is never used. Ids of both sides have one type and may repeat across sides. `cell` is as in masks.cut."""
    final = qualified(spark, final)
    if store.exists(spark, final):
        raise store.AlreadyExists(final)
    none = spark.createDataFrame([], LINK)
    indexes = {side: none if path is None else read_index(spark, path) for side, path in (("left", left), ("right", right))}
    for side, index in indexes.items():
        _require_leaves(index, f"the {side} store")
    inputs = indexes["left"].withColumn("side", F.lit("left")).unionByName(indexes["right"].withColumn("side", F.lit("right")))
    mask = store.input_record(rings.select("component", "ring", "is_outer", "seq", "x", "y"))
    record = store.input_record(inputs, mask=str(mask), low=space.low, extent=space.extent, cell=cell, nodes_per_part=nodes_per_part)
    attempt = next((a for a in reversed(store.attempts(spark, final)) if store.matches_record(spark, a, record)), None)
    if attempt is None:
        attempt = store.create_attempt(final)
        store.write_record(spark, attempt, record)
    if not store.exists(spark, f"{attempt}/plan/_SUCCESS"):
        plan = merge_plan(indexes["left"], indexes["right"], rings, space).withColumn("first", first_below(F.col("level"), F.col("index")))
        _save(_dealt(stash(plan, "merge-plan"), nodes_per_part), f"{attempt}/plan")
    plan = spark.read.parquet(f"{attempt}/plan")
    pieces = None
    kinds: dict[int, set[tuple[str, str]]] = {}
    for r in plan.filter("part is not null").select("part", "side", "action").distinct().collect():  # four rows a part at most
        kinds.setdefault(r["part"], set()).add((r["side"], r["action"]))
    for part in sorted(kinds):
        if store.exists(spark, f"{attempt}/nodes/part={part}/_SUCCESS"):
            continue
        if pieces is None:
            pieces = stash(masks.triangulate(merge.normal_rings(rings)), "mask-pieces")
        work = plan.filter(F.col("part") == part)
        _save(_nodes(_written(spark, work, kinds[part], indexes, pieces, space, cell)), f"{attempt}/nodes/part={part}")
    if not store.exists(spark, f"{attempt}/nodes"):
        _save(_nodes(spark.createDataFrame([], "level bigint, index bigint, id bigint, polygon array<struct<x:double,y:double,z:double>>")), f"{attempt}/nodes/part=0")
    links = [index.join(plan.filter((F.col("action") == "link") & (F.col("side") == side)).select(*KEY), list(KEY), "left_semi") for side, index in indexes.items()]
    _finish(spark, attempt, final, links[0].unionByName(links[1]))
