"""Hierarchy indexes: the status of every key of a tree, kept as tables (level, index, status).

A stored key is a Leaf, or Inner if a descendant is stored too; a proper ancestor that isn't stored is Virtual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions import octree
from massif.plans.shared import stash


def with_ancestors(keys: DataFrame, level: str = "level", index: str = "index") -> DataFrame:
    """Each key and all its ancestors, with `steps` up to them."""
    k = F.explode(F.sequence(F.lit(0), F.col(level).cast("int"))).alias("steps")
    rows = keys.select("*", k)
    return rows.withColumn(index, octree.up(F.col(index), F.col("steps"))).withColumn(level, F.col(level) - F.col("steps"))


def closure(physical: DataFrame) -> DataFrame:
    """The index of a set of stored keys. One aggregation, combined before its shuffle."""
    rows = with_ancestors(physical.select("level", "index"))
    found = rows.groupBy("level", "index").agg(F.max(F.col("steps") == 0).alias("own"), F.max(F.col("steps") > 0).alias("below"))
    status = F.when(F.col("own") & F.col("below"), "Inner").when(F.col("own"), "Leaf").otherwise("Virtual")
    return found.select("level", "index", status.alias("status"))


def stored(index: DataFrame) -> DataFrame:
    return index.filter(F.col("status") != "Virtual").select("level", "index")


def add(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The index with more keys stored."""
    return closure(stored(index).union(keys.select("level", "index")).distinct())


def remove(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The index with keys no longer stored; ancestors that hold nothing any more go."""
    return closure(stored(index).join(keys.select("level", "index"), ["level", "index"], "left_anti"))


def violations(index: DataFrame) -> DataFrame:
    """(level, index, rule) of what is wrong: a child below a Leaf, an Inner or Virtual without child, a parent absent."""
    child = index.filter("level > 0").select((F.col("level") - 1).alias("level"), F.shiftright("index", 3).alias("index")).distinct().withColumn("has", F.lit(True))
    joined = index.join(child, ["level", "index"], "full_outer")
    rule = F.when(F.col("status").isNull(), "missing parent").when((F.col("status") == "Leaf") & F.col("has"), "leaf with child").when((F.col("status") != "Leaf") & F.col("has").isNull(), "no child")
    return joined.select("level", "index", rule.alias("rule")).filter("rule is not null")


def inner_nodes(index: DataFrame) -> DataFrame:
    """Datasets of leaves may hold no Inner node."""
    return index.filter(F.col("status") == "Inner")


def unhashed(index: DataFrame, hashes: DataFrame) -> DataFrame:
    """(level, index, rule): stored nodes without a hash, and hashes without a stored node."""
    nodes = stored(index)
    a = nodes.join(hashes, ["level", "index"], "left_anti").withColumn("rule", F.lit("no hash"))
    return a.union(hashes.select("level", "index").join(nodes, ["level", "index"], "left_anti").withColumn("rule", F.lit("no node")))


def breadth_first() -> list[Column]:
    return [F.col("level"), F.col("index")]


def depth_first() -> list[Column]:
    """Preorder: by the index of the first cell below on the deepest level, then from the root down."""
    return [octree.down(F.col("index"), octree.MAX_LEVEL - F.col("level")), F.col("level")]


def traverse(index: DataFrame, refine: Column) -> DataFrame:
    """The nodes a traversal visits that goes below a node only where `refine` holds: those without a proper ancestor
    that fails. One anti join instead of a loop over levels."""
    closed = index.filter(~refine).select(F.col("level").alias("l"), F.col("index").alias("i"))
    above = with_ancestors(index.withColumn("at", F.struct("level", "index"))).filter("steps > 0")
    blocked = above.join(closed, (F.col("level") == F.col("l")) & (F.col("index") == F.col("i")), "left_semi").select("at.level", "at.index").distinct()
    return index.join(blocked, ["level", "index"], "left_anti")


def children_of(index: DataFrame, level: int, key: int) -> DataFrame:
    return index.filter((F.col("level") == level + 1) & (F.shiftright("index", 3) == key))


def deepest_root(index: DataFrame) -> DataFrame:
    """The first node from the root down that has more than one child, or else the last of the chain."""
    n = index.filter("level > 0").groupBy((F.col("level") - 1).alias("level"), F.shiftright("index", 3).alias("index")).agg(F.count(F.lit(1)).alias("n"))
    counted = index.join(n, ["level", "index"], "left").select("level", "index", F.coalesce("n", F.lit(0)).alias("n_children"))
    return counted.filter("n_children <> 1").orderBy("level", "index").limit(1)


def refine_by_distance(index: DataFrame, space: octree.Space, eye: tuple[float, float, float], ratio: float) -> DataFrame:
    """The nodes to show from a point: a node is split while its distance over its diagonal is at most `ratio` and it has
    children; nodes that aren't split, below none that isn't, are shown."""
    bounds = octree.cell_bounds(space, F.col("level"), F.col("index"))
    d = F.lit(0.0)
    for k in range(3):
        d = d + F.pow((bounds[k] + bounds[k + 3]) / 2 - eye[k], 2)
    diagonal = octree.cell_size(space, F.col("level")) * 3**0.5
    split = (F.sqrt(d) / diagonal <= ratio) & (F.col("status") != "Leaf")
    return traverse(index, split).filter(~split)


def crawl(roots: DataFrame, present: DataFrame, deepest: int) -> DataFrame:
    """(zoom, x, y, status) of a crawl of tiles from roots down: present tiles are fetched and their children tried,
    absent ones end a branch. Level by level, each stored before the next."""
    frontier, done = roots.select("zoom", "x", "y"), []
    for _ in range(deepest + 1):
        tried = frontier.join(present.select("zoom", "x", "y").distinct().withColumn("here", F.lit(True)), ["zoom", "x", "y"], "left")
        tried = stash(tried.select("zoom", "x", "y", F.when(F.col("here"), "Fetched").otherwise("Absent").alias("status")), "crawl")
        done.append(tried)
        kids = F.explode(F.array(*[F.struct((2 * F.col("x") + i).alias("x"), (2 * F.col("y") + j).alias("y")) for i in (0, 1) for j in (0, 1)])).alias("k")
        frontier = tried.filter("status = 'Fetched'").select((F.col("zoom") + 1).alias("zoom"), kids).select("zoom", "k.x", "k.y").filter(F.col("zoom") <= deepest)
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def number_children(index: DataFrame) -> DataFrame:
    w = Window.partitionBy("level", F.shiftright("index", 3)).orderBy("index")
    return index.withColumn("nth", F.row_number().over(w) - 1)
