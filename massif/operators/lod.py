"""Levels of detail: blocks of triangles, groups of blocks, coarser meshes, and metadata of the graph of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.functions import octree
from massif.plans.shared import stash

TRIANGLES = 256  # in a cluster
TRIANGLES_OF_FEW_VERTICES = 85  # which never have more than 255 vertices


def centroid(placed: DataFrame) -> list[Column]:
    return [(F.col(f"a{p}") + F.col(f"b{p}") + F.col(f"c{p}")) / 3 for p in "xyz"]


def space_of(placed: DataFrame, least: octree.Space) -> octree.Space:
    """`least`, its side doubled until it holds the centroids of all triangles; they may not lie below its low corner."""
    far = placed.agg(F.max(F.greatest(*centroid(placed)))).first()[0]
    extent = least.extent
    while far is not None and far >= least.low + extent:
        extent *= 2
    return octree.Space(least.low, extent)


def clusterize(placed: DataFrame, space: octree.Space, *, coarse: int = 2, fine: int = 10, size: int = TRIANGLES) -> DataFrame:
    """`placed` triangles with `node` (coarse cell of the centroid) and `cluster`: blocks of `size` in the order of their
    finest cells. A centroid outside of `space` has no node (see space_of()). Blocks are numbered within a node, so no task sorts the whole mesh. Where vertices are numbered in a byte,
    `size` is TRIANGLES_OF_FEW_VERTICES."""
    at = centroid(placed)
    keyed = placed.withColumn("morton", octree.cell_of(space, F.lit(fine), *at)).withColumn("node", octree.up(F.col("morton"), F.lit(fine - coarse)))
    n = F.row_number().over(Window.partitionBy("node").orderBy("morton", "a", "b", "c"))
    return keyed.withColumn("cluster", F.floor((n - 1) / size).cast("long"))


def group_clusters(clusters: DataFrame, size: int = 4) -> DataFrame:
    """Clusters (node, cluster) put into groups of `size` neighbours in their order."""
    n = F.row_number().over(Window.partitionBy("node").orderBy("cluster"))
    return clusters.withColumn("group_id", F.floor((n - 1) / size).cast("long"))


def cluster_bounds(clustered: DataFrame) -> DataFrame:
    lows = [F.min(F.least(*[F.col(f"{k}{p}") for k in "abc"])).alias(f"lo_{p}") for p in "xyz"]
    highs = [F.max(F.greatest(*[F.col(f"{k}{p}") for k in "abc"])).alias(f"hi_{p}") for p in "xyz"]
    return clustered.groupBy("node", "cluster").agg(*lows, *highs, F.count(F.lit(1)).alias("n"))


def group_metadata(bounds: DataFrame, groups: DataFrame, errors: DataFrame) -> DataFrame:
    """Bounds of each group: union of its members'; error: the largest of theirs."""
    m = groups.join(bounds, ["node", "cluster"]).join(errors, ["node", "cluster"])
    return m.groupBy("node", "group_id").agg(*[F.min(f"lo_{p}").alias(f"lo_{p}") for p in "xyz"], *[F.max(f"hi_{p}").alias(f"hi_{p}") for p in "xyz"], F.max("error").alias("error"))


def combine_error(mode: str, old: Column, new: Column) -> Column:
    return {"Overwrite": new, "Add": old + new, "Max": F.greatest(old, new)}[mode]


def concat_metadata(parts: DataFrame) -> DataFrame:
    """(part, group_id) with ids shifted by the groups of the parts before; `parts` is (part, n), a row a part."""
    base = parts.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    return base.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).select("part", (F.col("base") + F.col("k")).alias("group_id"))


def simplify(triangles: DataFrame, vertices: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering: vertices of one cell become its smallest vertex, at their mean; triangles that collapse or
    repeat go. Returns vertices and triangles."""
    keyed = vertices.withColumn("cell", F.array(*[F.floor(F.col(p) / cell).cast("long") for p in "xyz"]))
    merged = keyed.groupBy("cell").agg(F.min("vid").alias("new"), *[F.avg(p).alias(p) for p in "xyz"])
    mapping = keyed.select("vid", "cell").join(merged.select("cell", "new"), "cell").select("vid", "new")
    out = triangles.select("a", "b", "c")
    for k in "abc":
        out = out.join(mapping.select(F.col("vid").alias(k), F.col("new").alias(f"_{k}")), k)
    out = out.select(*[F.col(f"_{k}").alias(k) for k in "abc"]).filter("a <> b and b <> c and a <> c")
    form = F.when((F.col("a") < F.col("b")) & (F.col("a") < F.col("c")), F.array("a", "b", "c")).when(F.col("b") < F.col("c"), F.array("b", "c", "a")).otherwise(F.array("c", "a", "b"))
    out = out.select(form.alias("t")).distinct().select(*[F.col("t")[i].alias(k) for i, k in enumerate("abc")])
    return merged.select(F.col("new").alias("vid"), "x", "y", "z"), out


def pyramid(triangles: DataFrame, vertices: DataFrame, cell: float, levels: int) -> DataFrame:
    """(level, vertices, triangles) counted for a mesh simplified level by level, finest first; every level is stored
    before the next reads it."""
    out = None
    for level in range(levels):
        if level:
            v, t = simplify(triangles, vertices, cell * 2 ** (level - 1))
            vertices, triangles = stash(v, "lod-vertices"), stash(t, "lod-triangles")
        row = triangles.agg(F.count(F.lit(1)).alias("triangles")).select(F.lit(level).cast("long").alias("level"), "triangles")
        out = row if out is None else out.union(row)
    return out


def locked_vertices(clustered: DataFrame) -> DataFrame:
    """Vertices that several clusters share: seams that simplification must not move."""
    v = clustered.select("node", "cluster", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return v.groupBy("vid").agg(F.count(F.lit(1)).alias("clusters")).filter("clusters > 1")


def level_targets(inputs: DataFrame, built: DataFrame, level: int) -> DataFrame:
    """Keys to build on a level: shifted images of its inputs and shifted parents of what was built on the next."""
    shifted = inputs.filter(F.col("level") == level).select(F.explode(octree.standard_to_shifted(F.col("level"), F.col("index"))).alias("index"))
    parents = built.filter(F.col("level") == level + 1).select(F.shiftright("index", 3).alias("index"))
    images = parents.select(F.explode(octree.standard_to_shifted(F.lit(level).cast("long"), F.col("index"))).alias("index"))
    return shifted.union(images).distinct()


def work_plan(targets: DataFrame, inputs: DataFrame, level: int) -> DataFrame:
    """(target, source): the standard input cells that meet each target on its level."""
    meets = targets.select(F.col("index").alias("target"), F.explode(octree.shifted_to_standard(F.lit(level).cast("long"), F.col("index"))).alias("source"))
    return meets.join(inputs.filter(F.col("level") == level).select(F.col("index").alias("source")), "source", "left_semi").select("target", "source")


def child_plan(targets: DataFrame, built: DataFrame, level: int) -> DataFrame:
    """(target, child): what was built on the next level below each target."""
    kids = built.filter(F.col("level") == level + 1).select(F.shiftright("index", 3).alias("target"), F.col("index").alias("child"))
    return kids.join(targets.select(F.col("index").alias("target")), "target", "left_semi")


def texture_sizes(demand: DataFrame, budget: float) -> DataFrame:
    """(node, cluster, w, h) with each node's areas scaled to its budget: sides shrink by the root of the ratio, rounded
    up, one at least."""
    total = F.sum(F.col("w") * F.col("h")).over(Window.partitionBy("node"))
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(budget) / total))
    return demand.withColumn("_s", scale).select("node", "cluster", *[F.greatest(F.ceil(F.col(k) * F.col("_s")), F.lit(1)).cast("long").alias(k) for k in "wh"])
