"""Levels of detail, built: a table of nodes with their clusters, bounds, errors and groups for every level, from the finest
to the coarsest; and the tables that serve it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree
from massif.operators import lod, mesh
from massif.operators.index import with_ancestors
from massif.plans.control import StopSignal
from massif.plans.shared import stash
from massif.sources import files, store

SCHEMA = "nodes/1"


def corner(k: str) -> Column:
    return g.point(*[F.col(f"{k}{p}") for p in "xyz"])


def clustered(triangles: DataFrame, size: int) -> DataFrame:
    """`triangles` (index, ax..cz, ...) with `cluster`: blocks of `size` along the Morton order of centroids within the
    node, whose bounds scale it. A node has a few thousand triangles."""
    mid = [(F.col(f"a{p}") + F.col(f"b{p}") + F.col(f"c{p}")) / 3 for p in "xyz"]
    t = triangles.withColumns({f"_m{p}": m for p, m in zip("xyz", mid, strict=True)})
    w = Window.partitionBy("index")
    steps = [F.least(F.floor((F.col(f"_m{p}") - F.min(f"_m{p}").over(w)) / F.greatest(F.max(f"_m{p}").over(w) - F.min(f"_m{p}").over(w), F.lit(1e-12)) * 1024), F.lit(1023)).cast("long") for p in "xyz"]
    t = t.withColumn("_k", octree.encode(*steps))
    n = F.row_number().over(w.orderBy("_k", *[f"{k}{p}" for k in "abc" for p in "xyz"]))
    return t.withColumn("cluster", F.floor((n - 1) / size).cast("long")).drop("_k", *[f"_m{p}" for p in "xyz"])


def cluster_table(triangles: DataFrame, group: int) -> DataFrame:
    """(index, cluster, group_id, n, lo_x..hi_z, cx, cy, cz, error): a row a cluster; its error is the largest of its
    triangles', its centroid the mean of its corners; groups are of clusters that follow one another."""
    lo = [F.min(F.least(*[F.col(f"{k}{p}") for k in "abc"])).alias(f"lo_{p}") for p in "xyz"]
    hi = [F.max(F.greatest(*[F.col(f"{k}{p}") for k in "abc"])).alias(f"hi_{p}") for p in "xyz"]
    mid = [F.avg((F.col(f"a{p}") + F.col(f"b{p}") + F.col(f"c{p}")) / 3).alias(f"c{p}") for p in "xyz"]
    c = triangles.groupBy("index", "cluster").agg(F.count(F.lit(1)).alias("n"), *lo, *hi, *mid, F.max("error").alias("error"))
    return c.withColumn("group_id", F.floor(F.col("cluster") / group).cast("long"))


def coarsened(triangles: DataFrame, cell: float, mode: str) -> DataFrame:
    """Triangles of half the detail: corners move to the mean of those in their cell of side `cell`, except locked ones, so
    equal corners of neighbouring nodes stay equal; those that collapse or repeat in a node go. The error of a triangle is
    combined with how far a corner may have moved. A corner is locked where triangles of nodes of another parent meet it."""
    def snap(p: Column) -> Column:
        return F.array(*[F.floor(p[a] / cell).cast("long") for a in "xyz"])

    t = triangles.withColumn("t", F.monotonically_increasing_id()) if "t" not in triangles.columns else triangles
    t = stash(t, "lod-triangles")
    used = t.select("index", F.explode(F.array(*[corner(k) for k in "abc"])).alias("p")).distinct()
    lock = used.groupBy("p").agg(F.countDistinct(F.shiftright("index", 3)).alias("k")).filter("k > 1").select("p", F.lit(True).alias("locked"))
    points = used.select("p").distinct().join(lock, "p", "left").withColumn("cell", snap(F.col("p")))
    mean = points.filter("locked is null").groupBy("cell").agg(*[F.avg(f"p.{a}").alias(a) for a in "xyz"]).select("cell", F.struct("x", "y", "z").alias("to"))
    moved = stash(points.join(mean, "cell", "left").select("p", F.when(F.col("locked"), F.col("p")).otherwise(F.col("to")).alias("to")), "lod-moves")
    out = t.select("index", "t", "error", *[corner(k).alias(k) for k in "abc"])
    for k in "abc":
        out = out.join(moved.select(F.col("p").alias(k), F.col("to").alias(f"_{k}")), k)
    out = out.select(F.shiftright("index", 3).alias("index"), "error", *[F.col(f"_{k}").alias(k) for k in "abc"]).filter("a <> b and b <> c and a <> c")
    form = mesh.oriented(F.col("a"), F.col("b"), F.col("c"))
    out = out.groupBy("index", form.alias("f")).agg(F.max("error").alias("error"))
    step = F.lit(cell * 3**0.5)
    return out.select("index", lod.combine_error(mode, F.col("error"), step).alias("error"), *[F.col("f")[i][p].alias(f"{k}{p}") for i, k in enumerate("abc") for p in "xyz"])


def build_levels(inputs: DataFrame, space: octree.Space, finest: int, coarsest: int, *, size: int = 256, group: int = 4, cells: float = 64.0, mode: str = "Add", path: str | None = None, stop: StopSignal | None = None) -> DataFrame:
    """(level, index, cluster, group_id, n, lo_x..hi_z, cx..cz, error) of a tree of nodes over `inputs` (level, index,
    ax..cz): leaves on the finest level are their own triangles, each coarser node is made of its children's, simplified
    to `cells` steps along a node, with leaves that are stored on its level.

    A level is stored before the next is made. With `path`, levels are kept there with a record of the inputs and of how
    they are built; levels that are whole aren't made again if the record is the same, else all there are made anew. A
    request to stop is heeded between levels."""
    spark = inputs.sparkSession
    below, out = None, None
    if path:
        record = store.input_record(inputs.select("level", "index", *[f"{k}{p}" for k in "abc" for p in "xyz"]), space=space, finest=finest, size=size, cells=cells, mode=mode)
        if not store.matches_record(spark, path, record):
            store.delete(spark, path)
            store.write_record(spark, path, record)
    for level in range(finest, coarsest - 1, -1):
        if stop:
            stop.check()
        own = inputs.filter(F.col("level") == level).select("index", F.lit(0.0).alias("error"), *[f"{k}{p}" for k in "abc" for p in "xyz"])
        at = f"{path}/level={level}" if path else None
        if at and store.exists(spark, f"{at}/triangles/_SUCCESS"):
            triangles = spark.read.parquet(f"{at}/triangles")
        else:
            made = own if below is None else own.unionByName(coarsened(below, space.extent / 2**level / cells, mode))
            made = clustered(made, size)
            if at:
                store.delete(spark, f"{at}/triangles")
                made.write.option("compression", "zstd").parquet(f"{at}/triangles")
                triangles = spark.read.parquet(f"{at}/triangles")
            else:
                triangles = stash(made, "lod-level")
        rows = cluster_table(triangles, group).select(F.lit(level).cast("long").alias("level"), "*")
        out = rows if out is None else out.unionByName(rows)
        below = triangles.drop("cluster")
    return out


def relevant_inputs(targets: DataFrame, inputs: DataFrame, space: octree.Space, level: int, *, coarser: bool) -> DataFrame:
    """(target, level, index): the input leaves that a target (index, on a level of the shifted grid) is built from: those
    on its level that meet it, or (coarser) those on its level and above whose cells meet its bounds, faces included.
    Leaves above are few a target, so they are found by the ancestors of the standard cells it meets."""
    at = F.lit(level).cast("long")
    if not coarser:
        return lod.work_plan(targets, inputs, level).select("target", at.alias("level"), F.col("source").alias("index"))
    size = octree.cell_size(space, at)
    b = octree.shifted_bounds(space, at, F.col("index"))
    top = F.lit(space.low + space.extent)
    low = [F.greatest(octree.coordinate(space, at, b[k] - size * 1e-9), F.lit(0)) for k in range(3)]
    high = [octree.coordinate(space, at, F.least(b[k + 3], top - size * 1e-9)) for k in range(3)]
    cells = targets.select(F.col("index").alias("target"), F.explode(octree._spans(at, list(zip(low, high, strict=True)))).alias("index")).withColumn("level", at)
    up = with_ancestors(cells).select("target", "level", "index").distinct()
    return up.join(inputs.select("level", "index").distinct(), ["level", "index"], "left_semi").select("target", "level", "index")


def gather_leaves(index: DataFrame, space: octree.Space, low: tuple, high: tuple, finest: int) -> DataFrame:
    """Leaves of an index, on the finest level or above, whose cells meet a box, faces included."""
    b = octree.cell_bounds(space, F.col("level"), F.col("index"))
    meets = F.lit(True)
    for k in range(3):
        meets = meets & (b[k] <= high[k]) & (b[k + 3] >= low[k])
    return index.filter((F.col("status") == "Leaf") & (F.col("level") <= finest)).filter(meets)


def lock_at_border(clusters: DataFrame, triangles: DataFrame, space: octree.Space, level: int, margin: float) -> DataFrame:
    """(index, p): corners that simplification must not move: those that several clusters of a node share, and corners on
    the rim of the node's mesh within a share of the cell's size of its faces. Corners are known by their position."""
    corners = triangles.select("index", "cluster", F.explode(F.array(*[corner(k) for k in "abc"])).alias("p")).distinct()
    shared = corners.groupBy("index", "p").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("index", "p")
    sides = F.explode(F.array(*[F.struct(F.least(corner(p), corner(q)).alias("p"), F.greatest(corner(p), corner(q)).alias("q")) for p, q in ("ab", "bc", "ca")])).alias("e")
    rim = triangles.select("index", sides).groupBy("index", "e").agg(F.count(F.lit(1)).alias("k")).filter("k = 1").select("index", F.explode(F.array("e.p", "e.q")).alias("p")).distinct()
    b = octree.cell_bounds(space, F.lit(level).cast("long"), F.col("index"))
    by = space.extent / 2**level * margin
    near = F.lit(False)
    for k, a in enumerate("xyz"):
        near = near | (F.col(f"p.{a}") <= b[k] + by) | (F.col(f"p.{a}") >= b[k + 3] - by)
    return shared.union(rim.filter(near)).distinct()


def find_clusters(clusters: DataFrame, test: Column) -> DataFrame:
    """Clusters whose centroid (cx, cy, cz) passes a test, such as inside_bounds()."""
    return clusters.filter(test)


def inside_bounds(low: tuple, high: tuple) -> Column:
    c = F.lit(True)
    for k, a in enumerate("xyz"):
        c = c & (F.col(f"c{a}") >= low[k]) & (F.col(f"c{a}") < high[k])
    return c


def merged_groups(triangles: DataFrame, group: int) -> DataFrame:
    """(index, group_id, vid, x, y, z, a, b, c by kind): the clusters of each group as one mesh: corners of equal position
    are one vertex, numbered within the group in the order of their positions; `kind` is vertex or triangle."""
    t = triangles.withColumn("group_id", F.floor(F.col("cluster") / group).cast("long"))
    w = Window.partitionBy("index", "group_id").orderBy("p")
    v = t.select("index", "group_id", F.explode(F.array(*[corner(k) for k in "abc"])).alias("p")).distinct().withColumn("vid", (F.row_number().over(w) - 1).cast("long"))
    out = t.select("index", "group_id", *[corner(k).alias(k) for k in "abc"])
    for k in "abc":
        out = out.join(v.select("index", "group_id", F.col("p").alias(k), F.col("vid").alias(f"_{k}")), ["index", "group_id", k])
    none = F.lit(None)
    rows = v.select("index", "group_id", F.lit("vertex").alias("kind"), "vid", "p.x", "p.y", "p.z", *[none.cast("long").alias(k) for k in "abc"])
    faces = out.select("index", "group_id", F.lit("triangle").alias("kind"), none.cast("long").alias("vid"), *[none.cast("double").alias(p) for p in "xyz"], *[F.col(f"_{k}").alias(k) for k in "abc"])
    return rows.unionByName(faces)


def texel_demand(clusters: DataFrame, density: Column, most: int) -> DataFrame:
    """`clusters` (area, uv_area, texture_w, texture_h, ...) with utilisation, source_density (texels a unit of area) and
    texels, what a texture of the wanted density needs, at most its source's: sides are powers of nothing, rounded up."""
    used = F.least(F.col("uv_area"), F.lit(1.0))
    source = F.when(F.col("area") > 0, used * F.col("texture_w") * F.col("texture_h") / F.col("area")).otherwise(0.0)
    wanted = F.least(source, density) * F.col("area")
    return clusters.withColumns({"utilisation": used, "source_density": source}).withColumn("texels", F.least(F.ceil(wanted), F.lit(most)).cast("long"))


def correspond(output: DataFrame, source: DataFrame, cell: float) -> DataFrame:
    """(out_id, source_id): source triangles (id, ax..cz) that an output triangle's texture comes from: their projections
    onto the output's plane overlap, their normals agree, and they lie within a quarter of its longest side of that plane.
    Both are dealt into cubes of side `cell`, so only neighbours are compared."""
    def boxed(d: DataFrame, name: str, slack: Column) -> DataFrame:
        t = d.select(F.col("id").alias(f"{name}_id"), F.array(*[corner(k) for k in "abc"]).alias(name), slack.alias(f"{name}_slack"))
        for a in "xyz":
            at = F.transform(name, _of(a))
            lo, hi = F.array_min(at) - F.col(f"{name}_slack"), F.array_max(at) + F.col(f"{name}_slack")
            t = t.withColumn(f"c{a}", F.explode(F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))))
        return t

    sides = [g.sub(corner(p), corner(q)) for p, q in ("ab", "bc", "ca")]
    longest = F.sqrt(F.greatest(*[g.dot(s, s) for s in sides]))
    met = boxed(output, "out", longest / 4).join(boxed(source, "source", F.lit(0.0)), ["cx", "cy", "cz"])
    met = met.select("out_id", "source_id", "out", "source", "out_slack").dropDuplicates(["out_id", "source_id"])
    # Stored, as the optimiser would otherwise write the frame into every place that a projected corner is used.
    met = stash(met.withColumn("frame", g.plane_frame(F.col("out")[0], F.col("out")[1], F.col("out")[2])), "near-triangles")
    flat = stash(met.withColumns({f"_{n}": F.transform(n, _projected) for n in ("out", "source")}), "flat-triangles")
    normal = g.cross(g.sub(F.col("source")[1], F.col("source")[0]), g.sub(F.col("source")[2], F.col("source")[0]))
    over = g.triangles_overlap([F.col("_out")[i] for i in range(3)], [F.col("_source")[i] for i in range(3)])
    near = F.array_min(F.transform("_source", lambda p: F.abs(p["z"]))) <= F.col("out_slack")
    return flat.filter((g.dot(normal, F.col("frame.n")) > 0) & near & over).select("out_id", "source_id")


def _of(a: str):
    return lambda p: p[a]


def _projected(p: Column) -> Column:
    return g.project(F.col("frame"), p)


def fragments(pairs: DataFrame) -> DataFrame:
    """(out_id, source_id, area, share): what each pair of output and source triangles (out and source: their corners in the
    plane, counter-clockwise) has in common, and its share of the output triangle."""
    cut = g.clip_by(F.col("source"), g.edge_planes([F.col("out")[i] for i in range(3)]))
    area = F.abs(g.polygon_area_2d(F.col("cut")))
    whole = F.abs(g.polygon_area_2d(F.col("out")))
    return pairs.withColumn("cut", cut).filter(F.size("cut") >= 3).select("out_id", "source_id", area.alias("area"), F.when(whole > 0, area / whole).alias("share"))


def trimmed(uvs: DataFrame, width: int, height: int, margin: int) -> DataFrame:
    """(id, x, y, w, h, scale_u, scale_v, move_u, move_v): the pixels of a texture that the uvs (id, u, v) of each mesh need,
    widened by a margin and cut to the texture, and how uvs are moved to the cut-out: u' = u * scale_u + move_u."""
    b = uvs.groupBy("id").agg(*[f(c).alias(f"{n}_{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))])
    out = b.select("id", *[
        e for c, side, at, size in (("u", width, "x", "w"), ("v", height, "y", "h"))
        for e in (F.greatest(F.floor(F.col(f"lo_{c}") * side) - margin, F.lit(0)).cast("long").alias(at), F.least(F.ceil(F.col(f"hi_{c}") * side) + margin, F.lit(side)).cast("long").alias(size))
    ])
    out = out.withColumns({"w": F.greatest(F.col("w") - F.col("x"), F.lit(1)), "h": F.greatest(F.col("h") - F.col("y"), F.lit(1))})
    return out.withColumns({"scale_u": width / F.col("w"), "scale_v": height / F.col("h"), "move_u": -F.col("x") / F.col("w"), "move_v": -F.col("y") / F.col("h")})


def write_nodes(clusters: DataFrame, triangles: DataFrame, path: str) -> None:
    """Store nodes as two tables: clusters (level, index, cluster, ...), which are read alone for a view, and triangles
    (level, index, cluster, ax..cz). Both are in the order of keys; the header names their schema."""
    spark = clusters.sparkSession
    for name, rows in (("clusters", clusters), ("triangles", triangles)):
        rows.repartitionByRange("level", "index").sortWithinPartitions("level", "index", "cluster").write.mode("error").parquet(f"{path}/{name}")
    spark.createDataFrame([(SCHEMA,)], "value string").coalesce(1).write.mode("error").text(f"{path}/header")


def require_header(spark: SparkSession, path: str) -> None:
    if not store.exists(spark, f"{path}/header") or spark.read.text(f"{path}/header").first()[0] != SCHEMA:
        raise store.InvalidData(f"{path} holds no {SCHEMA}")


def read_clusters(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The cluster table, of all nodes or of some; no triangle is read."""
    require_header(spark, path)
    rows = spark.read.parquet(f"{path}/clusters")
    return rows if keys is None else rows.join(keys.select("level", "index"), ["level", "index"], "left_semi")


def export_nodes(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(name, file): every node of a store as a mesh file named by its key, for looking at; virtual nodes hold nothing and
    have none."""
    require_header(spark, path)
    t = spark.read.parquet(f"{path}/triangles").withColumn("cluster", F.lit(0).cast("long"))
    m = merged_groups(t.withColumnRenamed("index", "key").withColumn("index", F.struct("level", "key")), 1)
    m = m.withColumn("name", F.concat_ws("-", F.col("index.level").cast("string"), F.col("index.key").cast("string")))
    return files.write_meshes(m.filter("kind = 'vertex'").select("name", "vid", "x", "y", "z"), m.filter("kind = 'triangle'").select("name", "a", "b", "c"), folder)


def read_node(spark: SparkSession, path: str, level: int, index: int) -> DataFrame:
    """The triangles of a node with their clusters' columns; the key's comparisons reach both scans."""
    require_header(spark, path)
    here = (F.col("level") == level) & (F.col("index") == index)
    c = spark.read.parquet(f"{path}/clusters").filter(here)
    return spark.read.parquet(f"{path}/triangles").filter(here).join(c, ["level", "index", "cluster"])
