"""Mesh analytics on tables: triangles (a, b, c) of vertex ids, vertices (vid, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massif.operators.components import connected_components


def meshify(pixels: DataFrame, width: int, valid: str = "valid") -> DataFrame:
    """Triangles over a height grid (px, py, valid): a quad with four valid corners gives two, with three gives one.

    Every pixel is sent to the four quads it is a corner of and the quads are put together by one aggregation."""
    corners = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])).alias("o")
    sent = pixels.filter(valid).select("px", "py", corners).select((F.col("px") - F.col("o.dx")).alias("x"), (F.col("py") - F.col("o.dy")).alias("y"), F.col("o.k").alias("k"))
    quads = sent.groupBy("x", "y").agg(*[F.max(F.col("k") == i).alias(f"c{i}") for i in range(4)])
    base = F.col("y") * width + F.col("x")
    at = [base, base + 1, base + width + 1, base + width]

    def tri(i: int) -> Column:
        return F.struct(*[at[(i + j) % 4].cast("long").alias(n) for j, n in enumerate("abc")])

    def has(*k: int) -> Column:
        c = F.lit(True)
        for i in k:
            c = c & F.col(f"c{i}")
        return c

    none = F.array().cast("array<struct<a:bigint,b:bigint,c:bigint>>")
    out = F.when(has(0, 1, 2, 3), F.array(tri(0), tri(2))).when(has(0, 1, 2), F.array(tri(0))).when(has(1, 2, 3), F.array(tri(1))).when(has(2, 3, 0), F.array(tri(2))).when(has(3, 0, 1), F.array(tri(3))).otherwise(none)
    inner = quads.filter((F.col("x") >= 0) & (F.col("x") < width - 1) & (F.col("y") >= 0))
    return inner.select("x", "y", F.explode(out).alias("t")).select("x", "y", "t.a", "t.b", "t.c")


def half_edges(triangles: DataFrame) -> DataFrame:
    """(u, v, a, b, c): the three directed edges of each triangle."""
    e = F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")
    return triangles.select("a", "b", "c", e).select("e.u", "e.v", "a", "b", "c")


def edges(triangles: DataFrame) -> DataFrame:
    """(u, v, n): undirected edges, u < v, and how many triangles they have."""
    return half_edges(triangles).groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("n"))


def boundary_edges(triangles: DataFrame) -> DataFrame:
    """Directed edges whose reverse is absent."""
    he = half_edges(triangles).select("u", "v")
    return he.join(he.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"], "left_anti")


def boundary_vertices(triangles: DataFrame) -> DataFrame:
    return boundary_edges(triangles).select(F.explode(F.array("u", "v")).alias("vid")).distinct()


def boundary_triangles(triangles: DataFrame) -> DataFrame:
    b = boundary_edges(triangles)
    return half_edges(triangles).join(b, ["u", "v"], "left_semi").select("a", "b", "c").distinct()


def non_manifold_edges(triangles: DataFrame) -> DataFrame:
    return edges(triangles).filter("n > 2")


def inconsistent_edges(triangles: DataFrame) -> DataFrame:
    """Directed edges that two triangles share: none in a consistently oriented mesh."""
    return half_edges(triangles).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def corner(vid: Column, other: Column) -> Column:
    """A vertex as seen from another, for graphs around each vertex."""
    return F.struct(vid.alias("vid"), other.alias("other"))


def fans(triangles: DataFrame) -> DataFrame:
    """(vid, fans): how many edge-connected fans the triangles at each vertex make; more than one is not manifold.
    They are the components of the edges opposite to the vertex."""
    he = half_edges(triangles)
    opposite = he.select(F.when(F.col("u") == F.col("a"), F.col("c")).when(F.col("u") == F.col("b"), F.col("a")).otherwise(F.col("b")).alias("vid"), "u", "v")
    found = connected_components(opposite.select(corner(F.col("vid"), F.col("u")).alias("u"), corner(F.col("vid"), F.col("v")).alias("v")))
    return found.groupBy("node.vid").agg(F.countDistinct("component").alias("fans"))


def degrees(triangles: DataFrame) -> DataFrame:
    """(vid, n): triangles at each vertex."""
    return triangles.select(F.explode(F.array("a", "b", "c")).alias("vid")).groupBy("vid").agg(F.count(F.lit(1)).alias("n"))


def adjacency(triangles: DataFrame) -> DataFrame:
    """(vid, near): the sorted neighbours of each vertex."""
    e = edges(triangles)
    return e.select("u", "v").union(e.select("v", "u")).groupBy(F.col("u").alias("vid")).agg(F.sort_array(F.collect_set("v")).alias("near"))


def isolated(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    return vertices.join(degrees(triangles).select("vid"), "vid", "left_anti")


def components(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(vid, component): labels are dense, in the order of each component's smallest vertex; an isolated vertex is one."""
    found = connected_components(edges(triangles)).select(F.col("node").alias("vid"), "component")
    every = vertices.select("vid").join(found, "vid", "left").select("vid", F.coalesce("component", "vid").alias("root"))
    roots = every.filter("vid = root").select("root")
    n = F.row_number().over(Window.orderBy("root")) - 1  # one row a component
    return every.join(roots.withColumn("component", n.cast("long")), "root").select("vid", "component")


def topology(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertices, edges, faces and Euler characteristic of the whole mesh, as one row."""
    v = vertices.agg(F.count(F.lit(1)).alias("v"))
    e = edges(triangles).agg(F.count(F.lit(1)).alias("e"))
    f = triangles.agg(F.count(F.lit(1)).alias("f"))
    counts = v.select(F.col("v"), F.lit(0).alias("e"), F.lit(0).alias("f")).union(e.select(F.lit(0), "e", F.lit(0))).union(f.select(F.lit(0), F.lit(0), "f"))
    return counts.agg(*[F.sum(c).alias(c) for c in "vef"]).withColumn("chi", F.col("v") - F.col("e") + F.col("f"))


def oriented(a: Column, b: Column, c: Column) -> Column:
    """The triangle turned so that its smallest vertex comes first."""
    least = F.least(a, b, c)
    return F.when(a == least, F.array(a, b, c)).when(b == least, F.array(b, c, a)).otherwise(F.array(c, a, b))


def unoriented(a: Column, b: Column, c: Column) -> Column:
    return F.sort_array(F.array(a, b, c))


def compare(t: list[Column], s: list[Column], *, orientation: bool = True) -> Column:
    """-1, 0 or 1 by the order of two triangles in canonical form; with orientation, mirrored ones differ."""
    form = oriented if orientation else unoriented
    a, b = form(*t), form(*s)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _spread(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key)[0].alias("a"), F.col(key)[1].alias("b"), F.col(key)[2].alias("c"), *[c for c in df.columns if c != key])


def duplicates(triangles: DataFrame, *, orientation: bool = True) -> DataFrame:
    """(a, b, c, n) of triangles that occur more than once, in canonical order."""
    form = (oriented if orientation else unoriented)(F.col("a"), F.col("b"), F.col("c"))
    return _spread(triangles.groupBy(form.alias("t")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "t")


def deduplicated(triangles: DataFrame, *, orientation: bool = True) -> DataFrame:
    form = (oriented if orientation else unoriented)(F.col("a"), F.col("b"), F.col("c"))
    return _spread(triangles.select(form.alias("t")).distinct(), "t")


def not_degenerate(triangles: DataFrame) -> DataFrame:
    return triangles.filter((F.col("a") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("a") != F.col("c")))


def placed(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with the positions of their corners (ax..cz)."""
    out = triangles
    for k in "abc":
        out = out.join(vertices.select(F.col("vid").alias(k), *[F.col(p).alias(f"{k}{p}") for p in "xyz"]), k)
    return out


def normal() -> list[Column]:
    u = [F.col(f"b{p}") - F.col(f"a{p}") for p in "xyz"]
    v = [F.col(f"c{p}") - F.col(f"a{p}") for p in "xyz"]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def area() -> Column:
    """Area of a placed triangle."""
    n = normal()
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2


def signed_area_2d() -> Column:
    return ((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay"))) / 2


def negligible(placed_triangles: DataFrame, share: float) -> DataFrame:
    """Triangles whose area is under a share of the mean; the mean is one number, joined as a scalar subquery would be."""
    mean = placed_triangles.agg(F.avg(area())).first()[0]
    return placed_triangles.filter(area() < F.lit(mean) * share) if mean is not None else placed_triangles.limit(0)


def edge_lengths(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(u, v, length)."""
    e = edges(triangles).select("u", "v")
    for k in "uv":
        e = e.join(vertices.select(F.col("vid").alias(k), *[F.col(p).alias(f"{k}{p}") for p in "xyz"]), k)
    d = sum(((F.col(f"u{p}") - F.col(f"v{p}")) * (F.col(f"u{p}") - F.col(f"v{p}")) for p in "xyz"), F.lit(0.0))
    return e.select("u", "v", F.sqrt(d).alias("length"))


def reindex(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(vid, new): dense ids of used vertices in the order of their old ids. Ranks are made per block of ids and set one
    after another, so no task ranks all."""
    used = degrees(triangles).select("vid")
    block = F.floor(F.col("vid") / 4096)
    within = used.select("vid", block.alias("blk")).withColumn("r", F.row_number().over(Window.partitionBy("blk").orderBy("vid")))
    sizes = within.groupBy("blk").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("blk", (F.sum("n").over(Window.orderBy("blk")) - F.col("n")).alias("base"))  # one row a block
    return within.join(before, "blk").select("vid", (F.col("base") + F.col("r") - 1).alias("new"))


def concatenate(meshes: DataFrame, vertex_counts: DataFrame) -> DataFrame:
    """Triangles (mesh, a, b, c) of several meshes with ids shifted by the vertices of the meshes before."""
    base = vertex_counts.select("mesh", (F.sum("n").over(Window.orderBy("mesh")) - F.col("n")).alias("base"))  # one row a mesh
    return meshes.join(base, "mesh").select("mesh", *[(F.col(k) + F.col("base")).alias(k) for k in "abc"])


def remap(triangles: DataFrame, mapping: DataFrame, old: str = "vid", new: str = "new") -> DataFrame:
    """Triangles with mapped ids; those that collapse go."""
    out = triangles.select("a", "b", "c")
    for k in "abc":
        out = out.join(mapping.select(F.col(old).alias(k), F.col(new).alias(f"_{k}")), k)
    return not_degenerate(out.select(*[F.col(f"_{k}").alias(k) for k in "abc"]))


def edge_triangles(triangles: DataFrame) -> DataFrame:
    """(u, v, triangles): each undirected edge with the sorted triangles (tid) at it; more than two where it isn't
    manifold. `triangles` is (tid, a, b, c)."""
    e = F.explode(F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])).alias("e")
    return triangles.select("tid", e).groupBy("e.u", "e.v").agg(F.sort_array(F.collect_set("tid")).alias("triangles"))


def soup(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(p, n): the triangles as arrays of positions, turned so that the least corner comes first, with how often each
    occurs: equal for meshes that differ in numbering and order alone."""
    t = placed(triangles, vertices)
    corner = [F.struct(*[F.col(f"{k}{p}").alias(p) for p in "xyz"]) for k in "abc"]
    return t.groupBy(oriented(*corner).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def same_shape(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Rows of the soups of two meshes (triangles, vertices) that the other lacks: none if the meshes are equal."""
    a, b = soup(*left), soup(*right)
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def deduplicated_by_normal(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """(a, b, c): of the triangles on the same three vertices the one whose normal agrees best with the mean normal of all
    triangles at these vertices; of equals the first by vertex order, turned so that its least vertex comes first."""
    n = normal()
    t = placed(triangles.select("a", "b", "c"), vertices).select(oriented(F.col("a"), F.col("b"), F.col("c")).alias("t"), *[c.alias(f"n{p}") for c, p in zip(n, "xyz", strict=True)]).distinct()
    around = t.select(F.explode("t").alias("vid"), "nx", "ny", "nz").groupBy("vid").agg(*[F.sum(f"n{p}").alias(f"m{p}") for p in "xyz"])
    crowd = t.groupBy(F.sort_array("t").alias("set")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    doubled = t.withColumn("set", F.sort_array("t")).join(crowd, "set")
    near = doubled.withColumn("vid", F.explode("t")).join(around, "vid").groupBy("set", "t", "nx", "ny", "nz").agg(*[F.sum(f"m{p}").alias(f"m{p}") for p in "xyz"])
    agrees = sum((F.col(f"n{p}") * F.col(f"m{p}") for p in "xyz"), F.lit(0.0))
    best = near.groupBy("set").agg(F.min(F.struct((-F.round(agrees, 9)).alias("d"), F.col("t"))).alias("b")).select("b.t")
    single = t.join(crowd, F.sort_array("t") == F.col("set"), "left_anti").select("t")
    return _spread(single.union(best), "t")


def first_use(triangles: DataFrame) -> DataFrame:
    """(vid, new): dense ids of used vertices in the order in which the triangle list (tid, a, b, c) names them first.
    Ranks are made per block of places and set one after another."""
    place = F.explode(F.array(*[F.struct((F.col("tid") * 3 + k).alias("at"), F.col(c).alias("vid")) for k, c in enumerate("abc")])).alias("p")
    first = triangles.select(place).groupBy("p.vid").agg(F.min("p.at").alias("at")).withColumn("blk", F.floor(F.col("at") / 4096))
    within = first.withColumn("r", F.row_number().over(Window.partitionBy("blk").orderBy("at")))
    before = first.groupBy("blk").agg(F.count(F.lit(1)).alias("n")).select("blk", (F.sum("n").over(Window.orderBy("blk")) - F.col("n")).alias("base"))  # one row a block
    return within.join(before, "blk").select("vid", (F.col("base") + F.col("r") - 1).alias("new"))


def compact(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A mesh (vertices; triangles with tid) without isolated vertices, ids in order of first use."""
    ids = first_use(triangles)
    v = vertices.join(ids, "vid").select(F.col("new").alias("vid"), *[c for c in vertices.columns if c != "vid"])
    t = triangles
    for k in "abc":
        t = t.join(ids.select(F.col("vid").alias(k), F.col("new").alias(f"_{k}")), k).drop(k).withColumnRenamed(f"_{k}", k)
    return v, t.select("tid", "a", "b", "c")


def split_by_vertex(triangles: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, a, b, c): triangles whose three vertices are of one group (vid, group); others belong to none."""
    t = triangles.select("a", "b", "c")
    for k in "abc":
        t = t.join(groups.select(F.col("vid").alias(k), F.col("group").alias(f"_{k}")), k)
    return t.filter("_a = _b and _b = _c").select(F.col("_a").alias("group"), "a", "b", "c")


def split_by_triangle(triangles: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each group of triangles (group, a, b, c) as a mesh of its own: (group, vid, ...) holds a vertex once for each group
    that uses it."""
    use = triangles.select("group", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return use.join(vertices, "vid").select("group", *vertices.columns), triangles.select("group", "a", "b", "c")


def set_operation(left: DataFrame, right: DataFrame, *, keep: bool) -> DataFrame:
    """Triangles of `left` that `right` has too, on the same vertices (keep), or lacks."""
    def form(t: DataFrame) -> DataFrame:
        return t.withColumn("_t", unoriented(F.col("a"), F.col("b"), F.col("c")))

    return form(left).join(form(right).select("_t"), "_t", "left_semi" if keep else "left_anti").drop("_t")


def component_topology(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(component, v, e, f, loops, chi, genus, shape) of each connected part of a consistently oriented manifold mesh; a
    component is named by its smallest vertex. Genus is that of the surface with its loops filled; shape is disk, annulus,
    sphere or torus where it is one. Loops are components of boundary half-edges, as in a manifold mesh each boundary
    vertex is in one loop."""
    found = connected_components(edges(triangles)).select(F.col("node").alias("vid"), "component")
    comp = vertices.select("vid").join(found, "vid", "left").select("vid", F.coalesce("component", "vid").alias("component"))
    rim = boundary_edges(triangles)
    loops = connected_components(rim).filter("node = component").select(F.col("node").alias("vid"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        zero = {c: F.lit(1 if c == name else 0).alias(c) for c in ("v", "e", "f", "loops")}
        return rows.join(comp, "vid").select("component", *zero.values())

    every = counted(vertices.select("vid"), "v").union(counted(edges(triangles).select(F.col("u").alias("vid")), "e"))
    every = every.union(counted(triangles.select(F.col("a").alias("vid")), "f")).union(counted(loops, "loops"))
    out = every.groupBy("component").agg(*[F.sum(c).alias(c) for c in ("v", "e", "f", "loops")]).withColumn("chi", F.col("v") - F.col("e") + F.col("f"))
    out = out.withColumn("genus", (2 - F.col("loops") - F.col("chi")) / 2)
    closed, n = F.col("loops") == 0, F.col("genus")
    shape = F.when(closed & (n == 0), "sphere").when(closed & (n == 1), "torus").when((F.col("loops") == 1) & (n == 0), "disk").when((F.col("loops") == 2) & (n == 0), "annulus")
    return out.withColumn("shape", shape)


def holes(loops: DataFrame) -> DataFrame:
    """(component, loop, k, vid): the boundary loops of each component, but its longest, as polygons that would close them,
    so in the other direction; of equally long ones the first by name is the outline. `loops` is (component, loop, k, u)."""
    size = loops.groupBy("component", "loop").agg(F.count(F.lit(1)).alias("n"))
    outline = size.groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("n"), "loop")).alias("b")).select("component", F.col("b.loop").alias("loop"))
    inner = loops.join(outline, ["component", "loop"], "left_anti").join(size, ["component", "loop"])
    return inner.select("component", "loop", (F.col("n") - 1 - F.col("k")).alias("k"), F.col("u").alias("vid"))
