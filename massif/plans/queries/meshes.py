"""Queries on meshes, merging, levels of detail and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions import octree
from massif.operators import lod, merge, mesh, raster, spatial
from massif.operators.components import connected_components
from massif.operators.index import closure
from massif.plans import fixtures as fx
from massif.plans.registry import query, rounded
from massif.plans.shared import fresh_dir, stash
from massif.sources import store

M = f"WITH {fx.PX}, {fx.MESH}"
H = f"{M}, {fx.HALF_EDGES}"
V = f"{M}, {fx.VERTS}"
BOUNDARY = f"{H}, be AS (SELECT u, v FROM he WHERE NOT EXISTS (SELECT 1 FROM he r WHERE r.u = he.v AND r.v = he.u))"
PLACED = f"{V}, pl AS (SELECT tri.a, tri.b, tri.c, " + ", ".join(f'v{k}.{p} AS "{k}{p}"' for k in "abc" for p in "xyz") + " FROM tri" + "".join(f" JOIN vert v{k} ON v{k}.vid = tri.{k}" for k in "abc") + ")"
_NX = ["(\"by\" - ay) * (cz - az) - (bz - az) * (cy - ay)", "(bz - az) * (cx - ax) - (bx - ax) * (cz - az)", "(bx - ax) * (cy - ay) - (\"by\" - ay) * (cx - ax)"]
AREA = "sqrt(" + " + ".join(f"({n}) * ({n})" for n in _NX) + ") / 2"


def tri(spark, sf) -> DataFrame:
    return fx.grid_mesh(spark, sf)


@query("meshify_triangles", f"{M} SELECT * FROM tri")
def _(spark, sf):
    return tri(spark, sf)


@query("mesh_edges", f"{H} SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS n FROM he GROUP BY 1, 2")
def _(spark, sf):
    return mesh.edges(tri(spark, sf))


@query("mesh_boundary_edges", f"{BOUNDARY} SELECT * FROM be")
def _(spark, sf):
    return mesh.boundary_edges(tri(spark, sf))


@query("mesh_boundary_vertices", f"{BOUNDARY} SELECT DISTINCT unnest([u, v]) AS vid FROM be")
def _(spark, sf):
    return mesh.boundary_vertices(tri(spark, sf))


@query("mesh_boundary_triangles", f"{BOUNDARY} SELECT DISTINCT a, b, c FROM he JOIN be ON he.u = be.u AND he.v = be.v")
def _(spark, sf):
    return mesh.boundary_triangles(tri(spark, sf))


# A third triangle on every seventh inner edge.
_EXTRA = "ex AS (SELECT a, b, c FROM tri UNION ALL SELECT a, b, CAST(a + 5000 AS BIGINT) FROM tri WHERE a % 7 = 0)"


def extra(spark, sf):
    t = tri(spark, sf)
    return t.union(t.filter("a % 7 = 0").select("a", "b", F.col("a") + 5000))


@query("mesh_nonmanifold_edges", f"{M}, {_EXTRA}, h AS (SELECT a AS u, b AS v FROM ex UNION ALL SELECT b, c FROM ex UNION ALL SELECT c, a FROM ex) SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) > 2")
def _(spark, sf):
    return mesh.non_manifold_edges(extra(spark, sf))


@query("orientation_consistency", f"{M}, {_EXTRA}, h AS (SELECT a AS u, b AS v FROM ex UNION ALL SELECT b, c FROM ex UNION ALL SELECT c, a FROM ex) SELECT u, v, count(*) AS n FROM h GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return mesh.inconsistent_edges(extra(spark, sf))


@query("vertex_fans", f"""{M.replace('WITH', 'WITH RECURSIVE', 1)}, op AS (SELECT a AS vid, b AS u, c AS v FROM tri UNION ALL SELECT b, c, a FROM tri UNION ALL SELECT c, a, b FROM tri),
two AS (SELECT vid, u, v FROM op UNION SELECT vid, v, u FROM op), r AS (SELECT vid, u AS n, u AS m FROM two UNION SELECT r.vid, r.n, two.v FROM r JOIN two ON r.vid = two.vid AND r.m = two.u)
SELECT vid, count(DISTINCT c) AS fans FROM (SELECT vid, n, min(m) AS c FROM r GROUP BY vid, n) GROUP BY vid""")
def _(spark, sf):
    return mesh.fans(tri(spark, sf))


@query("vertex_degree", f"{M} SELECT vid, count(*) AS n FROM (SELECT unnest([a, b, c]) AS vid FROM tri) GROUP BY vid")
def _(spark, sf):
    return mesh.degrees(tri(spark, sf))


@query("vertex_adjacency", f"{H} SELECT u AS vid, list_sort(list(DISTINCT v)) AS near FROM (SELECT u, v FROM he UNION SELECT v, u FROM he) GROUP BY u")
def _(spark, sf):
    return mesh.adjacency(tri(spark, sf))


@query("isolated_vertices", f"{V} SELECT vid FROM vert WHERE vid NOT IN (SELECT unnest([a, b, c]) FROM tri)")
def _(spark, sf):
    return mesh.isolated(fx.vertices(spark, sf), tri(spark, sf)).select("vid")


@query("euler_characteristic", f"{H}, {fx.VERTS}, n AS (SELECT (SELECT count(*) FROM vert) AS v, (SELECT count(DISTINCT (least(u, v), greatest(u, v))) FROM he) AS e, (SELECT count(*) FROM tri) AS f) SELECT v, e, f, v - e + f AS chi FROM n")
def _(spark, sf):
    return mesh.topology(fx.vertices(spark, sf), tri(spark, sf))


_REACH = "r AS (SELECT u AS n, u AS m FROM e UNION SELECT r.n, e.v FROM r JOIN e ON r.m = e.u)"


@query("connected_components", f"WITH RECURSIVE {fx.PT}, e AS (SELECT a.id AS u, b.id AS v FROM pt a JOIN pt b ON a.id <> b.id AND {'(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)'} <= {0.03 * 0.03!r}), {_REACH} SELECT n AS node, min(m) AS component FROM r GROUP BY n")
def _(spark, sf):
    p = fx.points(spark, sf)
    links = spatial.epsilon_join(p, p, 0.03).filter("id < r_id").select(F.col("id").alias("u"), F.col("r_id").alias("v"))
    return connected_components(links)


@query("mesh_components", f"""{V.replace('WITH', 'WITH RECURSIVE', 1)}, {fx.HALF_EDGES}, e AS (SELECT u, v FROM he UNION SELECT v, u FROM he), {_REACH},
c AS (SELECT vert.vid AS vid, coalesce(x.c, vert.vid) AS root FROM vert LEFT JOIN (SELECT n, min(m) AS c FROM r GROUP BY n) x ON vert.vid = x.n)
SELECT vid, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS component FROM c""")
def _(spark, sf):
    return mesh.components(fx.vertices(spark, sf), tri(spark, sf))


_DUP = "du AS (SELECT a, b, c FROM tri UNION ALL SELECT b, c, a FROM tri WHERE a % 3 = 0 UNION ALL SELECT a, c, b FROM tri WHERE a % 5 = 0)"


def doubled(spark, sf):
    t = tri(spark, sf)
    return t.union(t.filter("a % 3 = 0").select("b", "c", "a")).union(t.filter("a % 5 = 0").select("a", "c", "b"))


_OR = "CASE WHEN a = least(a, b, c) THEN [a, b, c] WHEN b = least(a, b, c) THEN [b, c, a] ELSE [c, a, b] END"


@query("dup_triangles_oriented", f"{M}, {_DUP} SELECT t[1] AS a, t[2] AS b, t[3] AS c, count(*) AS n FROM (SELECT {_OR} AS t FROM du) GROUP BY t HAVING count(*) > 1")
def _(spark, sf):
    return mesh.duplicates(doubled(spark, sf))


@query("dup_triangles_unoriented", f"{M}, {_DUP} SELECT t[1] AS a, t[2] AS b, t[3] AS c, count(*) AS n FROM (SELECT list_sort([a, b, c]) AS t FROM du) GROUP BY t HAVING count(*) > 1")
def _(spark, sf):
    return mesh.duplicates(doubled(spark, sf), orientation=False)


@query("dedup_triangles", f"{M}, {_DUP} SELECT DISTINCT t[1] AS a, t[2] AS b, t[3] AS c FROM (SELECT {_OR} AS t FROM du)")
def _(spark, sf):
    return mesh.deduplicated(doubled(spark, sf))


@query("degenerate_triangles", f"{M}, q AS (SELECT a // 2 AS a, b // 2 AS b, c // 2 AS c FROM tri) SELECT * FROM q WHERE a <> b AND b <> c AND a <> c")
def _(spark, sf):
    return mesh.not_degenerate(tri(spark, sf).select(*[F.floor(F.col(k) / 2).alias(k) for k in "abc"]))


@query("negligible_triangles", f"{PLACED}, ar AS (SELECT a, b, c, {AREA} AS s FROM pl) SELECT a, b, c FROM ar WHERE s < (SELECT avg(s) FROM ar) * 0.3")
def _(spark, sf):
    return mesh.negligible(mesh.placed(tri(spark, sf), fx.vertices(spark, sf)), 0.3).select("a", "b", "c")


@query("surface_area", f"{PLACED} SELECT round(sum({AREA}), 3) AS area, round(sum(((bx - ax) * (cy - ay) - (cx - ax) * (\"by\" - ay)) / 2), 6) AS flat FROM pl")
def _(spark, sf):
    p = mesh.placed(tri(spark, sf), fx.vertices(spark, sf))
    return p.agg(F.round(F.sum(mesh.area()), 3).alias("area"), F.round(F.sum(mesh.signed_area_2d()), 6).alias("flat"))


@query("edge_length_stats", f"{H}, {fx.VERTS}, d AS (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM he), l AS (SELECT sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS s FROM d JOIN vert a ON a.vid = u JOIN vert b ON b.vid = v) SELECT round(min(s), 6) AS lo, round(max(s), 6) AS hi, round(avg(s), 6) AS mid FROM l")
def _(spark, sf):
    e = mesh.edge_lengths(tri(spark, sf), fx.vertices(spark, sf))
    return e.agg(*[F.round(f("length"), 6).alias(n) for n, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg))])


@query("mesh_bounds", f"{V} SELECT min(x) AS lo_x, max(x) AS hi_x, min(z) AS lo_z, max(z) AS hi_z FROM vert")
def _(spark, sf):
    return fx.vertices(spark, sf).agg(*[f(c).alias(f"{n}_{c}") for c in "xz" for n, f in (("lo", F.min), ("hi", F.max))])


@query("reindex_vertices", f"{M} SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM (SELECT DISTINCT unnest([a, b, c]) AS vid FROM tri)")
def _(spark, sf):
    return mesh.reindex(fx.vertices(spark, sf), tri(spark, sf))


@query("combine_meshes", f"{M} SELECT CAST(0 AS BIGINT) AS mesh, a, b, c FROM tri UNION ALL SELECT 1, a + 1024, b + 1024, c + 1024 FROM tri")
def _(spark, sf):
    t = tri(spark, sf)
    both = t.select(F.lit(0).cast("long").alias("mesh"), "a", "b", "c").union(t.select(F.lit(1).cast("long"), "a", "b", "c"))
    counts = spark.range(2).select(F.col("id").alias("mesh"), F.lit(1024).cast("long").alias("n"))
    return mesh.concatenate(both, counts)


@query("uv_space", f"{V} SELECT vid, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) + 0.0 AS u, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) + 0.0 AS v FROM vert")
def _(spark, sf):
    vert = fx.vertices(spark, sf)
    lo_x, hi_x, lo_y, hi_y = vert.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    u, v = rounded((F.col("x") - lo_x) / (hi_x - lo_x), (F.col("y") - lo_y) / (hi_y - lo_y))
    return vert.select("vid", u.alias("u"), v.alias("v"))


# Merging and cutting

_TREES = f"WITH {fx.PT}, {fx.PAIR}, {fx.sql_closure('lp', 'li', 4)}, {fx.sql_closure('rp', 'ri', 4)}, sp AS (SELECT coalesce(li.level, ri.level) AS level, coalesce(li.index, ri.index) AS index, coalesce(li.status, 'Missing') AS left_status, coalesce(ri.status, 'Missing') AS right_status FROM li FULL OUTER JOIN ri ON li.level = ri.level AND li.index = ri.index)"
_ACT = "CASE WHEN right_status = 'Missing' THEN 'Left' WHEN left_status = 'Missing' THEN 'Right' WHEN left_status = 'Leaf' AND right_status = 'Leaf' THEN 'Merge' ELSE 'Recurse' END AS action"


def trees(spark, sf):
    left, right = fx.tree_pair(spark, sf)
    return closure(left), closure(right)


@query("merge_status_matrix", f"{_TREES} SELECT left_status, right_status, count(*) AS n FROM sp GROUP BY 1, 2")
def _(spark, sf):
    return merge.status_pairs(*trees(spark, sf)).groupBy("left_status", "right_status").agg(F.count(F.lit(1)).alias("n"))


@query("simple_merge_actions", f"{_TREES}, a AS (SELECT *, {_ACT} FROM sp) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM a p WHERE p.action <> 'Recurse' AND p.level < a.level AND a.index >> CAST(3 * (a.level - p.level) AS BIGINT) = p.index)")
def _(spark, sf):
    return merge.simple_merge(*trees(spark, sf))


@query("masked_merge_actions", f"""{_TREES}, c AS (SELECT *, CASE index % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'all' ELSE 'part' END AS cover FROM sp)
SELECT level, index, CASE WHEN cover = 'none' THEN CASE WHEN left_status = 'Missing' THEN 'Ignore' ELSE 'Left' END WHEN cover = 'all' THEN CASE WHEN right_status = 'Missing' THEN 'Ignore' ELSE 'Right' END
  WHEN left_status <> 'Virtual' AND right_status <> 'Virtual' THEN 'Merge' ELSE 'Recurse' END AS action FROM c""")
def _(spark, sf):
    cover = F.when(F.col("index") % 3 == 0, "none").when(F.col("index") % 3 == 1, "all").otherwise("part")
    p = merge.status_pairs(*trees(spark, sf)).withColumn("cover", cover)
    return p.select("level", "index", merge.masked_action(F.col("left_status"), F.col("right_status"), F.col("cover")).alias("action"))


@query("ancestor_fallback", f"WITH {fx.PT}, {fx.PAIR} SELECT rp.level, rp.index, lp.level AS found_level, lp.index AS found_index FROM rp LEFT JOIN lp ON rp.index >> 3 = lp.index")
def _(spark, sf):
    left, right = fx.tree_pair(spark, sf)
    return merge.ancestor_fallback(right, left)


_LO, _HI = (-0.2, -0.2, -0.2), (0.1, 0.1, 0.2)
_MEET = " AND ".join(f"-1 + {fx.sql_coord('index', k, 5)} * (2.0 / 32) < {_HI[k]} AND -1 + ({fx.sql_coord('index', k, 5)} + 1) * (2.0 / 32) > {_LO[k]}" for k in range(3))
for _name, _keep in (("cut_inside", True), ("cut_outside", False)):
    def _cut(spark, sf, keep=_keep):
        return merge.cut_leaves(stash(fx.leaves(spark, sf), "leaves"), fx.UNIT, _LO, _HI, 5, keep_inside=keep)

    query(_name, f"WITH {fx.PT}, {fx.LEAF} SELECT level, index FROM leaf WHERE {'' if _keep else 'NOT '}({_MEET})")(_cut)

# A square with a square hole, and a triangle that touches it at a corner.
_RINGS = [(0, 0, True, [(-0.2, -0.2), (0.1, -0.2), (0.1, 0.1), (-0.2, 0.1)]), (0, 1, False, [(-0.1, -0.1), (-0.1, 0.0), (0.0, 0.0), (0.0, -0.1)]), (1, 0, True, [(0.1, 0.1), (0.3, 0.1), (0.2, 0.3)])]


def mask(spark) -> DataFrame:
    rows = [(c, r, o, i, x, y) for c, r, o, pts in _RINGS for i, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "component int, ring int, is_outer boolean, seq int, x double, y double")


def _ray_sql(pts) -> str:
    out = []
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
        out.append(f"CASE WHEN ({y1!r} > y) <> ({y2!r} > y) AND x < ({x2!r} - {x1!r}) * (y - {y1!r}) / nullif({y2!r} - {y1!r}, 0) + {x1!r} THEN 1 ELSE 0 END".replace("- -", "+ "))
    return " + ".join(out)


_IN0 = f"(({_ray_sql(_RINGS[0][3])} + {_ray_sql(_RINGS[1][3])}) % 2 = 1)"
_IN1 = f"(({_ray_sql(_RINGS[2][3])}) % 2 = 1)"
for _name, _keep in (("point_in_mask", True), ("point_outside_mask", False)):
    def _pm(spark, sf, keep=_keep):
        return merge.in_mask(fx.points(spark, sf).select("id", "x", "y"), mask(spark), keep_inside=keep).select("id")

    _double = "pd AS (SELECT id, x, y FROM pt)"
    query(_name, f"WITH {fx.PT}, {_double} SELECT id FROM pd WHERE {'' if _keep else 'NOT '}({_IN0} OR {_IN1})")(_pm)


@query("mask_rings", "SELECT * FROM (VALUES (0, 0, 0.09), (0, 1, -0.01), (1, 0, 0.02)) t(component, ring, area)".replace("0.09)", "CAST(0.09 AS DOUBLE))").replace("-0.01)", "CAST(-0.01 AS DOUBLE))").replace("0.02)", "CAST(0.02 AS DOUBLE))"))
def _(spark, sf):
    return merge.ring_area(merge.normal_rings(mask(spark))).select("component", "ring", F.round("area", 6).alias("area"))


_SNAP = ", ".join(f"floor({a} * 8) AS {a}" for a in "xyz")


@query("weld_exact", f"WITH {fx.PT}, g AS (SELECT id, {_SNAP} FROM pt) SELECT id, min(id) OVER (PARTITION BY x, y, z) AS merged FROM g")
def _(spark, sf):
    return merge.weld_exact(fx.points(spark, sf).select("id", *[F.floor(F.col(a) * 8).alias(a) for a in "xyz"]))


_EDGE = f"e AS (SELECT a.id AS u, b.id AS v FROM pt a JOIN pt b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {0.03 * 0.03!r})"


@query("weld_components", f"WITH RECURSIVE {fx.PT}, {_EDGE}, {_REACH} SELECT n AS id, min(m) AS merged FROM r GROUP BY n")
def _(spark, sf):
    return merge.weld_components(fx.points(spark, sf), 0.03)


@query("weld_average", f"WITH {fx.PT}, g AS (SELECT id, x, y, z, min(id) OVER (PARTITION BY floor(x * 8), floor(y * 8), floor(z * 8)) AS merged FROM pt) SELECT merged, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM g GROUP BY merged")
def _(spark, sf):
    p = fx.points(spark, sf)
    m = merge.weld_exact(p.select("id", *[F.floor(F.col(a) * 8).alias(a) for a in "xyz"]))
    a = merge.averaged(p.select("id", "x", "y", "z"), m)
    return a.select("merged", *[c.alias(n) for c, n in zip(rounded(F.col("x"), F.col("y"), F.col("z")), "xyz", strict=True)])


@query("weld_multipartite")
def _(spark, sf):
    return merge.weld_multipartite(fx.points(spark, sf).withColumn("source", F.col("id") % 4), 0.03)


@query("cross_mesh_mapping", f"""WITH {fx.PT}, m AS (SELECT id, id % 3 AS mesh, x, y, z FROM pt)
SELECT mesh, id, to_mesh, to_id FROM (SELECT a.mesh AS mesh, a.id AS id, b.mesh AS to_mesh, b.id AS to_id, row_number() OVER (PARTITION BY a.id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.mesh, b.id) AS r
  FROM m a JOIN m b ON b.mesh < a.mesh AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= {0.1 * 0.1!r}) WHERE r = 1""")
def _(spark, sf):
    p = fx.points(spark, sf).select("id", (F.col("id") % 3).alias("mesh"), "x", "y", "z")
    return merge.cross_mesh_mapping(p, 0.1)


@query("merged_mesh", f"{M}, q AS (SELECT a - a % 2 AS a, b - b % 2 AS b, c - c % 2 AS c FROM tri) SELECT a, b, c FROM q WHERE a <> b AND b <> c AND a <> c")
def _(spark, sf):
    ids = spark.range(1024).select(F.col("id").alias("vid"), (F.col("id") - F.col("id") % 2).alias("new"))
    return mesh.remap(tri(spark, sf), ids)


# Levels of detail

SPACE32 = octree.Space(0.0, 8192.0)
_MORT = fx.sql_morton(*[f"CAST(floor((a{p} + \"b{p}\" + c{p}) / 3 / (extent / 1024)) AS BIGINT)" for p in "xyz"], 10)
# Values of pixels grow with the table, so the space is doubled until it holds the mesh.
_EXTENT = "sz AS (SELECT min(e) AS extent FROM (SELECT 8192.0::DOUBLE * power(2, unnest(range(0, 50))) AS e) WHERE e > (SELECT max(greatest((ax + bx + cx) / 3, (ay + \"by\" + cy) / 3, (az + bz + cz) / 3)) FROM pl))"
CLUST = f"{PLACED}, {_EXTENT}, kt AS (SELECT pl.*, {_MORT} AS morton FROM pl, sz), cl AS (SELECT *, morton >> 24 AS node, (row_number() OVER (PARTITION BY morton >> 24 ORDER BY morton, a, b, c) - 1) // 64 AS cluster FROM kt)"


def clustered(spark, sf) -> DataFrame:
    placed = mesh.placed(tri(spark, sf), fx.vertices(spark, sf))
    return lod.clusterize(placed, lod.space_of(placed, SPACE32), size=64)


@query("clusterize_blocks", f"{CLUST} SELECT a, b, c, node, CAST(cluster AS BIGINT) AS cluster FROM cl")
def _(spark, sf):
    return clustered(spark, sf).select("a", "b", "c", "node", "cluster")


@query("group_partition", f"{CLUST} SELECT node, CAST(cluster AS BIGINT) AS cluster, CAST((row_number() OVER (PARTITION BY node ORDER BY cluster) - 1) // 4 AS BIGINT) AS group_id FROM (SELECT DISTINCT node, cluster FROM cl)")
def _(spark, sf):
    return lod.group_clusters(clustered(spark, sf).select("node", "cluster").distinct())


@query("seam_lock", f"{CLUST} SELECT vid, count(*) AS clusters FROM (SELECT DISTINCT node, cluster, unnest([a, b, c]) AS vid FROM cl) GROUP BY vid HAVING count(*) > 1")
def _(spark, sf):
    return lod.locked_vertices(clustered(spark, sf))


@query("group_bounds_error", f"""{CLUST}, cb AS (SELECT node, cluster, min(least(ax, bx, cx)) AS lo_x, max(greatest(az, bz, cz)) AS hi_z, count(*) AS n FROM cl GROUP BY 1, 2),
g AS (SELECT *, (row_number() OVER (PARTITION BY node ORDER BY cluster) - 1) // 4 AS group_id FROM cb)
SELECT node, CAST(group_id AS BIGINT) AS group_id, min(lo_x) AS lo_x, max(hi_z) AS hi_z, CAST(max(n * 0.5) AS DOUBLE) AS error FROM g GROUP BY 1, 2""")
def _(spark, sf):
    b = stash(lod.cluster_bounds(clustered(spark, sf)), "cluster-bounds")
    groups = lod.group_clusters(b.select("node", "cluster"))
    errors = b.select("node", "cluster", lod.combine_error("Add", F.lit(0.0), F.col("n") * 0.5).alias("error"))
    return lod.group_metadata(b.drop("n"), groups, errors).select("node", "group_id", "lo_x", "hi_z", "error")


@query("leaf_metadata_concat", "SELECT CAST(l_suppkey % 5 AS BIGINT) AS part, CAST(row_number() OVER (ORDER BY l_suppkey % 5, l_linenumber) - 1 AS BIGINT) AS group_id FROM (SELECT DISTINCT l_suppkey % 5 AS l_suppkey, l_linenumber FROM lineitem)")
def _(spark, sf):
    p = fx.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("part"), "l_linenumber").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return lod.concat_metadata(p)


_CELL = ", ".join(f"floor({p} / 4.0) AS g{p}" for p in "xyz")


@query("lod_vertex_clustering", f"""{V}, k AS (SELECT vid, {_CELL} FROM vert), m AS (SELECT vid, min(vid) OVER (PARTITION BY gx, gy, gz) AS new FROM k),
q AS (SELECT a.new AS a, b.new AS b, c.new AS c FROM tri JOIN m a ON tri.a = a.vid JOIN m b ON tri.b = b.vid JOIN m c ON tri.c = c.vid)
SELECT DISTINCT t[1] AS a, t[2] AS b, t[3] AS c FROM (SELECT {_OR} AS t FROM q WHERE a <> b AND b <> c AND a <> c)""")
def _(spark, sf):
    return lod.simplify(tri(spark, sf), fx.vertices(spark, sf), 4.0)[1]


@query("lod_pyramid_all_levels")
def _(spark, sf):
    return lod.pyramid(tri(spark, sf), fx.vertices(spark, sf), 2.0, 4)


_UP = f"WITH {fx.PT}, inp AS (SELECT DISTINCT CAST(4 AS BIGINT) AS level, {fx.sql_cell(4)} AS index FROM pt UNION SELECT DISTINCT CAST(3 AS BIGINT), {fx.sql_cell(3)} FROM pt WHERE id % 3 = 0)"
_C = ", ".join(f"{fx.sql_coord('index', k, 4)} AS c{n}" for k, n in enumerate("xyz"))
_TARGETS = f"""{_UP}, src AS (SELECT index FROM inp WHERE level = 3 UNION SELECT index >> 3 FROM inp WHERE level = 4),
tg AS (SELECT DISTINCT {fx.sql_morton('x', 'y', 'z', 3)} AS index FROM (SELECT least(cx + a, 7) AS x, least(cy + b, 7) AS y, least(cz + c, 7) AS z FROM (SELECT {_C} FROM src), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)))"""


def _inputs(spark, sf):
    p = fx.points(spark, sf)

    def on(level, d):
        return d.select(F.lit(level).cast("long").alias("level"), octree.cell_of(fx.UNIT, F.lit(level), F.col("x"), F.col("y"), F.col("z")).alias("index")).distinct()

    return on(4, p).union(on(3, p.filter("id % 3 = 0")))


@query("level_targets", f"{_TARGETS} SELECT index FROM tg")
def _(spark, sf):
    i = _inputs(spark, sf)
    return lod.level_targets(i, i, 3)


@query("work_plan_inputs", f"{_TARGETS} SELECT DISTINCT target, source FROM (SELECT index AS target, {fx.sql_morton('greatest(cx - a, 0)', 'greatest(cy - b, 0)', 'greatest(cz - c, 0)', 3)} AS source FROM (SELECT index, {_C} FROM tg), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)) WHERE source IN (SELECT index FROM inp WHERE level = 3)")
def _(spark, sf):
    i = _inputs(spark, sf)
    return lod.work_plan(lod.level_targets(i, i, 3), i, 3)


@query("work_plan_children", f"{_TARGETS} SELECT index >> 3 AS target, index AS child FROM inp WHERE level = 4 AND index >> 3 IN (SELECT index FROM tg)")
def _(spark, sf):
    i = _inputs(spark, sf)
    return lod.child_plan(lod.level_targets(i, i, 3), i, 3)


@query("texture_budget", "WITH d AS (SELECT p_partkey % 50 AS node, p_partkey AS cluster, 8 + p_partkey % 40 AS w, 4 + p_partkey % 30 AS h FROM part), s AS (SELECT *, least(1.0, sqrt(5000.0 / sum(w * h) OVER (PARTITION BY node))) AS k FROM d) SELECT node, cluster, CAST(greatest(ceil(w * k), 1) AS BIGINT) AS w, CAST(greatest(ceil(h * k), 1) AS BIGINT) AS h FROM s")
def _(spark, sf):
    k = F.col("p_partkey")
    d = fx.read(spark, sf, "part").select((k % 50).alias("node"), k.alias("cluster"), (8 + k % 40).alias("w"), (4 + k % 30).alias("h"))
    return lod.texture_sizes(d, 5000.0)


# The store

_NODES = f"WITH {fx.PT} SELECT CAST(5 AS BIGINT) AS level, {fx.sql_cell(5)} AS index, count(*) AS n FROM pt GROUP BY 2"


def nodes(spark, sf) -> DataFrame:
    p = fx.points(spark, sf)
    cell = octree.cell_of(fx.UNIT, F.lit(5), F.col("x"), F.col("y"), F.col("z"))
    return p.groupBy(F.lit(5).cast("long").alias("level"), cell.alias("index")).agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_roundtrip", _NODES)
def _(spark, sf):
    final = fresh_dir(spark, "snapshot")
    attempt = store.create_attempt(final)
    store.save_nodes(nodes(spark, sf), attempt)
    store.publish(spark, attempt, final)
    return spark.read.parquet(f"{final}/nodes")


@query("resume_skips_finished", f"SELECT level, index FROM ({_NODES}) WHERE index % 2 = 1")
def _(spark, sf):
    n = nodes(spark, sf).select("level", "index")
    return store.unfinished(n, n.filter("index % 2 = 0"))


@query("link_unchanged", f"SELECT level, index, n FROM ({_NODES}) WHERE index % 3 = 0")
def _(spark, sf):
    n = nodes(spark, sf)
    return store.link_unchanged(n, n.filter("index % 3 = 0"))


@query("link_subtree", f"SELECT level, index, n FROM ({_NODES}) WHERE index >> 12 = 7")
def _(spark, sf):
    return store.link_subtree(nodes(spark, sf), 1, 7)


@query("content_changes", f"SELECT level, index FROM ({_NODES}) WHERE index % 5 = 0")
def _(spark, sf):
    n = nodes(spark, sf)
    recorded = n.select("level", "index", store.content_hash(F.when(F.col("index") % 5 == 0, F.col("n") + 1).otherwise(F.col("n"))).alias("hash"))
    return store.changed(n, recorded, "n")


@query("partial_tile_read", f"WITH {fx.PX} SELECT CAST(px // 8 AS BIGINT) AS sx, CAST(py // 8 AS BIGINT) AS sy, list(v ORDER BY py, px) AS data FROM px WHERE px >= 8 AND px < 24 AND py < 8 GROUP BY 1, 2")
def _(spark, sf):
    t = store.subtiles(fx.pixels(spark, sf), 8).withColumns({c: F.lit(0).cast("long") for c in ("zoom", "tx", "ty")})
    return store.read_subtiles(t, 0, 0, 0, (1, 3), (0, 1)).select("sx", "sy", "data")


@query("schema_upgrade_v1_v2", f"WITH {fx.PX} SELECT px, py, v, CAST('Area' AS VARCHAR) AS placement, CAST(0 AS BIGINT) AS overlap FROM px")
def _(spark, sf):
    v1 = fx.pixels(spark, sf).select("px", "py", "v")
    return store.upgrade(v1, {"placement": F.lit("Area"), "overlap": F.lit(0).cast("long"), "v": F.lit(0)})


@query("attribution_json_parse", "SELECT CAST(0 AS INTEGER) AS idx, CAST(10 AS DOUBLE) AS spatial_resolution, 'a' AS copyright UNION ALL SELECT 1, 0.5, 'b'".replace("CAST(10 AS DOUBLE)", "CAST(10.0 AS DOUBLE)").replace("1, 0.5", "1, CAST(0.5 AS DOUBLE)"))
def _(spark, sf):
    entry = '{"spatial_resolution": %s, "acquisition_date": "", "ingestion_date": "", "copyright": "%s", "copyright_link": "", "license": ""}'
    return store.parse_attribution(spark, f"[{entry % (10, 'a')}, {entry % (0.5, 'b')}]").select("idx", "spatial_resolution", "copyright")


@query("raster_pyramid_store", f"WITH {fx.PX} SELECT CAST(px // 4 AS BIGINT) AS px, CAST(py // 4 AS BIGINT) AS py, max(v) AS v FROM px GROUP BY 1, 2")
def _(spark, sf):
    return raster.halve(fx.pixels(spark, sf), 2, v=raster.reduce_max)
