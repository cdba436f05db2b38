"""Queries on closed meshes: boxes cut from them and closed again, and holes found and filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.operators import mesh, solids, surface
from massif.operators.components import connected_components
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import H, tri
from massif.plans.registry import query, rounded
from massif.plans.shared import stash

LOW, HIGH = (3.5, 2.25, 40.5), (60.25, 50.5, 110.25)
_SIDES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (1, 2, 6), (1, 6, 5), (2, 3, 7), (2, 7, 6), (3, 0, 4), (3, 4, 7)]


def columns(spark, sf) -> DataFrame:
    """A block for each valid pixel that orders make, as high as its value: placed triangles seen from outside."""
    p = fx.grown_pixels(spark, sf).filter("valid")
    pick = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    far = F.array(*[F.array(*[F.lit(float(at)) for i in side for at in pick[i]]) for side in _SIDES])  # one value, so little code
    at = {"x": lambda o: F.col("px") + o, "y": lambda o: F.col("py") + o, "z": lambda o: F.col("v") * o}
    t = p.select("px", "py", "v", F.explode(far).alias("o"))
    return t.select(*[at[c](F.col("o")[3 * i + j]).alias(f"{k}{c}") for i, k in enumerate("abc") for j, c in enumerate("xyz")])


_O = [f"(least({hi}, {HIGH[i]!r}::DOUBLE) - greatest({lo}, {LOW[i]!r}::DOUBLE))" for i, (lo, hi) in enumerate((("px", "px + 1"), ("py", "py + 1"), ("0", "v")))]
_MEET = " AND ".join(f"{o} > 0" for o in _O)
_FACES = [("x", "px", "px + 1", f"{_O[1]} * {_O[2]}"), ("y", "py", "py + 1", f"{_O[0]} * {_O[2]}"), ("z", "0", "v", f"{_O[0]} * {_O[1]}")]


# Sizes follow from the overlap of each block with the box; nothing may be left open.
@query("clip_box_cap", f"WITH {fx.GROWN_PX}, b AS (SELECT px, py, v FROM px WHERE valid AND {_MEET}) SELECT 'volume' AS what, CAST(round(coalesce(sum({' * '.join(_O)}), 0), 4) AS DOUBLE) AS size FROM b UNION ALL SELECT 'open', 0.0" + "".join(
    f" UNION ALL SELECT '{a}{s}', CAST(round(coalesce(sum({size}), 0), 4) AS DOUBLE) FROM b WHERE {lo} < {d[i]!r} AND {hi} > {d[i]!r}" for i, (a, lo, hi, size) in enumerate(_FACES) for s, d in (("0", LOW), ("1", HIGH))))
def _(spark, sf):
    t = stash(solids.clip_box_cap(columns(spark, sf), LOW, HIGH), "capped")
    sizes = [F.struct(F.lit("volume").alias("what"), (solids.volume(t) / 6).alias("size"))]
    for i, a in enumerate("xyz"):
        for s, d in (("0", LOW), ("1", HIGH)):
            flat = (F.col(f"a{a}") == d[i]) & (F.col(f"b{a}") == d[i]) & (F.col(f"c{a}") == d[i])
            sizes.append(F.struct(F.lit(f"{a}{s}").alias("what"), F.when(flat, mesh.area()).otherwise(0.0).alias("size")))
    told = t.select(F.explode(F.array(*sizes)).alias("s")).select("s.*").union(solids.open_sides(t).select(F.lit("open"), F.lit(1.0)))
    none = spark.createDataFrame([(w, 0.0) for w in ("volume", "open", *[f"{a}{s}" for a in "xyz" for s in "01"])], "what string, size double")
    return told.union(none).groupBy("what").agg(F.sum("size").alias("size")).select("what", (F.round("size", 4) + 0.0).alias("size"))


# Each boundary half-edge is followed by the one that its triangle fan ends with; loops are walked from their least half-edge.
_LOOPS = f"""{H.replace('WITH', 'WITH RECURSIVE', 1)}, h AS MATERIALIZED (SELECT u, v, a + b + c - u - v AS w FROM he),
be AS MATERIALIZED (SELECT u, v, w FROM h WHERE NOT EXISTS (SELECT 1 FROM h r WHERE r.u = h.v AND r.v = h.u)),
turned AS (SELECT u AS eu, v, w FROM be UNION ALL SELECT turned.eu, turned.v, h.w FROM turned JOIN h ON h.u = turned.w AND h.v = turned.v),
nx AS MATERIALIZED (SELECT eu AS u, turned.v AS v, turned.w AS w FROM turned JOIN be ON be.u = turned.v AND be.v = turned.w),
walk AS (SELECT u AS su, v AS sv, CAST(0 AS BIGINT) AS k, u, v FROM be UNION ALL SELECT su, sv, k + 1, nx.v, nx.w FROM walk JOIN nx ON walk.u = nx.u AND walk.v = nx.v WHERE NOT (nx.v = su AND nx.w = sv)),
lp AS MATERIALIZED (SELECT su AS loop_u, sv AS loop_v, k, u FROM walk WHERE (su, sv) IN (SELECT (su, sv) FROM walk GROUP BY su, sv HAVING min((u, v)) = (su, sv))),
e AS MATERIALIZED (SELECT u, v FROM he UNION SELECT v, u FROM he), reach AS (SELECT u AS n, u AS m FROM e UNION SELECT reach.n, e.v FROM reach JOIN e ON reach.m = e.u),
comp AS MATERIALIZED (SELECT n, min(m) AS component FROM reach GROUP BY n),
sized AS MATERIALIZED (SELECT component, loop_u, loop_v, count(*) AS n FROM lp JOIN comp ON lp.u = comp.n GROUP BY ALL),
hole AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, loop_u, loop_v) AS r FROM sized) WHERE r > 1)"""


@query("mesh_holes", f"{_LOOPS} SELECT component, loop_u, loop_v, n - 1 - k AS k, u AS vid FROM hole JOIN lp USING (loop_u, loop_v)")
def _(spark, sf):
    """Holes of the grid's components, whose loops part at shared vertices as boundary_loops() has them."""
    t = tri(spark, sf)
    comp = connected_components(mesh.edges(t)).select(F.col("node").alias("u"), "component")
    found = mesh.holes(surface.boundary_loops(t).join(comp, "u").select("component", "loop", "k", "u"))
    return found.select("component", F.col("loop.u").alias("loop_u"), F.col("loop.v").alias("loop_v"), "k", "vid")


# However a hole is triangulated, it takes two triangles fewer than corners, and their flat areas add up to the outline's.
@query("holes_filled", f"""{_LOOPS}, {fx.VERTS}, pl AS (SELECT component, loop_u, loop_v, n, k, x, y FROM hole JOIN lp USING (loop_u, loop_v) JOIN vert ON vert.vid = lp.u)
SELECT p.component, p.loop_u, p.loop_v, p.n - 2 AS triangles, CAST(round(-sum(p.x * q.y - q.x * p.y) / 2, 6) + 0.0 AS DOUBLE) AS area FROM pl p JOIN pl q ON p.loop_u = q.loop_u AND p.loop_v = q.loop_v AND q.k = (p.k + 1) % p.n GROUP BY ALL""")
def _(spark, sf):
    t, v = tri(spark, sf), fx.vertices(spark, sf)
    filled = stash(solids.fill_holes(v, t), "filled")
    placed = mesh.placed(filled, v)
    found = placed.groupBy("component", F.col("loop.u").alias("loop_u"), F.col("loop.v").alias("loop_v")).agg(F.count(F.lit(1)).alias("triangles"), F.sum(mesh.signed_area_2d()).alias("area"))
    return found.select("component", "loop_u", "loop_v", "triangles", rounded(F.col("area"))[0].alias("area"))
