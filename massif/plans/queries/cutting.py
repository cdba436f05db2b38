"""Queries of masks, of cutting by them and of merging inside and outside of them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree
from massif.operators import masks, merge
from massif.plans import fixtures as fx
from massif.plans.queries.meshes import _IN0, _IN1, _RINGS, mask
from massif.plans.registry import query
from massif.plans.shared import fresh_dir, stash
from massif.sources import shapes

PT = f"WITH {fx.PT}"
_SIDES = [(c, p, q) for c, _, _, pts in _RINGS for p, q in zip(pts, pts[1:] + pts[:1], strict=True)]


def _meets(lo_x: str, lo_y: str, hi_x: str, hi_y: str, component: int | None = None) -> str:
    """Whether a side of a ring, or of one component's, meets a box."""
    out = []
    for c, (x1, y1), (x2, y2) in _SIDES:
        if component not in (None, c):
            continue
        lows, highs, stays = ["0.0::DOUBLE"], ["1.0::DOUBLE"], []
        for a, b, lo, hi in ((x1, x2, lo_x, hi_x), (y1, y2, lo_y, hi_y)):
            if a == b:
                stays.append(f"{a!r} BETWEEN {lo} AND {hi}")
            else:
                t, u = f"({lo} - {a!r}::DOUBLE) / ({b!r}::DOUBLE - {a!r}::DOUBLE)", f"({hi} - {a!r}::DOUBLE) / ({b!r}::DOUBLE - {a!r}::DOUBLE)"
                lows.append(f"least({t}, {u})")
                highs.append(f"greatest({t}, {u})")
        out.append(f"({' AND '.join([*stays, f'greatest({chr(44).join(lows)}) <= least({chr(44).join(highs)})'])})".replace("- -", "+ "))
    return " OR ".join(out)


def _square(level: int) -> str:
    """lo_x..hi_y and the centre x, y of cells on a level."""
    size = 2.0 / 2**level
    low = {a: f"(-1 + {fx.sql_coord('index', k, level) if level else 0} * {size!r}::DOUBLE)" for k, a in enumerate("xy")}
    return ", ".join(f"{low[a]} AS lo_{a}, {low[a]} + {size!r} AS hi_{a}, {low[a]} + {size / 2!r} AS {a}" for a in "xy")


_COVER = f"CASE WHEN {_meets('lo_x', 'lo_y', 'hi_x', 'hi_y')} THEN 'part' WHEN {_IN0} OR {_IN1} THEN 'all' ELSE 'none' END"


@query("mask_cover", f"{PT}, {fx.LEAF}, sq AS (SELECT level, index, {_square(5)} FROM leaf) SELECT level, index, {_COVER} AS cover FROM sq")
def _(spark, sf):
    return masks.cover(fx.leaves(spark, sf), mask(spark), fx.UNIT)


@query("mask_in_bounds", f"{PT}, c AS (SELECT * FROM (VALUES (0, -0.2, -0.2, 0.1, 0.1), (1, 0.1, 0.1, 0.3, 0.3)) t(component, a, b, c, d)) SELECT id, component FROM pt, c WHERE a::DOUBLE <= x + 0.1::DOUBLE AND c::DOUBLE >= x AND b::DOUBLE <= y + 0.05::DOUBLE AND d::DOUBLE >= y")
def _(spark, sf):
    p = fx.points(spark, sf)
    b = p.select("id", F.col("x").alias("lo_x"), F.col("y").alias("lo_y"), (F.col("x") + 0.1).alias("hi_x"), (F.col("y") + 0.05).alias("hi_y"))
    return masks.in_bounds(mask(spark), b, 0.25)


_ONE = "-0.2, -0.2, 0.1, 0.1"
_HOLE = "-0.1, -0.1, 0.0, 0.0"


def _overlap(box: str) -> str:
    a, b, c, d = (f"{float(v)!r}::DOUBLE" for v in box.split(", "))
    return f"(greatest(0, least(hi_x, {c}) - greatest(lo_x, {a})) * greatest(0, least(hi_y, {d}) - greatest(lo_y, {b})))".replace("(-", "(-")


_IN = f"({_overlap(_ONE)} - {_overlap(_HOLE)})"


def _square_mask(spark):
    return mask(spark).filter("component = 0")


def _boxes(lo_x, lo_y, hi_x, hi_y, z):
    return F.array(g.point(lo_x, lo_y, z), g.point(hi_x, lo_y, z), g.point(hi_x, hi_y, z), g.point(lo_x, hi_y, z))


for _name, _keep in (("cut_mask_inside", True), ("cut_mask_outside", False)):
    def _cut(spark, sf, keep=_keep):
        p = fx.points(spark, sf)
        b = p.select("id", _boxes(F.col("x"), F.col("y"), F.col("x") + 0.11, F.col("y") + 0.07, F.col("z")).alias("polygon"))
        pieces = stash(masks.triangulate(merge.normal_rings(_square_mask(spark))), "mask-pieces")
        out = masks.cut(b, pieces, 0.125, keep_inside=keep).groupBy("id").agg(F.round(F.sum(g.polygon_area_2d(F.col("polygon"))), 8).alias("area"))
        return out.filter("area > 0")

    _area = _IN if _keep else f"((hi_x - lo_x) * (hi_y - lo_y) - {_IN})"
    query(_name, f"{PT}, b AS (SELECT id, x AS lo_x, y AS lo_y, x + 0.11::DOUBLE AS hi_x, y + 0.07::DOUBLE AS hi_y FROM pt), a AS (SELECT id, round({_area}, 8) AS area FROM b) SELECT * FROM a WHERE area > 0")(_cut)


@query("mask_triangulation", "SELECT component, round(sum(area), 9) AS area FROM (VALUES (0, 0.08::DOUBLE), (1, 0.02::DOUBLE)) t(component, area) GROUP BY 1")
def _(spark, sf):
    t = masks.triangulate(merge.normal_rings(mask(spark)))
    corner = [g.point(F.col(f"x{k}"), F.col(f"y{k}"), F.lit(0.0)) for k in range(3)]
    return t.groupBy("component").agg(F.round(F.sum(g.polygon_area_2d(F.array(*corner))), 9).alias("area"))


_KEYS = ", ".join([fx.PAIR, fx.sql_closure("lp", "lx", 4), fx.sql_closure("rp", "rx", 4)])
_BESIDE = """bs AS (SELECT DISTINCT lx.level + 1 AS level, (lx.index << 3) | i AS index FROM lx, (SELECT unnest(range(0, 8)) AS i) WHERE lx.status = 'Virtual' AND EXISTS (SELECT 1 FROM rp WHERE rp.level <= lx.level AND lx.index >> CAST(3 * (lx.level - rp.level) AS BIGINT) = rp.index)
  UNION SELECT rx.level + 1, (rx.index << 3) | i FROM rx, (SELECT unnest(range(0, 8)) AS i) WHERE rx.status = 'Virtual' AND EXISTS (SELECT 1 FROM lp WHERE lp.level <= rx.level AND rx.index >> CAST(3 * (rx.level - lp.level) AS BIGINT) = lp.index))"""
_SQUARES = " UNION ALL ".join(f"SELECT level, index, {_square(lv)} FROM ks WHERE level = {lv}" for lv in range(5))
_MERGED = f"""{PT}, {_KEYS}, {_BESIDE}, ks AS (SELECT level, index FROM lx UNION SELECT level, index FROM rx UNION SELECT level, index FROM bs), sq AS ({_SQUARES}),
st AS (SELECT sq.level, sq.index, {_COVER} AS cover,
  coalesce(lx.status, CASE WHEN EXISTS (SELECT 1 FROM lp WHERE lp.level <= sq.level AND sq.index >> CAST(3 * greatest(sq.level - lp.level, 0) AS BIGINT) = lp.index) THEN 'Coarser' ELSE 'Missing' END) AS left_status,
  coalesce(rx.status, CASE WHEN EXISTS (SELECT 1 FROM rp WHERE rp.level <= sq.level AND sq.index >> CAST(3 * greatest(sq.level - rp.level, 0) AS BIGINT) = rp.index) THEN 'Coarser' ELSE 'Missing' END) AS right_status
  FROM sq LEFT JOIN lx ON sq.level = lx.level AND sq.index = lx.index LEFT JOIN rx ON sq.level = rx.level AND sq.index = rx.index),
ac AS (SELECT *, CASE WHEN cover = 'none' THEN CASE WHEN left_status = 'Missing' THEN 'Ignore' ELSE 'Left' END WHEN cover = 'all' THEN CASE WHEN right_status = 'Missing' THEN 'Ignore' ELSE 'Right' END
  WHEN left_status = 'Missing' AND right_status = 'Missing' THEN 'Ignore' WHEN left_status <> 'Virtual' AND right_status <> 'Virtual' THEN 'Merge' ELSE 'Recurse' END AS action FROM st)"""


@query("masked_traversal", f"{_MERGED} SELECT * FROM ac WHERE NOT EXISTS (SELECT 1 FROM ac p WHERE p.action <> 'Recurse' AND p.level < ac.level AND ac.index >> CAST(3 * greatest(ac.level - p.level, 0) AS BIGINT) = p.index)")
def _(spark, sf):
    left, right = fx.tree_pair(spark, sf)
    return masks.masked_merge(left, right, mask(spark), fx.UNIT)


def _content(leaves, level: int):
    """A square of half the cell's side in the middle of each leaf."""
    b = octree.cell_bounds(fx.UNIT, F.col("level"), F.col("index"))
    q = 2.0 / 2**level / 4
    return leaves.select("level", "index", F.col("index").alias("id"), _boxes(b[0] + q, b[1] + q, b[3] - q, b[4] - q, b[2] + q).alias("polygon"))


def _half(table: str, level: int) -> str:
    q = 2.0 / 2**level / 4
    return f"SELECT index AS id, lo_x + {q!r} AS lo_x, lo_y + {q!r} AS lo_y, hi_x - {q!r} AS hi_x, hi_y - {q!r} AS hi_y FROM (SELECT index, {_square(level)} FROM {table})"


@query("merge_masked", f"""{PT}, {fx.PAIR}, l AS ({_half('lp', 3)}), r AS ({_half('rp', 4)}), a AS (SELECT 'left' AS side, id, round((hi_x - lo_x) * (hi_y - lo_y) - {_IN}, 8) AS area FROM l UNION ALL SELECT 'right', id, round({_IN}, 8) FROM r) SELECT * FROM a WHERE area > 0""")
def _(spark, sf):
    left, right = fx.tree_pair(spark, sf)
    out = masks.merge_datasets(_content(left, 3), _content(right, 4), _square_mask(spark), fx.UNIT, 0.125)
    return out.groupBy("side", "id").agg(F.round(F.sum(g.polygon_area_2d(F.col("polygon"))), 8).alias("area")).filter("area > 0")


@query("mask_geojson", "SELECT * FROM (VALUES " + ", ".join(f"({c}, {r}, {o}, {i}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for c, r, o, pts in _RINGS for i, (x, y) in enumerate(pts)) + ") t(component, ring, is_outer, seq, x, y)")
def _(spark, sf):
    """The fixture's mask, written as nested GeoJSON and read back."""
    rings = {(c, r): [list(p) for p in [*pts, pts[0]]] for c, r, _, pts in _RINGS}
    text = json.dumps({"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, 0]}, {"type": "MultiPolygon", "coordinates": [[rings[0, 0], rings[0, 1]]]}]}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [rings[1, 0]]}}, {"type": "Feature", "geometry": None},
    ]})
    at = fresh_dir(spark, "geojson")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at)
    return shapes.read_mask(spark, at).select("component", "ring", "is_outer", "seq", "x", "y")
