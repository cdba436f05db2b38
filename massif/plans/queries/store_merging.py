"""Queries of merges and cuts from store to store."""

from __future__ import annotations

from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.operators import store_merge
from massif.plans import fixtures as fx
from massif.plans.queries.cutting import _BESIDE, _IN, _IN0, _KEYS, PT, _content, _meets, _square, _square_mask
from massif.plans.registry import query
from massif.plans.shared import fresh_dir

_PER_PART = 256  # nodes a part: small, so that several parts are written from these tables


def _stores(spark, sf, folder: str) -> tuple[str, str]:
    """Squares in leaves on level 3 with even ids, and on level 4 with odd ones."""
    for name, leaves, level, odd in zip(("left", "right"), fx.tree_pair(spark, sf), (3, 4), (0, 1), strict=True):
        store_merge.write_store(_content(leaves, level).withColumn("id", F.col("id") * 2 + odd), f"{folder}/{name}")
    return f"{folder}/left", f"{folder}/right"


def _read_back(spark, path: str):
    """A row a leaf: where it is stored, and the area of what it has of each side."""
    index = store_merge.read_index(spark, path)
    area = g.polygon_area_2d(F.col("polygon"))
    sums = [F.round(F.sum(F.when(F.col("id") % 2 == odd, area).otherwise(0.0)), 8).alias(f"{n}_area") for odd, n in ((0, "left"), (1, "right"))]
    found = store_merge.read_content(spark, index).groupBy("level", "index").agg(*sums).filter("left_area > 0 or right_area > 0")
    home = F.regexp_extract("home", "[^/]+$", 0).alias("home")
    return found.join(index.select("level", "index", home), ["level", "index"])


_MEETS = _meets("lo_x", "lo_y", "hi_x", "hi_y", component=0)
_COVER = f"CASE WHEN {_MEETS} THEN 'part' WHEN {_IN0} THEN 'all' ELSE 'none' END"
_SQUARES = " UNION ALL ".join(f"SELECT level, index, {_square(lv)} FROM ks WHERE level = {lv}" for lv in range(5))
_Z = {3: fx.sql_coord("index", 2, 3), 4: fx.sql_coord("index", 2, 4)}


def _above(own: str) -> str:
    return f"EXISTS (SELECT 1 FROM {own} WHERE {own}.level <= sq.level AND sq.index >> CAST(3 * greatest(sq.level - {own}.level, 0) AS BIGINT) = {own}.index)"


def _side(own: str, level: int) -> str:
    """The middle square of each leaf with its own key."""
    q = 2.0 / 2**level / 4
    return f"SELECT level AS own_level, index AS own_index, lo_x + {q!r} AS lo_x, lo_y + {q!r} AS lo_y, hi_x - {q!r} AS hi_x, hi_y - {q!r} AS hi_y FROM (SELECT level, index, {_square(level)} FROM {own})"


def _oracle(keys: str) -> str:
    """Visited keys by status, cover and action; leaves taken whole, those clipped to a cell below them, those cut."""
    size = 2.0 / 2**4
    low = {a: f"(-1 + {fx.sql_coord('index', k, 4)} * {size!r}::DOUBLE)" for k, a in enumerate("xy")}
    cell = ", ".join(f"{low[a]} AS c_lo_{a}, {low[a]} + {size!r} AS c_hi_{a}" for a in "xy")
    return f"""{PT}, {keys}, {_BESIDE}, ks AS (SELECT level, index FROM lx UNION SELECT level, index FROM rx UNION SELECT level, index FROM bs), sq AS ({_SQUARES}),
st AS (SELECT sq.level, sq.index, {_COVER} AS cover, coalesce(lx.status, CASE WHEN {_above('lp')} THEN 'Coarser' ELSE 'Missing' END) AS l, coalesce(rx.status, CASE WHEN {_above('rp')} THEN 'Coarser' ELSE 'Missing' END) AS r
  FROM sq LEFT JOIN lx ON sq.level = lx.level AND sq.index = lx.index LEFT JOIN rx ON sq.level = rx.level AND sq.index = rx.index),
ac AS (SELECT *, CASE WHEN cover = 'none' THEN CASE WHEN l = 'Missing' THEN 'Ignore' ELSE 'Left' END WHEN cover = 'all' THEN CASE WHEN r = 'Missing' THEN 'Ignore' ELSE 'Right' END
  WHEN l = 'Missing' AND r = 'Missing' THEN 'Ignore' WHEN l <> 'Virtual' AND r <> 'Virtual' THEN 'Merge' ELSE 'Recurse' END AS action FROM st),
v AS (SELECT * FROM ac WHERE action <> 'Recurse' AND NOT EXISTS (SELECT 1 FROM ac p WHERE p.action <> 'Recurse' AND p.level < ac.level AND ac.index >> CAST(3 * greatest(ac.level - p.level, 0) AS BIGINT) = p.index)),
own AS (SELECT 'left' AS side, * FROM ({_side('lp', 3)}) UNION ALL SELECT 'right', * FROM ({_side('rp', 4)})),
linked AS (SELECT own_level AS level, own_index AS index, side, side AS home, (hi_x - lo_x) * (hi_y - lo_y) AS area FROM own JOIN v ON lower(v.action) = side AND v.level <= own_level AND own_index >> CAST(3 * greatest(own_level - v.level, 0) AS BIGINT) = v.index),
here AS (SELECT v.level, v.index, v.action, side, own.lo_x, own.lo_y, own.hi_x, own.hi_y, own_level FROM v JOIN own ON own_level <= v.level AND v.index >> CAST(3 * greatest(v.level - own_level, 0) AS BIGINT) = own_index WHERE v.action = 'Merge' OR lower(v.action) = side AND own_level < v.level),
cl AS (SELECT level, index, action, side, CASE WHEN own_level < level THEN greatest(lo_x, c_lo_x) ELSE lo_x END AS lo_x, CASE WHEN own_level < level THEN greatest(lo_y, c_lo_y) ELSE lo_y END AS lo_y,
  CASE WHEN own_level < level THEN least(hi_x, c_hi_x) ELSE hi_x END AS hi_x, CASE WHEN own_level < level THEN least(hi_y, c_hi_y) ELSE hi_y END AS hi_y
  FROM (SELECT *, {cell} FROM here) WHERE own_level = level OR {_Z[4]} % 2 = 0),
written AS (SELECT level, index, side, 'merged' AS home, CASE WHEN action <> 'Merge' THEN (hi_x - lo_x) * (hi_y - lo_y) WHEN side = 'right' THEN {_IN} ELSE (hi_x - lo_x) * (hi_y - lo_y) - {_IN} END AS area FROM cl)
SELECT level, index, home, round(sum(CASE WHEN side = 'left' THEN area ELSE 0.0 END), 8) + 0.0 AS left_area, round(sum(CASE WHEN side = 'right' THEN area ELSE 0.0 END), 8) + 0.0 AS right_area
FROM (SELECT * FROM linked UNION ALL SELECT * FROM written) GROUP BY 1, 2, 3 HAVING left_area > 0 OR right_area > 0"""


@query("merge_stores", _oracle(_KEYS))
def _(spark, sf):
    """Two stores merged inside and outside of a mask, with the store that each leaf is in."""
    folder = fresh_dir(spark, "merge-stores")
    left, right = _stores(spark, sf, folder)
    store_merge.merge_stores(spark, left, right, f"{folder}/merged", _square_mask(spark), fx.UNIT, 0.125, nodes_per_part=_PER_PART)
    return _read_back(spark, f"{folder}/merged")


def _cut_oracle(own: str, side: str, level: int) -> str:
    """Leaves on one level: whole where the mask doesn't meet their cell, else cut."""
    q = 2.0 / 2**level / 4
    whole = "(hi_x - lo_x) * (hi_y - lo_y)"
    kept, area = ("none", f"{whole} - {_IN}") if side == "left" else ("all", _IN)
    mine = f"round(CASE cover WHEN '{kept}' THEN {whole} WHEN 'part' THEN {area} ELSE 0.0 END, 8) + 0.0"
    areas = f"{mine} AS left_area, 0.0::DOUBLE AS right_area" if side == "left" else f"0.0::DOUBLE AS left_area, {mine} AS right_area"
    return f"""{PT}, {fx.PAIR}, sq AS (SELECT level, index, {_square(level)} FROM {own}), c AS (SELECT level, index, {_COVER} AS cover, lo_x + {q!r} AS lo_x, lo_y + {q!r} AS lo_y, hi_x - {q!r} AS hi_x, hi_y - {q!r} AS hi_y FROM sq)
SELECT level, index, CASE cover WHEN '{kept}' THEN '{side}' ELSE 'cut' END AS home, {areas} FROM c WHERE {mine} > 0"""


for _name, _side_cut, _own, _level in (("cut_store_outside", "left", "lp", 3), ("cut_store_inside", "right", "rp", 4)):
    def _cut(spark, sf, side=_side_cut):
        folder = fresh_dir(spark, "cut-store")
        left, right = _stores(spark, sf, folder)
        store_merge.merge_stores(spark, left if side == "left" else None, right if side == "right" else None, f"{folder}/cut", _square_mask(spark), fx.UNIT, 0.125, nodes_per_part=_PER_PART)
        return _read_back(spark, f"{folder}/cut")

    query(_name, _cut_oracle(_own, _side_cut, _level))(_cut)
