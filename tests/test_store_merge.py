"""Merges of stores: what is linked and written, against the merge of tables; resuming, corrupt and missing content."""

import shutil

import pytest
from pyspark.sql import functions as F

from massif.functions import geometry as g
from massif.functions import octree
from massif.operators import masks
from massif.operators import store_merge as sm
from massif.sources import store

SPACE = octree.Space(0.0, 1.0)
RINGS = [(0, 0, True, [(0.1, 0.1), (0.6, 0.1), (0.6, 0.6), (0.1, 0.6)]), (0, 1, False, [(0.2, 0.2), (0.2, 0.3), (0.3, 0.3), (0.3, 0.2)]), (1, 0, True, [(0.7, 0.7), (0.9, 0.7), (0.8, 0.9)])]


def rings(spark):
    rows = [(c, r, o, i, x, y) for c, r, o, p in RINGS for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "component int, ring int, is_outer boolean, seq int, x double, y double")


def dataset(spark, level, every, offset):
    """Rectangles in every so-manieth cell of the lowest layer."""
    n = 2**level
    at = [F.col("i"), F.col("j"), F.lit(0).cast("long")]
    cells = spark.range(n * n).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"), "id").filter(F.col("id") % every == 0)
    s, q = 1 / n, 0.1 / n
    x, y = F.col("i") * s, F.col("j") * s
    polygon = F.array(*[g.point(x + a, y + b, F.lit(s / 8)) for a, b in ((q, q), (s - q, q), (s - q, s - q), (q, s - q))])
    return cells.select(F.lit(level).cast("long").alias("level"), octree.encode(*at).alias("index"), (F.col("id") * 2 + offset).alias("id"), polygon.alias("polygon"))


def areas(rows):
    area = F.sum(g.polygon_area_2d(F.col("polygon"))).alias("a")
    return {(r["level"], r["index"], r["id"]): round(r["a"], 9) for r in rows.groupBy("level", "index", "id").agg(area).collect() if r["a"] > 1e-12}


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("stores")
    left, right = dataset(spark, 2, 1, 0), dataset(spark, 3, 3, 1)
    sm.write_store(left, f"{d}/left")
    sm.write_store(right, f"{d}/right")
    return d, left, right


@pytest.fixture(scope="module")
def want(spark, pair):
    _, left, right = pair
    return areas(masks.merge_datasets(left, right, rings(spark), SPACE, 0.25))


def test_a_merge_stopped_in_a_part_goes_on_and_reads_back_as_the_merge_of_tables(spark, pair, want, monkeypatch):
    d, left, right = pair
    saved, done = sm._save, []

    def stops(rows, path):
        if "part=1" in path:
            raise RuntimeError("stopped")
        saved(rows, path)

    monkeypatch.setattr(sm, "_save", stops)
    args = (f"{d}/left", f"{d}/right", f"{d}/merged", rings(spark), SPACE, 0.25)
    with pytest.raises(RuntimeError):
        sm.merge_stores(spark, *args, nodes_per_part=30)
    (attempt,) = [a.removeprefix("file:") for a in store.attempts(spark, f"{d}/merged")]
    shutil.copytree(attempt, attempt.replace("merged", "other"))
    monkeypatch.setattr(sm, "_save", lambda rows, path: (done.append(path.removeprefix("file:")), saved(rows, path)))
    sm.merge_stores(spark, *args, nodes_per_part=30)
    assert all(p.startswith(attempt) for p in done) and any("part=1" in p for p in done) and not any(p.endswith(("part=0", "/plan")) for p in done)

    index = sm.read_index(spark, f"{d}/merged")
    assert areas(sm.read_content(spark, index)) == want
    homes = {(r["level"], r["index"]): r["home"].rsplit("/", 1)[1] for r in index.collect()}
    kept = {k for s in (left, right) for k in areas(s)}
    assert {h for h in homes.values()} == {"left", "right", "merged"}
    assert all((lv, ix) in homes for lv, ix, _ in want)
    for (lv, ix), home in homes.items():  # a linked node is a whole leaf of its home
        if home != "merged":
            assert {k for k in want if k[:2] == (lv, ix)} == {k for k in kept if k[:2] == (lv, ix) and k[2] % 2 == (home == "right")}
    own = spark.read.parquet(f"{d}/merged/nodes")
    assert own.select("level", "index").distinct().count() == sum(h == "merged" for h in homes.values()) and own.select("part").distinct().count() > 1
    sm.compact(spark, f"{d}/merged", f"{d}/compact")
    assert {r["home"].rsplit("/", 1)[1] for r in sm.read_index(spark, f"{d}/compact").select("home").distinct().collect()} == {"compact"}
    assert areas(sm.read_content(spark, sm.read_index(spark, f"{d}/compact"))) == want

    done.clear()  # the attempt at another mask, left beside this one's name, isn't used
    sm.merge_stores(spark, f"{d}/left", f"{d}/right", f"{d}/other", rings(spark).limit(0), SPACE, 0.25, nodes_per_part=30)
    assert any(p.endswith("/plan") for p in done) and not any(p.startswith(attempt.replace("merged", "other")) for p in done)
    assert {r["home"].rsplit("/", 1)[1] for r in sm.read_index(spark, f"{d}/other").collect()} == {"left"}
    assert areas(sm.read_content(spark, sm.read_index(spark, f"{d}/other"))) == areas(left)


def test_one_store_is_cut_inside_or_outside(spark, pair):
    d, left, _ = pair
    sm.merge_stores(spark, f"{d}/left", None, f"{d}/outside", rings(spark), SPACE, 0.25)
    sm.merge_stores(spark, None, f"{d}/left", f"{d}/inside", rings(spark), SPACE, 0.25)
    a, b = ({k: v for k, v in areas(sm.read_content(spark, sm.read_index(spark, f"{d}/{n}"))).items()} for n in ("outside", "inside"))
    whole = areas(left)
    assert {k: round(a.get(k, 0) + b.get(k, 0), 9) for k in whole} == pytest.approx(whole)
    assert abs(sum(b.values()) - sum(whole.values())) > 0.1 and set(a) | set(b) == set(whole)


def test_empty_stores_merge_to_an_empty_one(spark, pair):
    d, left, _ = pair
    sm.write_store(left.limit(0), f"{d}/nothing")
    sm.merge_stores(spark, f"{d}/nothing", None, f"{d}/nothing-merged", rings(spark), SPACE, 0.25)
    assert sm.read_index(spark, f"{d}/nothing-merged").isEmpty()


def test_content_without_its_hash_stops_the_reader(spark, pair):
    d, _, _ = pair
    index = sm.read_index(spark, f"{d}/left").limit(1)
    with pytest.raises(Exception, match="CorruptData"):
        sm.read_content(spark, index.withColumn("hash", F.col("hash") + 1)).collect()
    with pytest.raises(Exception, match="CorruptData"):
        sm.read_content(spark, index.withColumn("index", F.col("index") + 1000)).collect()


def test_a_store_holds_leaves_only(spark, tmp_path):
    both = dataset(spark, 1, 1, 0).unionByName(dataset(spark, 2, 1, 0))
    with pytest.raises(store.InvalidData):
        sm.write_store(both, f"{tmp_path}/nested")


def test_a_subtree_is_one_range(spark, pair):
    d, left, _ = pair
    got = {(r["level"], r["index"]) for r in sm.subtree(sm.read_index(spark, f"{d}/left"), 1, 0).collect()}
    assert got == {(r["level"], r["index"]) for r in left.filter(F.shiftright("index", 3) == 0).collect()}
