"""Thresholds from all rows, boxes that many rows share, gaps in stored subtiles, powers by lookup."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.functions import texts
from massif.llm import language_id
from massif.operators import raster
from massif.sources import raster_store


def test_low_score_uses_all_documents(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("abcdefgh "), 20)), "en") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(docs.limit(200))
    scores = [s for p, s in (profiles.predict(t) for _, t, _ in rows) if p != "und"]
    assert language_id.low_score(docs, profiles, quantile=0.01) == pytest.approx(np.percentile(scores, 1), abs=1e-12)


def test_many_rows_in_one_box_are_compared_once(spark, monkeypatch):
    t = spark.range(3000).select("id", *[F.lit(v).alias(c) for c, v in (("lo_x", 0.0), ("lo_y", 0.0), ("hi_x", 0.75), ("hi_y", 0.25))])
    far = spark.createDataFrame([(-1, 5.0, 5.0, 5.5, 5.5)], t.schema)
    joined, join = [], type(t).join
    monkeypatch.setattr(type(t), "join", lambda self, *a, **k: joined.append(join(self, *a, **k)) or joined[-1])
    out = raster.not_known_empty(t.union(far), t, 0.05)
    assert {r.id for r in out.collect()} == set(range(3000)) and joined[0].count() < 10


def test_subtiles_with_gaps(spark):
    options = raster_store.Options(tile=8, subtile=4, zoom=0)
    for places in ([(0, 0)], [(3, 3)], [(1, 0), (2, 2)], [(x, y) for x in range(4) for y in range(4)]):
        p = spark.createDataFrame([(x, y, 10 * y + x) for x, y in places], "px long, py long, v long")
        row = raster_store.to_subtiles(p, options, 0).first()
        assert row["data"] == [10 * y + x if (x, y) in places else None for y in range(4) for x in range(4)]
    twice = spark.createDataFrame([(0, 0, 1), (0, 0, 2)], "px long, py long, v long")
    with pytest.raises(Exception, match="two values|duplicate"):
        raster_store.to_subtiles(twice, options, 0).collect()


def test_subtiles_are_placed_without_searching(spark):
    p = spark.range(16).select((F.col("id") % 4).alias("px"), F.floor(F.col("id") / 4).alias("py"), F.col("id").alias("v"))
    plan = raster_store.to_subtiles(p, raster_store.Options(tile=4, subtile=4), 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in plan.lower()


def test_powers(spark):
    d = spark.createDataFrame([(n,) for n in (-1, 0, 1, 2, 39, 40, 62, 63)], "n int").select("n", *[texts.integer_power(b, F.col("n")).alias(f"p{i}") for i, b in enumerate((3, -2, 1, -1, 0))])
    for r in d.collect():
        for i, b in enumerate((3, -2, 1, -1, 0)):
            want = b ** max(r.n, 0)
            assert r[f"p{i}"] == (want if -(1 << 63) <= want < 1 << 63 else None)
    assert "aggregate(" not in d._jdf.queryExecution().optimizedPlan().toString()
    n = spark.createDataFrame([(k,) for k in (-3, 0, 1, 2, 3, 5, 6, 7, 11, 12, 95, 96, (1 << 61) + 5)], "n long").select("n", texts.nearest_power_of_two(F.col("n")).alias("p"))
    for r in n.collect():
        low = 1 << r.n.bit_length() - 1 if r.n > 0 else None
        assert r.p == (None if low is None else low if r.n - low < 2 * low - r.n else 2 * low)


def test_saturating_without_exceptions(spark):
    top, low = (1 << 63) - 1, -(1 << 63)
    ends = [low, low + 1, -7, -1, 0, 1, 7, top - 1, top, None]
    d = spark.createDataFrame([(a, b) for a in ends for b in ends], "a long, b long")
    d = d.select("a", "b", texts.saturating_add(F.col("a"), F.col("b")).alias("s"), texts.saturating_subtract(F.col("a"), F.col("b")).alias("t"))
    for r in d.collect():
        for got, sign in ((r.s, 1), (r.t, -1)):
            assert got == (None if None in (r.a, r.b) else min(max(r.a + sign * r.b, low), top))
    assert "try_" not in d._jdf.queryExecution().optimizedPlan().toString()
