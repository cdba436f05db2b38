"""Epsilon and nearest joins: how far rows are sent, and many rows in one ball."""

import numpy as np
from pyspark.sql import functions as F

from massif.operators import spatial


def points(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, x double, y double, z double")


def test_epsilon_join_sends_few_copies(spark):
    """Pairs as by brute force, on the borders of cells too; a row goes to five cells in the mean, not to 27."""
    rng = np.random.default_rng(1)
    at = np.concatenate([rng.uniform(-1, 1, (300, 3)), np.round(rng.uniform(-1, 1, (200, 3)) * 10) / 10, [[1e7, 0, 0], [1e7 + 0.1, 0, 0]]])
    p = points(spark, at)
    pairs = spatial.epsilon_join(p, p, 0.1)
    got = {(r.id, r.r_id) for r in pairs.select("id", "r_id").collect()}
    x = at[:, None, :] - at[None, :, :]
    d2 = x[..., 0] * x[..., 0] + x[..., 1] * x[..., 1] + x[..., 2] * x[..., 2]
    assert got == set(zip(*map(list, np.nonzero(d2 <= 0.1 * 0.1)), strict=True)) and len(got) == pairs.count()
    wide = points(spark, rng.uniform(-1, 1, (2000, 3)))
    sent = spatial.dealt(wide, 0.1, ("x", "y", "z"), "").count()
    assert sent < 6 * 2000


def test_nearest_in_growing_balls(spark):
    rng = np.random.default_rng(2)
    at = np.concatenate([rng.normal(0, 0.02, (900, 3)), rng.uniform(-1, 1, (100, 3)), np.zeros((200, 3)), [[0.2, 0, 0]]])
    p = points(spark, at)
    left, right = p.filter("id % 2 = 0"), p.filter("id % 2 = 1")
    got = {r.id: (r.near, r.d2) for r in spatial.nearest(left, right, 0.2).collect()}
    want = {}
    for i in range(0, len(at), 2):
        d = at[i] - at[1::2]
        d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        k = int(np.argmin(d2))
        if d2[k] < 0.2 * 0.2:
            want[i] = (2 * k + 1, d2[k])
    assert got == want


def test_nearest_compares_few_pairs(spark, monkeypatch):
    """Denser rows don't make more pairs for each."""
    seen, join = [], spatial.epsilon_join
    monkeypatch.setattr(spatial, "epsilon_join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
    p = points(spark, np.random.default_rng(3).uniform(0, 0.1, (3000, 3)))
    assert spatial.nearest(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 0.2).filter(F.col("near").isNotNull()).count() == 1500
    assert sum(d.count() for d in seen) < 1500 * 200
