"""Components of long chains, put together in few steps."""

import random

import pytest
from pyspark.sql import functions as F

from massif.operators import components, solids


def named(df):
    found = [(repr(r.node).replace("-0.0", "0.0"), repr(r.component).replace("-0.0", "0.0")) for r in df.collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


@pytest.mark.parametrize("links", [64, components.LINKS])
def test_chains_by_ranges_and_in_one_task_as_in_rounds(spark, monkeypatch, links):
    monkeypatch.setattr(components, "LINKS", links)
    rng = random.Random(links)
    e = spark.createDataFrame([(k, k + (k % 53 > 0)) for k in range(300)] + [(rng.randrange(900), rng.randrange(900)) for _ in range(60)] + [(5, None)], "u long, v long")
    for node in (F.col, lambda c: F.struct(F.lit(1).alias("plane"), F.struct((F.col(c) / 3 - 20).alias("x")).alias("p")), lambda c: F.concat(F.lit("n"), F.col(c))):
        of = e.dropna().select(*[node(c).alias(c) for c in "uv"])
        assert named(components.chained_components(of)) == named(components.connected_components(of))
    odd = spark.createDataFrame([((0.0, None), (-0.0, "a")), ((float("nan"), "b"), (0.0, None)), ((5.0, "x"), None), ((7.0, "é"), (7.0, "z"))], "u struct<a:double,b:string>, v struct<a:double,b:string>")
    assert named(components.chained_components(odd)) == named(components.connected_components(odd))


def test_steps_do_not_grow_with_the_chain(spark, monkeypatch):
    """Each stored step is planned by the driver: in rounds a ring of 5000 sides takes over ten."""
    stored, stash = [], components.stash
    for module in (components, solids):
        monkeypatch.setattr(module, "stash", lambda df, name: stored.append(name) or stash(df, name))
    n = 5000
    ring = spark.range(n).select(F.lit(1).alias("plane"), *[F.struct(F.cos(k * 2 * 3.141592653589793 / n).alias("x"), F.sin(k * 2 * 3.141592653589793 / n).alias("y")).alias(c) for c, k in (("p", F.col("id")), ("q", (F.col("id") + 1) % n))])
    assert solids._grouped(ring, "x", "y").select("group").distinct().count() == 1
    assert len(stored) <= 4
