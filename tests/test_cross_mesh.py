"""Points mapped to earlier meshes, against all pairs."""

import random

from massif.operators import merge, spatial

KIND = "mesh int, id long, x double, y double, z double"


def brute(rows, eps):
    out = {}
    for m, i, *p in rows:
        near = [(sum((a - b) * (a - b) for a, b in zip(p, q, strict=True)), n, j) for n, j, *q in rows if None not in (m, n, *p, *q) and n < m]
        near = [t for t in near if t[0] <= eps * eps]
        if near:
            out[m, i] = min(near)[1:]
    return out


def told(spark, rows, eps):
    found = merge.cross_mesh_mapping(spark.createDataFrame(rows, KIND), eps).collect()
    out = {(r.mesh, r.id): (r.to_mesh, r.to_id) for r in found}
    assert len(out) == len(found)
    return out


def test_mapping_as_all_pairs_have_it(spark):
    rng = random.Random(3)  # small numbers: ties, repeated positions and distances of just eps are common
    rows = [(rng.randrange(5), i, *(rng.randrange(9) / 8 for _ in range(3))) for i in range(250)]
    rows += [(rng.randrange(1, 4), 300 + i, *(rng.gauss(0, 0.1) for _ in range(3))) for i in range(150)]
    rows += [(4, 900, 9.0, 9.0, 9.0), (0, 901, 5.0, 5.0, 5.0), (3, 902, 5.0, 5.0, 5.25), (2, 903, 5.0, 5.0, 5.25), (3, 904, None, 0.0, 0.0), (None, 905, 0.0, 0.0, 0.0)]
    assert told(spark, rows, 0.25) == brute(rows, 0.25)
    assert told(spark, rows[-6:-4], 0.25) == {} and told(spark, [(1, 1, 0.0, 0.0, 0.0)], 0.25) == {}


def test_pairs_do_not_grow_with_density(spark, monkeypatch):
    pairs, join = [], spatial.epsilon_join
    monkeypatch.setattr(spatial, "epsilon_join", lambda *a: pairs.append(join(*a)) or pairs[-1])
    rng = random.Random(4)
    rows = [(i % 3, i, *(rng.uniform(-0.08, 0.08) for _ in range(3))) for i in range(3000)]
    assert len(told(spark, rows, 0.1)) == 2000  # all but those of the first mesh
    assert sum(p.count() for p in pairs) < 30 * len(rows)  # all pairs: a thousand times as many as points
