import random

import numpy as np
import pytest

import corpus_pipeline
from massif.llm import jaccard, simhash


def brute_components(texts):
    """Component label of each text, by exact Jaccard of all pairs of five-word sets."""
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                label = [label[i] if x == label[j] else x for x in label]
    return label


def edited(rng, words, n):
    words = list(words)
    for p in rng.sample(range(len(words)), n):
        words[p] = f"e{rng.randint(0, 10**9)}"
    return words


def corpus(seed):
    rng = random.Random(seed)
    out = []
    for f in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(3, 400))]
        out.append(" ".join(base))
        for _ in range(5):
            base = edited(rng, base, min(len(base), rng.randint(0, 1 + len(base) // 30)))
            out.append(" ".join(base).upper() if rng.random() < 0.2 else " ".join(base))
    hub = [f"h{i}" for i in range(300)]  # copies near the hub, hardly near each other
    out += [" ".join(hub)] + [" ".join(edited(rng, hub, 6)) for _ in range(80)] + [" ".join(edited(rng, hub, 16)) for _ in range(40)]
    return [*out, None, "", " ", "one two three four", "one two three four", "One two three four five"]


@pytest.mark.parametrize("cell", [(256, 512), (5, 7)])
def test_near_dedup_is_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", cell[0])
    monkeypatch.setattr(jaccard, "MANY", cell[1])
    texts = corpus(1)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    label = brute_components(texts)
    want = {min(i for i in range(len(texts)) if label[i] == x) for x in set(label)}
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted(want) and left.columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_groups_join_like_all_pairs():
    rng = random.Random(9)
    for _ in range(20):
        base = np.arange(60)
        sets = [np.unique(np.concatenate([base[rng.randint(0, 9) : rng.randint(48, 60)], rng.choices(range(100, 110), k=rng.randint(0, 6))])) for _ in range(25)]
        pairs = jaccard.links_across(sets, np.arange(25), 0.8)
        label, have = list(range(25)), list(range(25))
        for i in range(25):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if n / (len(sets[i]) + len(sets[j]) - n) >= 0.8:
                    label = [label[i] if x == label[j] else x for x in label]
        for i, j in pairs:
            have = [have[i] if x == have[j] else x for x in have]
        group = lambda x: {frozenset(k for k in range(25) if x[k] == v) for v in x}
        assert group(label) == group(have) and len(pairs) == 25 - len(set(have))


@pytest.mark.parametrize(("radius", "blocks", "wiped", "variants"), [(6, 4, 2, 198), (5, 2, 1, 66), (3, 4, None, 196), (3, 5, None, None), (4, 4, None, 2081)])
def test_variants_within_the_radius_meet(radius, blocks, wiped, variants):
    rng = random.Random(4)
    keep, flip = simhash.variant_masks(radius, blocks, wiped)
    assert variants in (None, len(keep))
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << j for j in rng.sample(range(64), rng.randint(0, radius)))
        keys = [set(((np.uint64(x) & keep) ^ flip).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def grouped(label, ids):
    return {frozenset(i for i in ids if label[i] == x) for x in label.values()}


def test_simhash_proposes_without_bands(spark):
    """Of the links at 0.8 those whose fingerprints SimHash links join, and no others, without MinHash."""
    texts = [t for t in corpus(2) if t and t.strip()]
    words = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    fps = [simhash.majority([jaccard.shingles(t)]) for t in texts]

    def join(near):
        label = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and near(i, j):
                    label = [label[i] if x == label[j] else x for x in label]
        return label

    ball = join(lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 6)
    alike = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    want = join(lambda i, j: ball[i] == ball[j] and alike(i, j))
    assert len(set(join(alike))) < len(set(want)) < len({frozenset(s) for s in sets})  # some links are beyond six bits, many are not
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component for r in jaccard.near_duplicates(docs, radius=6, wiped=2, bands=0).collect()}
    assert grouped(got, range(len(texts))) == grouped(dict(enumerate(want)), range(len(texts)))


def test_dense_cluster_gives_few_links(spark, monkeypatch):
    rng = random.Random(8)
    at = rng.getrandbits(63)
    flipped = lambda x, n: x ^ sum(1 << j for j in rng.sample(range(63), n))
    fps = sorted({at} | {flipped(at, rng.randint(1, 4)) for _ in range(500)} | {rng.getrandbits(63) for _ in range(100)})
    fps = sorted({*fps, *(flipped(x, rng.randint(4, 7)) for x in fps[::9])})
    label = {x: x for x in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 6 and label[a] != label[b]:
                label |= {x: label[a] for x in fps if label[x] == label[b]}
    given, connected_components = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links: given.append(links.count()) or connected_components(links))
    got = {x: x for x in fps} | {r.node: r.component for r in simhash.near_components(spark.createDataFrame([(x,) for x in fps], "fp long"), radius=6, blocks=4, wiped=2).collect()}
    assert grouped(got, fps) == grouped(label, fps) and len(set(label.values())) > 50
    assert max(given) < 8 * len(fps)


def test_stage_meets_in_the_middle(spark, monkeypatch):
    near_components, seen = simhash.near_components, []
    monkeypatch.setattr(simhash, "near_components", lambda fps, **how: seen.append((fps.count(), how["radius"])) or near_components(fps, **how))
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base), " ".join([*base[:-1], "x"]), "other words that are few", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3]
    assert seen == [(len({simhash.majority([jaccard.shingles(t)]) for t in texts if t}), 2)]


def test_unrelated_prints_do_not_meet_by_chance():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 64, 100_000, np.uint64, endpoint=False)
    keep, flip = simhash.variant_masks(jaccard.RADIUS, jaccard.BLOCKS, jaccard.WIPED)
    keys = ((prints[:, None] & keep) ^ flip).ravel()
    assert len(keep) == 65 and len(np.unique(keys)) == len(keys)  # no two prints share one of 6.5 million keys


@pytest.mark.parametrize("name", ["fp", "digest", "doc-id", "component_id"])
def test_ids_of_any_name(spark, name):
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, base, 1), (5, base + " x", 2), (7, "few other words", 3)], f"`{name}` long, `te xt` string, component long")
    for near in (simhash.near_duplicates, jaccard.near_duplicates):
        left = simhash.deduplicate(docs, id_col=name, text_col="te xt", near=near).collect()
        assert sorted((r[0], r[2]) for r in left) == [(3, 1), (7, 3)]
        found = near(docs, id_col=name, text_col="te xt")
        assert {name, "_id"} & set(found.columns) and found.count() == 3
