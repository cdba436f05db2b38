import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from massif.llm import packing, token_counts
from massif.llm.tokens import TextEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_gives_the_library_s_ids(library):
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "<|endoftext|>", "é", "\xa0", "\x1c", " ", ".", "日", "'", "\r", " the", "\x00", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 15))) for _ in range(5000)] + [None, "", "x" * 50000]
    enc = TextEncoder(PATH)
    assert enc.ranked is not None
    for t, got in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_long_white_space_gives_the_library_s_ids(library):
    texts = [" " * 2_000_000, "a" + "\n" * 2_000_000 + "b", "x " * 60_000 + "\xa0\t" * 600_000, "\x85" * 99_999 + "a" + " " * 99_999, " " * 100_000]
    for t, got in zip(texts, TextEncoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_tokenizers_use_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = TextEncoder(path)
    assert enc.ranked is None
    assert np.frombuffer(enc.encode(["Hello  World"])[0], "<u4").tolist() == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


DOCS = [(1, "one two"), (2, None), (3, ""), (4, "lorem ipsum " * 1500), (4, "lorem ipsum " * 1500), (None, "zz"), (7, "a <|endoftext|> b"), *[(100 + i, "word " * (i % 40)) for i in range(300)]]


def test_pieces_and_places(spark, library):
    docs = spark.createDataFrame([(d, t, "x", 9) for d, t in DOCS], "doc_id long, text string, piece string, offset int")
    got = packing.pack_documents(docs, PATH, keep_ids=True).collect()
    assert sum(r.length for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in DOCS)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 1024
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4)
    assert len(long) % 2 == 0 and all(n == 1024 for p, _, n in long if p)
    whole = [i for r in sorted((r for r in got if r.doc_id == 7), key=lambda r: r.piece) for i in r.ids]
    assert whole == library.encode("a <|endoftext|> b", add_special_tokens=False).ids + [2]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = random.Random(2)
    hist = {n: rng.randint(1, 9) for n in rng.sample(range(1, 101), 60)}
    cap = packing.Capacity(tokens=100, documents=3, attention=6000 if rule == "dot" else 10000, rule=rule)
    if rule == "dot":
        hist = {n: k for n, k in hist.items() if n * n <= 6000}
    seen, load = {}, {}
    for length, rank, count, first, offset in packing.plan_bins(hist, cap):
        seen.setdefault(length, []).extend(range(rank, rank + count))
        for b in range(first, first + count):
            t, d, a = load.get(b, (0, 0, 0))
            assert offset == t
            load[b] = (t + length, d + 1, a + length * length)
    assert all(sorted(v) == list(range(hist[k])) for k, v in seen.items()) and set(seen) == set(hist)
    assert all(t <= cap.tokens and d <= cap.documents and a <= cap.attention for t, d, a in load.values())


def plain_vector_best_fit(lengths, cap):
    """Residuals of all bins, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        ask = np.array([n, 1, n * n])
        fits = [i for i, b in enumerate(bins) if all(x >= y for x, y in zip(b, ask, strict=True))]
        if fits:
            scores = cap.scores(np.array([bins[i] for i in fits], float), ask).tolist()
            at = min(zip(scores, [bins[i] for i in fits], fits, strict=True))[2]
        else:
            bins.append((cap.tokens, cap.documents, cap.attention))
            at = len(bins) - 1
        bins[at] = tuple(int(x - y) for x, y in zip(bins[at], ask, strict=True))
    return sorted(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("seed", range(6))
def test_plans_are_those_of_a_plain_vector_best_fit(rule, seed):
    rng = random.Random(seed)
    caps = [packing.Capacity(tokens=64, rule=rule), packing.Capacity(tokens=64, documents=4, attention=1500, weights=(1.0, 0.5, 2.0), rule=rule), packing.Capacity(tokens=64, documents=2, attention=4096, weights=(1.0, 1.0, 0.3), rule=rule)]
    for cap in caps:
        lengths = [min(rng.choice([rng.randint(1, 60), rng.randint(1, 9), 7, 16]), int(cap.attention**0.5)) for _ in range(rng.randint(1, 250))]
        hist = {n: lengths.count(n) for n in set(lengths)}
        left, seen = {}, {}
        for length, rank, count, first, offset in packing.plan_bins(hist, cap):
            seen.setdefault(length, []).extend(range(rank, rank + count))
            for b in range(first, first + count):
                t, d, a = left.get(b, (cap.tokens, cap.documents, cap.attention))
                assert offset == cap.tokens - t
                left[b] = (t - length, d - 1, a - length * length)
        assert all(sorted(v) == list(range(hist[k])) for k, v in seen.items()) and set(seen) == set(hist)
        assert sorted(left.values()) == plain_vector_best_fit(lengths, cap)


def test_many_rows_of_one_length_are_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 3)
    pieces = spark.range(9001).selectExpr("id % 4000 as doc_id", "0 as piece", "cast(if(id % 10 < 8, 1024, id % 7 + 1) as long) as length", "id as ids_crc32")
    got = packing.pack(pieces).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len(got) == 9001 and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 1024)


def test_counts_encode_distinct_misses_once(spark, library, tmp_path):
    docs = spark.createDataFrame([(d, t, 5) for d, t in DOCS], "doc_id long, text string, n_tokens int")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts.count_tokens(docs, PATH, cache)
        assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "cached"] and got.count() == len(DOCS)
        assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode()) for r in got.collect())
        assert token_counts.read_cache(spark, cache).count() == len({t or "" for _, t in DOCS})
    assert token_counts.count_tokens(docs.limit(0), PATH, str(tmp_path / "empty")).count() == 0


def test_only_misses_are_encoded_and_names_may_clash(spark, library, tmp_path):
    rows = [(d, t, f"n{i}", i) for i, (d, t) in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n string, _0 int").withColumn("cached", F.lit("old")).withColumn("d", F.lit("d"))
    cache = str(tmp_path / "cache")
    early = docs.filter("doc_id < 130")
    first = {r.content_digest for r in token_counts.warm(early, PATH, cache).collect()}
    got = token_counts.count_tokens(docs, PATH, cache)
    assert got.columns == ["doc_id", "text", "_n", "_0", "d", "n_bytes", "n_tokens", "cached"]
    seen = {t or "" for d, t in DOCS if d is not None and d < 130}
    found = got.collect()
    assert sorted((str(r.doc_id), str(r.text), r._n) for r in found) == sorted((str(d), str(t), n) for d, t, n, _ in rows)
    assert all(r.cached == ((r.text or "") in seen) and r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in found)
    every = [r.content_digest for r in token_counts.read_cache(spark, cache).collect()]
    assert len(every) == len(set(every)) == len({t or "" for _, t in DOCS}) and len(first) == len(seen)  # none was encoded twice
    other = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache)
    assert not any(r.cached for r in other.collect())  # another tokenizer's counts are no hits
