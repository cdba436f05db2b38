"""Packed binary output against a plain best fit, the library's ids and literal files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from massif.llm import binary_output as b

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(lengths, size):
    left, where = [], [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(c, -j) for j, c in enumerate(left) if c >= lengths[i]]
        if not fits:
            left.append(size)
            fits = [(size, -(len(left) - 1))]
        where[i] = -min(fits)[1]
        left[where[i]] -= lengths[i]
    return sorted(left)


@pytest.mark.parametrize("seed", range(5))
def test_bins_are_those_of_a_plain_best_fit(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    where, offset, n = b.best_fit_decreasing(lengths, 64)
    used = [[False] * 64 for _ in range(n)]
    for w, o, k in zip(where, offset, lengths, strict=True):
        assert not any(used[w][o : o + k])
        used[w][o : o + k] = [True] * k
    assert sorted(64 - sum(u) for u in used) == plain_best_fit(lengths, 64)
    assert all(not any(u[sum(u) :]) for u in used)


def test_tree_finds_the_smallest_capacity():
    tree = b.CapacityTree(10)
    assert tree.at_least(0) is None
    tree.add(3, 1), tree.add(10, 2)
    assert [tree.at_least(k) for k in (0, 3, 4, 10)] == [3, 3, 10, 10]
    tree.add(3, -1), tree.add(10, -2)
    assert tree.at_least(1) is None


def test_a_block_has_matrices_sums_and_resets():
    raw = [np.array(x, "<u4").tobytes() for x in ([7], [1, 2, 3], [4, 5])]
    arrays, where, offset = b.pack_block(raw, 4, 9, 2)
    assert arrays["ids"].tolist() == [[1, 2, 3, 7], [4, 5, 9, 9]] and arrays["positions"].tolist() == [[0, 1, 2, 0], [0, 1, 0, 0]]
    assert arrays["lengths"].tolist() == [0, 3, 4, 0, 2] and arrays["rows"].tolist() == [0, 3, 5] and (where, offset) == ([0, 0, 1], [3, 0, 0])
    with pytest.raises(ValueError, match="bytes"):
        b.pack_block([np.array([70000], "<u4").tobytes()], 4, 0, 2)


def test_round_trip_keeps_every_id(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [None, "", "héllo <|endoftext|> wörld", "a b " * 3000] + [" ".join(rng.choice(["alpha", "béta", "x1"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(2, texts[2], "again"), (None, "no id", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    manifest = b.write_packed(docs, str(tmp_path / "out"), PATH, block_bytes=30_000)
    assert manifest.count() % 5 == 0 and sorted(r.file for r in manifest.collect()) == sorted(p.name for p in (tmp_path / "out").iterdir() if p.name[0].isdigit())
    got = b.read_packed(spark, str(tmp_path / "out"), keep_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    whole = {}
    for r in sorted(got, key=lambda r: (r.id is None, r.id or 0, r.sequence_id, r.offset) if r.id == 2 else (r.id is None, r.id or 0, r.piece, 0)):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) <= 1024
        whole.setdefault(r.id, []).append(r)
    for i, text, _ in rows:
        want = tok.encode(text or "", add_special_tokens=False).ids + [2]
        if i == 2:
            assert [r.ids for r in whole[2]] == [want, want]
        else:
            assert sum((r.ids for r in whole[i]), []) == want and [r.start for r in whole[i]] == b.cuts(len(want), 1024)[:-1]
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 1024 and [o for o, _ in sorted(p)] == list(np.cumsum([0] + [n for _, n in sorted(p)])[:-1]) for p in places.values())


def test_an_empty_table_gives_no_segments(spark):
    assert b.packed_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).isEmpty()


def test_ids_may_be_text(spark):
    got = b.packed_round_trip(spark.createDataFrame([("k", "one two")], "doc_id string, text string"), PATH).collect()
    assert [(r.id, r.piece, r.offset) for r in got] == [("k", 0, 0)]


def test_sequences_follow_from_the_rows_alone(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i if i % 17 else None, " ".join(rng.choice(["alpha", "beta", "x1", "é"]) for _ in range(rng.randint(0, 700)))) for i in range(300)] + [(1000 + i, "copy of one text " * 60) for i in range(150)] + [(7, "same row")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (1, 16):
        got = b.packed_round_trip(docs.repartition(n, "text"), PATH, block_bytes=120_000).collect()
        found.append(sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset) for r in got))
    assert found[0] == found[1] and len({r[5] for r in found[0]}) <= -(-sum(r[3] for r in found[0]) // 1024) + 2 * 6


def test_equal_rows_that_fill_a_block_are_packed_in_parts(spark):
    docs = spark.createDataFrame([(1, "word " * 900)] * 60 + [(2, "other")], "doc_id long, text string")
    got = b.packed_round_trip(docs, PATH, block_bytes=20_000).collect()
    assert len(got) == 61 and len({r.sequence_id >> 28 for r in got}) > 2 and len({(r.sequence_id, r.offset) for r in got}) == 61


def test_ids_may_be_decimals(spark):
    got = b.packed_round_trip(spark.sql("SELECT CAST(1.50 AS DECIMAL(9, 2)) AS doc_id, 'one' AS text"), PATH).collect()
    assert [str(r.id) for r in got] == ["1.50"]
