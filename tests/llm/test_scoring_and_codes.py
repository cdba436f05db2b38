"""Vector codes, filter audits and suffix trees against plain loops, and their edge cases."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from massif.llm import filter_audit, queries, suffix_tree, vector_codes

SF = "/root/testdata/sf0.001"


def plain_codes(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks by loops over Python integers; rows are (id, vector, label)."""
    kept = [(i, [math.floor(x * scale) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, q, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def near(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[near(c[p], books[p])[0]].append(c[p])
            for k, own in members.items():
                books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    by_label = Counter()
    for (_, _, label), f in zip(kept, found, strict=True):
        by_label[label] += sum(far for _, far in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for k, _ in f), sum(far for _, far in f), by_label[label]) for (i, _, label), f in zip(kept, found, strict=True)), digest


def told(df):
    return sorted((str(r["id"]), r["code"], r["error"], r["label_error"]) for r in df.collect())


def test_codes_equal_plain_loops(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    found, books = vector_codes.compress(table)
    want, digest = plain_codes(rows, 16, 64, 2, 256)
    assert told(found) == want and books.digest() == digest


def test_codes_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [0.5, -0.5], 1), (3, [0.25, 0.1], None), (3, [-0.3, 0.1], None), (3, [-0.3, 0.1], 1), (None, [9.0, 9.0], 2), (1, None, 1), (2, [None, 1.0], 1), (4, [nan, 1.0], 1), (6, [1.0, -inf], 1)]
    kind = "vec_id long, embedding array<double>, label int, code string, error int"
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], kind)
    want, digest = plain_codes(rows, 2, 3, 2, 256)
    found, books = vector_codes.compress(table, parts=2, entries=3)
    assert told(found) == want and books.digest() == digest and len(want) == 5
    other = table.union(spark.createDataFrame([(7, [1.0, 1.0, 1.0, 1.0], 1, "x", 7), (8, [1.0], 1, "x", 7), (9, [], 1, "x", 7)], kind))
    assert told(vector_codes.compress(other, parts=2, entries=3)[0]) == want  # of another length than most
    none, empty = vector_codes.compress(table.limit(0), parts=2, entries=3)
    assert none.count() == 0 and empty.entries.size == 0
    assert vector_codes.compress(table, parts=2, label_col=None)[0].count() == 5


def test_codes_do_not_depend_on_blocks_and_refuse_overflow(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    kept = vector_codes.quantised(table.repartition(5), id_col="vec_id", vector_col="embedding", label_col="label", parts=2, scale=256)
    books = vector_codes.first_entries(kept, parts=2, entries=16)
    one = vector_codes.learn_round(kept, books, block_rows=7, depth=3)
    assert (one == vector_codes.learn_round(kept.coalesce(1), books)).all()
    far = spark.createDataFrame([(1, [1e30, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="after scaling"):
        vector_codes.compress(far, parts=2)[0].collect()


def plain_audit(rows, labels):
    """The audit by applying each order to each document; rows are (id, text, part)."""
    import re

    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failing = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        failing.append((part or "", {k for k, v in fails.items() if v}, i))
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {p for p, _, _ in failing}:
            for step, own in enumerate(order, 1):
                c = Counter()
                for p, f, i in failing:
                    if p != part:
                        continue
                    gone, hit = bool(f & set(order[: step - 1])), own in f
                    c["kept"] += not gone and not hit
                    c["removed"] += hit and not gone
                    c["redundant"] += hit and gone
                    c["unique"] += f == {own}
                    c["good"] += hit and not gone and i in good
                    c["toxic"] += hit and not gone and i in toxic
                shapley[part, own] += c["removed"]
                out[part, "".join(order), step] = [c[k] for k in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_equals_plain_loops(spark):
    plain = " ".join(f"w{i}" for i in range(60))
    many = "same " * 60
    long = "x" * 400 + " " + " ".join(f"v{i}" for i in range(3000))
    texts = [plain, plain, plain.upper(), many, many + "#", None, "", "few", long, long[:-1] + "9", long, "é" * 300, "é" * 299 + "è", "É " * 60 + "|", plain]
    rows = [(i if i != 9 else None, t, ("a", "b", None, "")[i % 4]) for i, t in enumerate(texts)] + [(1, plain, "a"), (None, plain, "a"), (20, long, "b"), (21, None, "b")]
    labels = [(i, i % 2, (i + 1) % 3 == 0) for i in range(22)] + [(4, 1, 1), (None, 1, 1), (4, None, None)]
    labels = [(i, q if q is None else int(q), x if x is None else int(x)) for i, q, x in labels]
    docs = spark.createDataFrame([(*r, 1, "m") for r in rows], "doc_id long, text string, source string, mask int, part string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(filter_audit.audit_documents(docs, table)) == plain_audit(rows, labels)
    assert filter_audit.audit_documents(docs.limit(0), table).count() == 0
    assert sum(v[1] for v in audited(filter_audit.audit_documents(docs, table.limit(0))).values()) == sum(v[1] for v in plain_audit(rows, labels).values())


def test_texts_that_only_hash_alike_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, "two"), (5, "six")], "doc_id long, text string")
    alike = docs.select(F.col("doc_id").alias("_id"), F.lit("").alias("part"), F.lit(0).alias("mask"), F.lit(3).cast("long").alias("length"), F.encode("text", "utf-8").alias("digest"), F.array(F.lit(9).cast("long")).alias("blocks"))
    assert sorted(r["_id"] for r in filter_audit.later_copies(docs, alike).collect()) == [3, 4]


def test_block_hashes_cover_whole_texts():
    text = bytes(i % 251 for i in range(100_000))
    base = filter_audit.block_hashes(text)
    assert len(base) == 4 and filter_audit.block_hashes(b"") == []
    for at in (0, 255, 256, 20_000, 99_999):
        changed = bytearray(text)
        changed[at] ^= 1
        assert filter_audit.block_hashes(bytes(changed)) != base
    assert filter_audit.word_counts(b"a b a\n" * 1_000_000) == (3_000_000, 2)


def plain_tree(texts, share, depth, pull):
    """Chances after states by dictionaries; `texts` are lists of tokens, the end token included."""
    counts = [Counter() for _ in range(depth + 1)]
    for w in texts:
        for n in range(1, depth + 2):
            counts[n - 1].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, distinct = sum(counts[0].values()), len(counts[0])
    least = max(2.0, share * total)
    often = [{g: c for g, c in level.items() if c >= least} for level in counts]

    def word(a):
        return (counts[0][(a,)] + 1) / (total + distinct + 1)

    chance = {g: word(g[0]) for g in often[0]}
    left, stays = {}, set()
    for n in range(1, depth + 1):
        contexts = defaultdict(list)
        for g in often[n]:
            contexts[g[:-1]].append(g)
        for s, grams in contexts.items():
            c, k = often[n - 1][s], sum(often[n][g] for g in grams)
            under = {g: chance[g[1:]] for g in grams}
            gain = sum(often[n][g] * math.log(often[n][g] / c / under[g]) for g in grams)
            if c > k:
                gain += (c - k) * math.log((c - k) / c / max(1 - sum(under.values()), 1e-12))
            left[s] = (c - k + pull) / (c + pull)
            for g in grams:
                chance[g] = often[n][g] / (c + pull) + left[s] * under[g]
            if gain > 0.5 * (len(grams) + 1) * math.log(max(c, 2)):
                stays |= {s[i:] for i in range(len(s))}

    def after(past, a):
        for s in (past[i:] for i in range(len(past))):
            if s in stays:
                g = (*s, a)
                return chance[g] if g in chance else left[s] * after(s[1:], a)
        return word(a)

    return after, word, counts[0], stays


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_suffix_tree_equals_dictionaries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    train = docs.filter(~suffix_tree.held_out())
    share, depth, pull = 2.0**-11, 3, 8.0
    tree, counts = suffix_tree.learn(train.select("text"), share=share, depth=depth, pull=pull)
    after, word, seen, stays = plain_tree([tokens(r["text"]) for r in train.collect()], share, depth, pull)
    assert sum(len(s.keys) for s in tree.states) == len(stays) and len(stays) > 20 and max(map(len, stays)) > 1
    scored = {r["id"]: r for r in suffix_tree.score(docs, tree, counts).collect()}
    for r in docs.collect():
        w = tokens(r["text"])
        want = sum(math.log10(after(tuple(w[max(0, i - depth) : i]), a)) for i, a in enumerate(w))
        got = scored[r["doc_id"]]
        assert got["score"] == pytest.approx(want, abs=1e-6) and got["base_score"] == pytest.approx(sum(math.log10(word(a)) for a in w), abs=1e-6)
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(w), sum((a,) in seen for a in w), sum(seen.values()))
    some = max(stays, key=len)
    assert sum(after(some, a) for (a,) in seen) + after(some, b"a word that training lacks") == pytest.approx(1)


def test_suffix_tree_predicts_held_out_texts_better_than_frequencies(spark):
    rows = queries.op13_suffix_tree(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert rows[0] > rows[1] + 0.1 * rows[2]


def test_suffix_tree_of_odd_texts(spark):
    rows = [(1, "a b a b a b"), (2, None), (3, ""), (4, "A B\ta\nb"), (None, "a b z"), (1, "a b a b a b"), (5, "é É a b")] + [(i, "a b a b a b c") for i in range(10, 40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "key long, text string, score string")
    tree, counts = suffix_tree.learn(docs.select("text"))
    found = suffix_tree.score(docs, tree, counts, id_col="key").collect()
    assert len(found) == len(rows) and sorted((r["id"] or 0, r["n_tokens"]) for r in found) == sorted((i or 0, len(tokens(t))) for i, t in rows)
    assert all(r["n_known"] == r["n_tokens"] and r["score"] < 0 for r in found)
    none, zero = suffix_tree.learn(docs.limit(0).select("text"))
    blind = suffix_tree.score(docs, none, zero, id_col="key").collect()
    assert len(blind) == len(rows) and all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in blind)
    assert suffix_tree.score(docs.limit(0), tree, counts, id_col="key").count() == 0


def test_long_texts_keep_their_context_between_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in rng.integers(0, 30, 5000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([text, None, text[:50]])], ["text"])

    def grams():
        out = Counter()
        for _, block in suffix_tree.blocks([batch], 3):
            for gram, whole in block.grams(3):
                for row, key in zip(block.rows[block.own & whole], gram[block.own & whole], strict=True):
                    out[int(row), int(key)] += 1
        return out

    whole = grams()
    monkeypatch.setattr(suffix_tree, "_STRETCH", 700)
    monkeypatch.setattr(suffix_tree, "BLOCK_TOKENS", 999)
    assert grams() == whole and sum(whole.values()) > 20_000
