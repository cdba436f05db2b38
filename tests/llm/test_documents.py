import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from massif.llm import decontaminate, language_id, line_quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts], SCHEMA)


# Decontamination


def brute_scan(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    w, hit, found = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for n in [min(window, len(v))] if v else []:
            for g in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}:
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == g:
                        hit |= set(range(p, p + n))
                        found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_scan_is_brute_force(spark, block):
    rng = random.Random(4)
    vocab = ["aa", "b1", "cé", "dd", "Ee", "zz"]
    items = [(i, " ".join(rng.choice(vocab[:5]) for _ in range(n))) for i, n in enumerate([12, 30, 10, 3, 1, 0, 15])] + [(7, None), (2, "aa, bb; aa"), (8, "qq " * 14)]
    texts = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))) for k in range(60)]
    texts += [(90, None), (91, ""), (92, "x" + items[1][1].upper() + " tail " + items[1][1]), (92, items[0][1].replace(" ", "--")), (None, items[2][1]), (93, "qq " * 300)]
    docs = frame(spark, texts).withColumnRenamed("n_chars", "hit")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = decontaminate.scan(docs, bench, block_bytes=block)
    rows = got.collect()
    assert len(rows) == len(texts) and "hit" in got.columns
    want = sorted(str((i, *brute_scan(t, items))) for i, t in texts)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, list(r.items))) for r in rows) == want


def test_clean_documents_stay(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [(1, "nothing here"), (2, f"so {item} it is"), (3, None)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 3 and decontaminate.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_texts_of_one_id_are_one_item(spark, block):
    a, b, c = (" ".join(f"{x}{i}" for i in range(12)) for x in "abc")
    bench = spark.createDataFrame([(7, a), (7, b), (8, c)], "item_id long, text string")
    docs = frame(spark, [(1, f"{b} and {a}"), (2, f"{c} {a} {b}"), (3, "none")])
    got = {r.doc_id: (r.n_items, list(r.items), r.n_hit) for r in decontaminate.scan(docs, bench, block_bytes=block).collect()}
    assert got == {1: (1, ["7"], 24), 2: (2, ["7", "8"], 36), 3: (0, [], 0)}


def brute_longest(text, items, window=10):
    """(words, start, item, item word) of the longest match of a window or more, by comparing at every two places."""
    w, best = brute_words(text), (0, None, None, None)
    for i, t in items:
        v = brute_words(t)
        for b in range(len(v)):
            for a in range(len(w)):
                n = 0
                while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                    n += 1
                if n >= min(window, len(v)) and n and (best[0] == 0 or (-n, a, str(i), b) < (-best[0], *best[1:])):
                    best = (n, a, str(i), b)
    return best


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_longest_matches_of_documents_are_brute_force(spark, block):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(n))) for i, n in enumerate([14, 40, 11, 3, 25])] + [(1, "a b c d " * 6), (6, None)]
    texts = [(k, " ".join(rng.choice("abcdz") for _ in range(rng.randint(0, 120)))) for k in range(40)]
    texts += [(50, "z " + items[1][1] + " " + items[4][1]), (50, items[0][1]), (None, items[1][1] + " z"), (51, None)]
    docs = frame(spark, texts).withColumnRenamed("n_chars", "longest_start")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(docs, bench, block_bytes=block).collect()
    want = sorted(str((i, *brute_longest(t, items))) for i, t in texts)
    assert sorted(str((r.doc_id, *(r[c] for c in decontaminate.LONGEST))) for r in got) == want


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_longest_match_and_place(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 30)  # several shards
    item = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [(1, "a b " + item + " c"), (2, " ".join(f"w{i}" for i in range(5, 18))), (3, "x " + item), (4, None)]).repartition(3)
    bench = spark.createDataFrame([(4, item), (5, " ".join(f"v{i}" for i in range(20)))], "item_id long, text string")
    best = {}
    for r in decontaminate.longest_matches(docs, bench, block_bytes=block).collect():
        assert r.item == "4"
        best.setdefault(r.item_word, set()).add((r.doc_id, r.start_word, r.n_words))
    assert best == {k: {(1, 2 + k, 20 - k), (3, 1 + k, 20 - k)} if k else {(1, 2, 20), (3, 1, 20)} for k in range(11)}
    assert decontaminate.longest_matches(docs.limit(0), bench).count() == 0 and decontaminate.longest_matches(docs, bench.limit(0)).count() == 0


# Quality rules


def brute_figures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_figures_are_brute_force(spark):
    rng = random.Random(8)
    texts = [(i, "".join(rng.choice(["a ", "b ", "a b c ", "é\t", "\n", "# ", "\x0b", "  ", "\xa0", "c"]) for _ in range(rng.randint(0, 90)))) for i in range(80)] + [(99, None), (98, ""), (97, "x y " * 20000)]
    got = line_quality.judge(frame(spark, texts))
    by = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect()}
    assert all(by[i] == brute_figures(t) for i, t in texts if i != 97) and by[97] == (40000, 40000, 0, 0, 40000)


def test_common_lines_go_and_depleted_documents_fail(spark):
    boiler = "this very line is on every page of the site for all to see"
    own = lambda i: " ".join(f"t{i}w{k}" for k in range(60))
    texts = [(i, f"{boiler}\n{own(i)}") for i in range(30)] + [(50, "\n".join([boiler] * 8)), (51, own(51))]
    copies = [(60 + i, own(60)) for i in range(40)]
    docs = frame(spark, texts + copies).withColumnRenamed("lang", "kept")
    got = {r.doc_id: r for r in line_quality.judge(docs).collect()}
    assert not got[50].kept and got[0].kept and got[51].kept and got[0].n_removed_words == len(boiler.split())
    assert all(got[60 + i].kept and got[60 + i].n_removed_words == 0 for i in range(40))
    clean = line_quality.clean(frame(spark, texts))
    by = {r.doc_id: r for r in clean.collect()}
    assert by[3].text == own(3) and by[3].n_chars == len(own(3)) and by[51].text == own(51) and 50 not in by
    assert clean.columns == docs.withColumnRenamed("kept", "lang").columns and line_quality.judge(docs.limit(0)).count() == 0


def test_copies_count_as_documents_on_request(spark):
    boiler, own = "a line that only copies of one text have", " ".join(f"w{k}" for k in range(60))
    docs = frame(spark, [(i, f"{boiler}\n{own}") for i in range(25)] + [(100 + i, " ".join(f"t{i}w{k}" for k in range(60))) for i in range(30)])
    for count_copies, few in ((False, 0), (True, 0), (True, 1 << 18)):
        got = {r.doc_id: r for r in line_quality.judge(docs, count_copies=count_copies, few_texts=few).collect()}
        assert all(got[i].n_removed_words == (69 if count_copies else 0) and got[i].kept != count_copies for i in range(25))
        assert all(got[100 + i].kept for i in range(30))


def test_names_may_clash_and_hosts_be_missing(spark):
    words = " ".join(f"w{k}" for k in range(60))
    docs = frame(spark, [(1, words), (1, words), (2, None)]).withColumns({c: F.lit(c) for c in ("_f", "_host", "_content", "_0", "_h", "_row", "c0", "removed_lines")})
    got = line_quality.judge(docs)
    assert got.columns[:12] == [c for c in docs.columns if c != "removed_lines"] and sorted((r.doc_id, r._f, r._0, r.kept) for r in got.collect()) == [(1, "_f", "_0", True)] * 2 + [(2, "_f", "_0", False)]
    left = line_quality.clean(docs.drop("source"))
    assert left.columns == docs.drop("source").columns and sorted((r.doc_id, r.text, r._row, r.removed_lines) for r in left.collect()) == [(1, words, "_row", "removed_lines")] * 2


def test_null_host(spark):
    docs = spark.createDataFrame([(1, "a " * 60, None), (1, "a b", None)], "doc_id long, text string, source string")
    assert line_quality.judge(docs).count() == 2


# Language


LANGS = {"en": "the quick brown fox jumps over the lazy dog and then the fox", "de": "der schnelle braune Fuchs springt über den faulen Hund und läuft", "fr": "le renard brun rapide saute par dessus le chien paresseux été"}


def test_held_out_documents_are_told(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(rng.choices(LANGS[lang].split(), k=30)), lang, "s", 0))
    rows += [(900, None, "en", "s", 0), (901, "123 #!", "en", "s", 0), (902, "der Hund", None, "s", 0), (902, "der Hund", None, "s", 0), (None, "the fox", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "score")
    profiles = language_id.learn(docs.filter(~language_id.held_out()))
    got = language_id.identify(docs, profiles)
    found = got.collect()
    told = [r for r in found if r.doc_id is not None and r.doc_id < 150]
    assert len(told) == 150 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in told)
    assert {r.lang_pred for r in found if r.doc_id in (900, 901)} == {"und"} and [r.lang_pred for r in found if r.doc_id == 902] == ["de", "de"]
    empty = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty, keep=["doc_id"]).collect()} == {"und"}


def brute_grams(text, top):
    """The most frequent n-grams in order, ties by their characters."""
    counts = {}
    plain = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    for word in plain.split(" "):
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if word and g != " ":
                    counts[g] = counts.get(g, 0) + 1
    return counts


def brute_ranked(counts, top):
    def code(g):  # shorter n-grams first
        return [0] * (3 - len(g)) + list(map(ord, g))

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def brute_predict(text, profiles, top):
    grams = brute_ranked(brute_grams(text, top), top)
    if not any(unicodedata.category(c)[0] == "L" for c in (text or "").lower()) or not profiles:
        return "und", 0.0
    off = {lang: sum(abs(p.index(g) - i) if g in p else top for i, g in enumerate(grams)) for lang, p in profiles.items()}
    best = min(sorted(off), key=lambda x: off[x])
    return best, 1 - off[best] / (top * len(grams))


def test_distances_are_brute_force(spark):
    rng = random.Random(12)
    top = 60
    rows = [(i, " ".join(rng.choices(LANGS[lang].split(), k=rng.randint(3, 25))) + rng.choice(["", " 12!", " \n É-x", " a\u0301"]), lang, "s", 0) for i, lang in enumerate(["en", "de", "fr"] * 25)]
    rows += [(200, "und und", "und", "s", 0), (201, "ab", "aa", "s", 0), (202, "ab", "bb", "s", 0)]  # aa and bb tie
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = {}
    for _, text, lang, _, _ in rows:
        if lang != "und":
            for g, n in brute_grams(text, top).items():
                counts.setdefault(lang, {})[g] = counts.setdefault(lang, {}).get(g, 0) + n
    profiles = {lang: brute_ranked(c, top) for lang, c in counts.items()}
    learnt = language_id.learn(docs, top=top)
    assert learnt.languages == sorted(profiles) and "und" not in learnt.languages
    more = [(300, None), (301, "ab"), (302, "9 9"), (303, "the le der"), (304, "zz qq " * 50), (305, "\u0301")]
    asked = [(r[0], r[1]) for r in rows] + more
    got = {r.doc_id: (r.lang_pred, round(r.score, 12)) for r in language_id.identify(frame(spark, asked).drop("lang"), learnt).collect()}
    want = {i: (lang, round(score, 12)) for i, t in asked for lang, score in [brute_predict(t, profiles, top)]}
    assert got == want and got[301][0] == "aa"


def test_long_texts_are_counted_in_stretches():
    text = "ab cd " * 400_000
    codes, counts = language_id.ngrams(text)
    short, few = language_id.ngrams("ab cd " * 10)
    assert sorted(codes.tolist()) == sorted(short.tolist()) and dict(zip(codes.tolist(), counts.tolist(), strict=True))[ord("a")] == 400_000 and few.max() >= 10


# SimHash


def brute_print(text):
    w = (text or "").encode().lower().split()
    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints(spark):
    texts = ["A b C d", "one", "", None, "é É x", "w " * 5000]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]
    native = spark.createDataFrame([("a b c",)], "t string").selectExpr("xxhash64(t)").first()[0]
    assert native % 2**64 == xxh64_intdigest(b"a b c", 42)


def test_links_are_brute_force(spark):
    rng = random.Random(6)
    fps = set()
    for _ in range(25):
        at = rng.getrandbits(64)
        fps.add(at)
        for _ in range(12):
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(at)
    fps |= {1 << b for b in range(40)} | {0}
    fps = sorted(fps)
    from massif.operators.components import connected_components

    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = connected_components(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    root = {r.node % 2**64: r.component for r in got}
    label = {x: x for x in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                label[find(a)] = find(b)
    groups = {}
    for x in fps:
        groups.setdefault(find(x), set()).add(x)
    linked = [g for g in groups.values() if len(g) > 1]
    assert set(root) == set().union(*linked)
    assert all(len({root[x] for x in g}) == 1 for g in linked) and len(set(root.values())) == len(linked)


def test_one_of_each_group_stays(spark):
    a = " ".join(f"w{i}" for i in range(200))
    docs = frame(spark, [(5, a), (3, a), (3, a), (9, a + "  "), (7, "other text of some words"), (8, None), (2, ""), (None, "lonely words"), (None, "lonely words")])
    left = simhash.deduplicate(docs)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "3", "7", "None"] and left.columns == docs.columns
    merged = simhash.deduplicate(docs, few_rows=0)  # both ways leave the same rows
    assert sorted(map(str, merged.collect())) == sorted(map(str, left.collect()))
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert {(5, 3), (9, 3), (8, 2), (7, 7), (None, None)} <= found
    assert simhash.deduplicate(docs.limit(0)).count() == 0
