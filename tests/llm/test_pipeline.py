import random

import public_tokenizers
from test_documents import brute_figures, brute_scan
from test_jaccard import brute_components, edited
from tokenizers import Tokenizer

import corpus_pipeline
from massif.llm import decontaminate, line_quality


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    words = "the quick brown fox jumps over lazy dog while seven wizards box five more jugs of liquor".split()
    text = lambda: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(120))
    passage = " ".join(f"bench{i}" for i in range(15))
    twin = text()
    rows = [(i, text(), "en", "s", 0) for i in range(20)] + [(100, twin, "en", "s", 0), (101, twin, "en", "t", 0), (102, f"{text()} {passage}", "en", "s", 0), (103, "short", "en", "s", 0), (104, "12 34", "en", "s", 0), (105, None, "en", "s", 0), (106, "spam spam spam " * 40, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {"language": {104, 105}, "quality": {103, 106}, "near_dedup": {101}, "decontamination": {102}}
    have = {r[0] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path)).cache()
        have -= want[name]
        assert {r.doc_id for r in left.collect()} == have, name
        assert left.columns == docs.columns
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == have and len({r.sequence_id for r in packed}) >= 2
    assert decontaminate and line_quality


FOREIGN = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. ",
}


def test_language_drops_languages_never_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300))
    other = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*(t * 10 for t in FOREIGN.values()), noise])], docs.schema)
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(other), "").collect()}
    assert left == {r.doc_id for r in docs.select("doc_id").collect()}


def brute_pipeline(rows, items):
    """The rows (doc_id, text, source) that stay, by plain loops."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    lines = {}
    for _, text, source in {(None, t, s) for _, t, s in rows}:
        for x in {" ".join(x.split()).lower() for x in text.split("\n") if x.strip()}:
            lines.setdefault((source, x), set()).add(text)
    sizes = {s: len({t for _, t, u in rows if u == s}) for _, _, s in rows}
    common = {k for k, v in lines.items() if len(v) > 20 and len(v) > 0.01 * sizes[k[0]]}
    kept = []
    for i, text, source in rows:
        n, _, _, _, repeated = brute_figures(text)
        stays = "\n".join(x for x in text.split("\n") if (source, " ".join(x.split()).lower()) not in common)
        if n >= 50 and 2 * repeated <= n and len(stays.split()) >= 0.3 * n:
            kept.append((i, stays, source))
    label = brute_components([t for _, t, _ in kept])
    first = {}
    for (i, t, s), c in zip(kept, label, strict=True):
        if c not in first or (i is not None, i or 0) < (first[c][0] is not None, first[c][0] or 0):
            first[c] = (i, t, s)
    return [r for r in first.values() if not brute_scan(r[1], items)[1]]


def test_run_is_a_brute_force_pipeline(spark, tmp_path):
    rng = random.Random(17)
    vocab = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "wizards", "box", "liquor", "seven"]
    fresh = lambda n: [rng.choice(vocab) + str(rng.randint(0, 400)) for _ in range(n)]
    items = [(1, " ".join(f"bench{i}" for i in range(15))), (2, "short item here"), (3, None)]
    boiler = "This  line is on every page of host one"
    rows = []
    for f in range(25):
        base = fresh(rng.randint(55, 250))
        for k in range(rng.randint(1, 4)):
            words = edited(rng, base, min(len(base), rng.randint(0, 1 + len(base) // 25)))
            text = " ".join(words[: len(words) // 2]) + "\n" + (boiler + "\n" if f % 2 else "") + " ".join(words[len(words) // 2 :])
            rows.append((100 * f + k, text, "one" if f % 2 else "two"))
    rows += [(9000 + i, boiler + "\n" + " ".join(fresh(60)), "one") for i in range(25)] + [(9100, "\n".join([boiler + " "] * 9), "one"), (9101, boiler + "\n" + " ".join(fresh(55)), None)]
    rows += [(9200, " ".join(fresh(60)) + " " + items[0][1].upper(), "two"), (9201, " ".join(fresh(60)) + " SHORT, item: here", "two"), (9202, " ".join(fresh(60)), "two"), (9203, " ".join(fresh(20)), "two"), (9204, "spam " * 90, "two"), (9205, None, "two"), (9206, "", "two"), (9207, "1 2 3 " * 40, "two"), (None, " ".join(fresh(60)), "two")]
    rows += [rows[0], rows[-1], (9202, " ".join(fresh(70)), "two"), (9300, " ".join(fresh(40_000)), "two")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(i), len(tok.encode(t, add_special_tokens=False).ids) + 1) for i, t, _ in brute_pipeline(rows, items))
    got = {}
    for r in packed:
        got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + r.length
    have = {}
    for i, n in want:
        have[i] = have.get(i, 0) + n
    assert got == have
    assert sorted(str(i) for i, _ in want) == sorted(str(r.doc_id) for r in packed if r.piece == 0)
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert len(ends) <= -(-sum(ends.values()) // 1024) + 1 and max(ends.values()) <= 1024


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score double")
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, str(tmp_path))
        assert left.count() == 0 and (name == "packing" or left.columns == docs.columns)
