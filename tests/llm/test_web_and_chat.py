import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from massif.llm import chat_format, url_reputation, warc

# WARC

PAGES = [(1, "http://a/", "x"), (5, "http://b/\r\nX: y", "same"), (9, None, "same"), (9, "u", "same"), (3, "http://c/ä b%", None), (4, "http://d/", ""), (None, "http://e/", "same"), (7, "http://f/", "é" * 5000), (2, "http://g/", "same")]


def archive(spark, tmp_path, name, rows=PAGES, **how):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("shard", F.lit(9))
    path = str(tmp_path / name)
    warc.write_warc(pages, path, **how)
    return path


def test_round_trip_with_revisits(spark, tmp_path):
    path = archive(spark, tmp_path, "a")
    got = warc.read_warc(spark, path, payloads=True).collect()
    assert len(got) == len(PAGES)
    by = {(r.key, r.record_type, r.refers_to) for r in got}
    assert {(9, "response", None), (9, "revisit", 9), (5, "revisit", 9), (2, "revisit", 9), (4, "response", None), (3, "revisit", 4), (1, "response", None), (None, "revisit", 9)} == by - {(7, "response", None)}
    assert {r.payload_digest for r in got if r.key in (2, 5, 9)} == {warc.base32_sha1(b"same")} and {r.payload_bytes for r in got if r.key == 7} == {10000}
    assert bytes(next(r.payload for r in got if r.key == 7)).decode() == "é" * 5000
    assert next(r.url for r in got if r.key == 5) == "http://b/\r\nX: y"


def test_null_keys_revisit_the_largest(spark, tmp_path):
    rows = [(None, "u", "same"), (3, "u", "same"), (5, "u", "same"), (None, "u", "alone"), (None, "v", "alone"), (4, "u", None), (None, "w", "")]
    pages = spark.createDataFrame(rows, "`page id` long, url string, `the html` string")
    for path in (str(tmp_path / "n"), (tmp_path / "m").as_uri()):
        warc.write_warc(pages, path, key_col="page id", payload_col="the html")
        got = sorted(((r.key or 0, r.record_type, r.refers_to or 0) for r in warc.read_warc(spark, path).collect()))
        assert got == [(0, "response", 0), (0, "response", 0), (0, "revisit", 4), (0, "revisit", 5), (3, "revisit", 5), (4, "response", 0), (5, "response", 0)]
    with pytest.raises(Exception, match="(?i)scheme|filesystem"):
        warc._filesystem("nowhere://x/y")


def test_files_are_deterministic_rolled_and_sorted(spark, tmp_path):
    rows = [(i, f"http://h/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 30) for i in range(300)]
    out = []
    for name in ("b", "c"):
        path = archive(spark, tmp_path, name, rows, roll_bytes=4000, shard_bytes=150_000)
        names = sorted(p.name for p in (tmp_path / name).glob("*.warc.gz"))
        out.append([(n, hashlib.sha1((tmp_path / name / n).read_bytes()).hexdigest()) for n in names])
        assert not any((tmp_path / name / "_temporary").iterdir())
        keys = [line.split(b": ")[1] for n in names for line in gzip.decompress((tmp_path / name / n).read_bytes()).split(b"\r\n") if line.startswith(b"X-Key: ")]
        assert [int(k) for k in keys] == list(range(300))
        assert warc.read_warc(spark, path).count() == 300
    assert out[0] == out[1] and len(out[0]) > 5


def test_shards_stay_even_however_keys_are_spread(spark):
    rows = spark.range(6000).selectExpr("id AS key", "rpad('', 300, 'x') AS payload")
    sizes = {}
    for name, keys in {"dense": "id", "outlier": "if(id = 7, 4611686018427387904, id)", "ends": "if(id = 7, 9223372036854775807, if(id = 8, -9223372036854775808, id))", "hashed": "xxhash64(id)", "hot": "if(id % 3 = 0, 77, id)"}.items():
        table = rows.selectExpr(f"{keys.replace('id', 'key')} AS key", "payload").withColumn("digest", F.sha1(F.rand(1).cast("string")))
        table = spark.createDataFrame(table.toPandas())
        starts = warc.key_ranges(table, 100_000)
        counts = [r["count"] for r in table.withColumn("shard", warc.shard_of(F.col("key"), F.col("digest"), starts)).groupBy("shard").count().collect()]
        assert starts == sorted(starts) and sum(counts) == 6000
        sizes[name] = (len(starts), max(counts) * 800)
    assert all(40 <= n <= 80 and most <= 150_000 for n, most in sizes.values()), sizes
    assert warc.key_ranges(rows.selectExpr("CAST(NULL AS LONG) AS key", "payload"), 1000) == []


def test_a_hot_key_is_split_by_digest(spark, tmp_path):
    rows = [(5 if i % 2 else i, f"http://h/{i}", f"text {i % 150} " * 40) for i in range(400)]
    path = archive(spark, tmp_path, "hot", rows, shard_bytes=20_000)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == 400 and len({p.name.split("-")[0] for p in (tmp_path / "hot").glob("*.warc.gz")}) > 8
    responses = {r.payload_digest for r in got if r.record_type == "response"}
    assert len(responses) == sum(r.record_type == "response" for r in got) == 150


def test_least_bytes_empty_and_damage(spark, tmp_path):
    got = warc.read_warc(spark, archive(spark, tmp_path, "d", least_bytes=10)).collect()
    assert {r.record_type for r in got} == {"response"}
    assert warc.read_warc(spark, archive(spark, tmp_path, "e", [])).count() == 0
    data = gzip.decompress(warc.record(1, "u", b"payload", None, 0, "2000-01-01T00:00:00Z"))
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"payload\r\n", b"payl0ad\r\n"))


# Reputation


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q#f", "http://example.net/de/81", "http://x.net/de/", "nothing", None, "http://com/en/", "http://notcom/en/", "http://b.org", "http://h?x/en/", "ftp://É.com/en/ü"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, labels, rules).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[1] == ("example.net", "/de/81", "example.net/de/8", "block") and got[2][2:] == ("net/de/", "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2] == "com/en/" and got[6][2] is None
    assert got[7][:2] == ("b.org", "") and got[8][:2] == ("h", "") and got[9] == ("É.com", "/en/ü", "com/en/", "block")
    assert url_reputation.judge_urls(pages.limit(0), labels, rules).count() == 0


def test_bad_hosts_are_blocked_and_evidence_is_shared(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.site{i % 6}.org/{i}") for i in range(600)] + [(1000, "http://new.site1.org/"), (1001, "http://bad.other.co.uk/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, None) for i in range(600)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages, labels, {}).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(600)) and got[1001].verdict == "allow"
    assert got[1000].lower > got[1001].lower
    assert got[0].n == 100 and got[1000].n == 0 and 0.9 < got[1].rate < 1 and got[1].lower < got[1].rate
    levels = url_reputation.with_levels(spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x",), ("",), ("u@h.example.com:80",)], "host string")).collect()
    assert [(r.domain, r.suffix) for r in levels] == [("b.co.uk", "co.uk"), ("co.uk", "uk"), ("x", "x"), ("", ""), ("example.com", "com")]


def test_suffixes_may_be_a_table(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.gov.fr",), ("",)], "host string")
    table = spark.createDataFrame([("co.uk",), ("gov.fr",), ("co.uk",), (None,)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in url_reputation.with_levels(hosts, table).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "uk"), "x.y.gov.fr": ("y.gov.fr", "gov.fr"), "": ("", "")}


# Chat


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, msg long, kind string, role string, text string").withColumn("at", F.lit("clash"))


def test_events_fold_into_final_messages(spark):
    log = events(spark, [
        (1, 0, 0, "message", "user", "hi"), (1, 9, 0, "edit", None, "hello"), (1, 1, 1, "message", "assistant", "A"), (1, 2, 1, "delta", None, "b"), (1, 3, 1, "regenerate", None, None),
        (1, 4, 1, "delta", None, "c"), (1, 5, 1, "delta", None, "d"), (1, 5, 1, "delta", None, "d"), (2, 0, 5, "delta", "assistant", "x"), (None, 0, 0, "message", None, None),
        (3, 1, 1, "message", "user", "twice"), (3, 1, 1, "message", "user", "twice"),
    ])
    got = {(r.conv_id, r.msg, r.part): (r.role, r.text) for r in chat_format.reconstruct(log).collect()}
    assert got == {(1, 0, 0): ("user", "hello"), (1, 1, 0): ("assistant", "cdd"), (2, 5, 0): ("assistant", "x"), (None, 0, 0): ("", ""), (3, 1, 0): ("user", "twice"), (3, 1, 1): ("user", "twice")}
    assert chat_format.format_log(log.limit(0)).count() == 0
    with pytest.raises(Exception, match="unknown kind"):
        chat_format.reconstruct(events(spark, [(1, 0, 0, "shout", "user", "x")])).collect()


def test_control_strings_come_back(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x|> <\\\\|", "", "\n\n<|", "a\\n<|im_end|>\n", "x" * 100_000, "$1 \\1"]
    roles = ["user", "assistant", "we\\ird\nrole<|", "assistant", "", "assistant", "\\n"]
    log = events(spark, [(7, i, i, "message", r, t) for i, (r, t) in enumerate(zip(roles, texts, strict=True))])
    out = chat_format.format_log(log).withColumn("turns", chat_format.read_turns(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out.turns] == list(zip(roles, texts, strict=True))
    assert "".join(s.text for s in out.segments) == out.formatted and out.formatted.count("<|im_start|>") == len(texts)
    assert [s.text for s in out.segments if s.loss] == ["<\\\\|x|> <\\\\\\|", "\n\n<\\|", "x" * 100_000]


def test_a_log_of_deltas_edits_and_regenerations_folds_into_its_table(spark):
    texts = ["", "x", "ab", "abc <|im_end|>", None, "é" * 1000, "same", "same", "zz"]
    rows = [(c, t, ["user", "assistant", None][(c + t) % 3], texts[(3 * c + t) % len(texts)]) for c in range(5) for t in range(7)]
    rows += [(9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (9, 1, "assistant", "Other"), (9, 2, "user", "last"), (8, None, "user", "no turn"), (None, 0, "user", "no id"), (10, -1, "user", "early"), (10, 0, "user", "late")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat_format.log_of_table(table)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds["message"] == len(rows) and min(kinds[k] for k in ("delta", "edit", "regenerate")) > 5
    log = log.orderBy(F.rand(3))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.format_log(log).select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got == want
    drafts = spark.createDataFrame([(1, 2, "assistant", "final words")], table.schema)
    assert "and so on" in [r.text.strip() for r in chat_format.log_of_table(drafts).filter("text is not null").collect()]
