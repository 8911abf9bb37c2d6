from pyspark.sql import functions as F

from tidemail.functions import verdict as vd
from tidemail.operators import tokens as tk


def test_confidence_floor(spark):
    df = spark.createDataFrame([(0.29,), (0.999,), (0.5,)], "s double")
    assert [r[0] for r in df.select(vd.confidence("s")).collect()] == [28, 99, 50]


def test_label_decoding(spark):
    df = spark.createDataFrame([("LABEL_0",), ("LABEL_1",), ("Safe",)], "l string")
    got = [(r[0], r[1]) for r in df.select(vd.decode_serving("l"), vd.decode_eval("l")).collect()]
    assert got == [(False, 0), (True, 1), (True, 0)]


def test_verdict_texts(spark):
    df = spark.createDataFrame([(True, 87, False)], "p boolean, a long, t boolean")
    r = df.select(*[c.alias(k) for k, c in vd.verdict_texts("p", "a", "t", "Example").items()]).first()
    assert r["headline"] == vd.HEADLINE_PHISH
    assert r["confidence_line"] == "Confidence: 87%"
    assert r["sender_line"] == "This email was NOT sent from an official Example account"


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4, 5, 6],), ([],)], "ids array<int>")
    got = [(r["input_ids"], r["attention_mask"]) for r in tk.pad(df, "ids", 5).collect()]
    assert got == [([1, 2, 3, 0, 0], [1, 1, 1, 0, 0]), ([1, 2, 3, 4, 5], [1, 1, 1, 1, 1]),
                   ([0, 0, 0, 0, 0], [0, 0, 0, 0, 0])]


def test_iso_ts(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.678912",)], "t string").select(
        F.to_timestamp_ntz("t").alias("t"))
    assert df.select(vd.iso_ts("t")).first()[0] == "2024-01-02T03:04:05.678Z"


def test_pattern_table_equals_the_chain(spark):
    import random

    import pytest
    from tidemail.operators import gates
    r = random.Random(3)
    labels = ["a", "b", "mail", "example", "com", "org", "co"]
    host = lambda: ".".join(r.choice(labels) for _ in range(r.randint(1, 4)))
    schemes, paths = ["http", "https", "*"], ["*", "x/*", "", "x/y"]
    patterns = [f"{r.choice(schemes)}://{r.choice(['', '*.', 'm*', 'a.*.'])}{host()}/{r.choice(paths)}" for _ in range(1000)]
    patterns += ["https://m.*/*", "http://*/x/y", "https://example.com", "*x/y?q=1", "https://a.b:80/*"]
    urls = [f"{r.choice(['http', 'https', 'ftp'])}://{host()}{r.choice(['', ':80'])}{r.choice(['', '/', '/x/', '/x/y', '/x/z?u=a.com/'])}" for _ in range(600)]
    urls += [None, "", "no url", "https://m.example/", "https://user@a.com/x/y", "https://a.com?x/y", urls[0], urls[0]]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    table = spark.createDataFrame([(p,) for p in patterns + [None, patterns[0]]], "pattern string")
    want = {r["id"]: r["ok"] for r in df.select("id", gates.match_patterns("url", patterns[:60] + patterns[1000:]).alias("ok")).collect()}
    few = spark.createDataFrame([(p,) for p in patterns[:60] + patterns[1000:]], "pattern string")
    got = gates.match_pattern_table(df, "url", few)
    assert got.columns == ["id", "url", "allowed"]
    assert {x.id: x.allowed for x in got.collect()} == want and len(set(want.values())) == 2
    # 1,000 patterns against the regular expressions themselves, and 100,000 more
    import re
    rules = [re.compile(gates.pattern_regex(p)) for p in patterns]
    whole = {i: bool(u is not None and any(x.match(u) for x in rules)) for i, u in enumerate(urls)}
    many = table.union(spark.range(100_000).selectExpr("concat('https://h', id, '.example.net/*')"))
    for t in (table, many):
        assert {x.id: x.allowed for x in gates.match_pattern_table(df, "url", t).collect()} == whole
    assert gates.match_pattern_table(df, "url", table.limit(0)).where("allowed").count() == 0
    with pytest.raises(ValueError, match="literal end"):
        gates.match_pattern_table(df, "url", spark.range(1001).selectExpr("concat('https://m', id, '.*/') pattern"))
