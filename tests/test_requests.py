from tidemail.sources.requests import parse_requests

ROWS = [
    (1, '{"subject":"s","sender":"x","body":"y","url":"u"}', None),
    (2, '{"subject":1,"sender":"x","body":"y"}', "bad field: subject"),
    (3, '{"subject":"s"}', "bad field: sender,body"),
    (4, '{"subject":null,"sender":"x","body":"y"}', "bad field: subject"),
    (5, '{"error":"boom"}', "bad field: subject,sender,body"),
    (6, "not json", "invalid json"),
    (7, '["a"]', "invalid json"),
]


def test_intake_fixtures(spark):
    df = spark.createDataFrame([(i, j) for i, j, _ in ROWS], "id int, j string")
    valid, rej = parse_requests(df, "j", keep=["id"])
    v = valid.collect()
    assert [(r["id"], r["subject"], r["sender"], r["body"], r["url"]) for r in v] == [(1, "s", "x", "y", "u")]
    got = {r["id"]: r["reason"] for r in rej.collect()}
    assert got == {i: reason for i, _, reason in ROWS if reason}


def test_host_wildcard_stays_in_the_host(spark):
    from tidemail.operators.gates import match_patterns
    urls = {"http://a.example.org/y": True, "http://evil.com/x.example.org/y": False, "http://evil.com?x.example.org/y": False,
            "http://a.b.example.org/": True, "https://a.example.org/y": False}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r["url"]: r["ok"] for r in df.withColumn("ok", match_patterns("url", ["http://*.example.org/*"])).collect()}
    assert got == urls
