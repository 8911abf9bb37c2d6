import statistics

import pytest

from tidemail.operators import profile as pr
from tidemail.sources.tables import table

from conftest import SF001


def test_counts_and_histogram_brute_force(spark):
    c = table(spark, SF001, "customer")
    rows = c.collect()
    counts = {r["column_name"]: r for r in pr.profile_counts(c).collect()}
    for col in c.columns:
        vals = [r[col] for r in rows]
        assert counts[col]["num_records"] == len(vals)
        assert counts[col]["num_null"] == sum(v is None for v in vals)
        assert counts[col]["num_unique"] == len({v for v in vals if v is not None})
    hist = pr.histogram(c, ["c_mktsegment"], max_bins=100).collect()
    assert sum(r["n"] for r in hist) == len(rows)
    order = sorted(hist, key=lambda r: r["rank"])
    assert all((a["n"], b["value"]) >= (b["n"], a["value"]) for a, b in zip(order, order[1:]))
    cat = pr.categorical_profile(c, ["c_mktsegment"]).first()
    assert cat["most_common_value"] == order[0]["value"]
    assert cat["least_common_value"] == order[-1]["value"]


def test_numerical_brute_force(spark):
    c = table(spark, SF001, "customer")
    vals = [r[0] for r in c.select("c_acctbal").collect() if r[0] is not None]
    r = pr.numerical_profile(c, ["c_acctbal"]).first()
    assert r["mean"] == pytest.approx(statistics.fmean(vals), abs=1e-5)
    assert r["stddev"] == pytest.approx(statistics.stdev(vals), abs=1e-5)
    assert r["median"] == pytest.approx(statistics.median(vals), abs=1e-6)
    a = pr.numerical_profile(c, ["c_acctbal"], approx=True).first()
    assert min(vals) <= a["median"] <= max(vals)


def test_column_types(spark):
    df = spark.createDataFrame([(1, "a", (1, "x"))], "a long, b string, s struct<i:int,t:string>")
    t = {d["column_name"]: d for d in pr.column_types(df, {"b": ("sampler", "category")})}
    assert t["a"]["simple_dtype"] == "int" and t["a"]["pyarrow_dtype"] == "int64"
    assert t["s"]["simple_dtype"] == "dict"
    assert t["b"]["sampler_type"] == "category"


@pytest.mark.parametrize("n", [20001, 20000])
def test_exact_median_bracket_with_skew(spark, n):
    import random
    rnd = random.Random(n)
    vals = [7.0 if i % 3 == 0 else float(rnd.randint(0, 5000)) / 4 for i in range(n)]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(vals)], "a double, b double").repartition(5)
    got = {r["column_name"]: r["median"] for r in pr.exact_median(
        pr._long(df, ["a", "b"], lambda c: df[c]).filter("v is not null"), accuracy=50, direct=0).collect()}
    assert got["a"] == pytest.approx(statistics.median(vals), abs=1e-9)
    assert got["b"] == pytest.approx(statistics.median(range(n)), abs=1e-9)


def test_histogram_is_whole_and_ranked(spark):
    from tidemail.sources.tables import table
    c = table(spark, SF001, "customer")
    rows = c.select("c_nationkey").collect()
    counts = {}
    for r in rows:
        counts[str(r[0])] = counts.get(str(r[0]), 0) + 1
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    got = sorted((r["rank"], r["value"], r["n"]) for r in pr.histogram(c, ["c_nationkey"]).collect())
    assert [(v, n) for _, v, n in got] == want
    assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
    top = pr.histogram(c, ["c_nationkey"], max_bins=3).collect()
    assert sorted(r["rank"] for r in top) == [1, 2, 3]


@pytest.mark.parametrize("n,acc", [(60001, 300), (60000, 1000)])
def test_exact_median_grid_pass(spark, n, acc):
    # many distinct values: the first bracket holds ~8n/acc rows, which the
    # grid pass narrows before the final ranking
    import random
    rnd = random.Random(acc)
    vals = [rnd.gauss(0.0, 1.0) if i % 5 else 0.25 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "a double").repartition(7)
    lng = pr._long(df, ["a"], lambda c: df[c]).filter("v is not null")
    for direct in (pr.MEDIAN_DIRECT, 0):          # 0: always run the grid pass
        got = pr.exact_median(lng, accuracy=acc, direct=direct).first()["median"]
        assert got == pytest.approx(statistics.median(vals), abs=1e-12)


def test_profile_counts_approx_close_to_exact(spark):
    d = table(spark, SF001, "documents")
    exact = {r["column_name"]: r for r in pr.profile_counts(d).collect()}
    approx = {r["column_name"]: r for r in pr.profile_counts(d, approx=True).collect()}
    assert exact.keys() == approx.keys()
    for c, e in exact.items():
        a = approx[c]
        assert (a["num_records"], a["num_null"]) == (e["num_records"], e["num_null"])
        assert abs(a["num_unique"] - e["num_unique"]) <= max(2, 0.05 * e["num_unique"])


def test_states_of_parts_merge_to_the_profile_of_the_union(spark):
    import math
    import random
    import statistics

    from tidemail.operators import profile_states as ps
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", None, "c" * 50]) if i % 5 else "hot", r.gauss(1e6, 3) if i % 7 else None) for i in range(9000)]
    parts = [rows[:10], rows[10:4000], rows[4000:], [], [(None, None, None)] * 3]
    frames = [spark.createDataFrame(p, "id int, s string, x double") for p in parts]
    states = [ps.profile_state(f, nums=["id", "x"]) for f in frames if f.count()]
    got = {p.column_name: p for p in ps.read_profile(ps.merge_states(*states), (0.25, 0.5), 3).collect()}
    whole = [x for p in parts for x in p]
    xs = sorted(x for _, _, x in whole if x is not None)
    assert {c: (p.num_records, p.num_null) for c, p in got.items()} == {
        "id": (9003, 3), "s": (9003, sum(v is None for _, v, _ in whole)), "x": (9003, sum(x is None for _, _, x in whole))}
    x = got["x"]
    assert (x.min, x.max) == (xs[0], xs[-1]) and math.isclose(x.mean, statistics.fmean(xs)) and math.isclose(x.stddev, statistics.stdev(xs), rel_tol=1e-6)
    for q, value in ((0.25, x.q25), (0.5, x.q50)):
        assert abs(sum(v <= value for v in xs) / len(xs) - q) < 0.01
    assert abs(got["id"].num_unique - 9000) < 300 and got["s"].num_unique == 4 and got["s"].min is None and got["s"].q50 is None
    counts = [(t["item"], t["count"]) for t in got["s"].top]
    exact = {v: sum(w == v for _, w, _ in whole) for v in ("hot", "a", "b", "c" * 50)}
    assert counts == sorted(exact.items(), key=lambda t: -t[1])[:3]
    # in any order and any grouping
    again = ps.merge_states(ps.merge_states(*states[1:]), states[0])
    assert [(p.num_records, p.num_unique, p.min) for p in ps.read_profile(again).orderBy("column_name").collect()] == \
        [(got[c].num_records, got[c].num_unique, got[c].min) for c in sorted(got)]
