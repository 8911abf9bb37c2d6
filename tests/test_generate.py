import math

import pytest
from pyspark.sql import functions as F

from tidemail.functions.templates import TemplateError, render
from tidemail.plans import generate as g
from tidemail.plans.order_mail import order_mail_plan


def test_template_render(spark):
    df = spark.createDataFrame([("Dr. Ada Quill Lovelace", 20, ("Kim", "Lee")),
                                ("Registrar", 25, ("Jo", "Ray"))],
                               "staff string, age int, p struct<first:string,last:string>")
    t = ("{{ p.first }} {{p.last}} <{{ staff.split()[1] | lower }}.{{ staff.split()[-1] | lower }}@x> "
         "{% if age < 22 %}young{% elif age == 25 %}mid{% else %}old{% endif %}")
    got = [r[0] for r in df.select(render(t)).collect()]
    assert got == ["Kim Lee <ada.lovelace@x> young", None]


def test_template_null_condition_fails_row(spark):
    df = spark.createDataFrame([(None,)], "age int")
    assert df.select(render("{% if age < 22 %}a{% else %}b{% endif %}")).first()[0] is None


def test_template_errors():
    with pytest.raises(TemplateError):
        render("{% if x %}a")
    with pytest.raises(TemplateError):
        render("{{ x | shout }}")


def test_plan_validation():
    p = g.Plan().add("a", g.Category(["x", "y"], [1]))
    with pytest.raises(g.PlanError):
        p.validate()
    p = g.Plan().add("a", g.Expr("{{ b }}")).add("b", g.Expr("{{ a }}"))
    with pytest.raises(g.PlanError, match="cycle"):
        p.validate()
    p = g.Plan().add("a", g.Expr("{{ nope }}"))
    with pytest.raises(g.PlanError, match="unknown"):
        p.validate()
    p = g.Plan().add("d", g.Category(["x", "y"])).add("s", g.Subcategory("d", {"x": ["1"]}))
    with pytest.raises(g.PlanError, match="parent"):
        p.validate()
    order = [s.name for s in g.Plan().add("b", g.Expr("{{ a }}!")).add("a", g.Category(["x"])).validate()]
    assert order == ["a", "b"]


def test_weighted_shares_within_3_sigma(spark):
    w = [2, 1, 2, 1, 1]
    plan = g.Plan().add("c", g.Category(list("abcde"), w))
    t, rej = plan.create(spark, 20000, seed=3)
    counts = {r["c"]: r["count"] for r in t.groupBy("c").count().collect()}
    n = 20000
    for v, wt in zip("abcde", w):
        p = wt / sum(w)
        assert abs(counts[v] - n * p) < 3 * math.sqrt(n * p * (1 - p)) + 1
    assert rej.count() == 0


def test_partition_independent_and_preview(spark):
    plan = order_mail_plan("example.edu", priority_col="seg")
    base = spark.range(200).select(F.col("id").alias("k"), F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("seg"))
    a = {r["k"]: tuple(r) for r in plan.create_from(base.repartition(1), "k", 9)[0].collect()}
    b = {r["k"]: tuple(r) for r in plan.create_from(base.repartition(7), "k", 9)[0].collect()}
    assert a == b
    ages = [r["receiver_age"] for r in plan.create_from(base, "k", 9)[0].collect()]
    assert set(ages) <= set(range(21, 71))
    prev = g.Plan().add("x", g.Uniform(1, 5, "int")).preview(spark, 10)
    assert prev.count() == 10 and set(r["x"] for r in prev.collect()) <= {1, 2, 3, 4, 5}


def test_person_fields(spark):
    plan = g.Plan().add("p", g.Person(age_range=(18, 30)))
    t, _ = plan.create(spark, 300, seed=1)
    rows = t.select("p.*").collect()
    assert len(rows[0]) == 24
    for r in rows:
        assert 18 <= r["age"] <= 30
        y, m, d = map(int, r["birth_date"].split("-"))
        age = 2025 - y - (1 if (m, d) > (1, 1) else 0)
        assert age == r["age"]
        assert r["phone_number"].startswith("555-01") and r["ssn"].startswith("000-")


def test_external_generator_failures_rejected(spark):
    def factory(how):
        def fn(prompt):
            if "7" in prompt:
                raise RuntimeError("boom")
            return prompt.upper()
        return fn
    plan = g.Plan().add("n", g.Expr("n{{ row_id }}")).add(
        "t", g.Text("say {{ n }}", generator=factory, max_parallel=2, timeout=5))
    t, rej = plan.create(spark, 30, seed=1)
    got = {r["row_id"]: r["t"] for r in t.collect()}
    assert got[1] == "SAY N1"
    bad = {r["row_id"] for r in rej.collect()}
    assert bad == {i for i in range(30) if "7" in str(i)}
    assert set(got) | bad == set(range(30))


def test_structured_column(spark):
    def factory(how):
        return lambda p: '{"name": "x", "price": 2.5}' if "1" in p else "not json"
    plan = g.Plan().add("s", g.Structured("p{{ row_id }}", generator=factory,
                                          schema="name string, price double"))
    t, rej = plan.create(spark, 3, seed=1)
    r = t.collect()
    assert [(x["row_id"], x["s"]["name"], x["s"]["price"]) for x in r] == [(1, "x", 2.5)]
    assert rej.count() == 2


def test_profile_document_and_artifacts(spark, tmp_dir):
    import json
    import os

    from tidemail.plans.report import profile_document
    from tidemail.sources.sinks import write_artifacts
    plan = order_mail_plan("example.edu", priority_col="seg")
    base = spark.range(300).select(F.col("id").alias("k"), F.col("id").alias("o_orderkey"), F.lit("X").alias("seg"))
    built = plan.build(base, "k", 5).filter(F.col("message").isNotNull())
    doc = profile_document(plan, built, 300)
    table, _ = plan.create_from(base, "k", 5)
    write_artifacts(table, doc, os.path.join(tmp_dir, "art"))
    back = spark.read.json(os.path.join(tmp_dir, "art", "analysis")).first().asDict(recursive=True)
    assert back["target_num_records"] == 300
    assert back["num_records"] == table.count() == spark.read.parquet(os.path.join(tmp_dir, "art", "dataset")).count()
    assert back["side_effect_column_names"] == ["contact", "host"]
    stats = {c["column_name"]: c for c in back["column_statistics"]}
    dist = json.loads(stats["carrier"]["distribution"])
    assert sum(dist["histogram"]["counts"]) == back["num_records"]
    assert dist["most_common_value"] == dist["histogram"]["categories"][0]
    assert stats["message"]["completion_tokens_mean"] > 0


def test_generated_rows_are_built_once(spark):
    def factory(how):
        import random

        def fn(prompt):
            if random.random() < 0.5:
                raise RuntimeError("by chance")
            return f"{prompt} {how.temperature} {how.max_tokens}"
        return fn
    plan = g.Plan().add("t", g.Text("row {{ row_id }}", generator=factory, temperature=0.2, max_tokens=7))
    t, rej = plan.create(spark, 200, seed=1)
    kept, lost = [r["row_id"] for r in t.collect()], [r["row_id"] for r in rej.collect()]
    assert sorted(kept + lost) == list(range(200))
    assert t.first()["t"].endswith("0.2 7")


def test_generator_mistakes_fail_the_task(spark):
    plan = g.Plan().add("t", g.Text("x {{ row_id }}", generator=lambda how: lambda a, b: "two arguments"))
    with pytest.raises(Exception, match="TypeError"):
        plan.create(spark, 3, seed=1)[0].collect()


def test_a_hung_call_only_loses_its_own_row():
    import time

    def fn(p):
        if p == "a":
            time.sleep(30)
        return p.upper()
    start = time.monotonic()
    assert g.call_all(fn, ["a", "b", None, "c"], 1, 0.5) == [None, "B", None, "C"]
    assert time.monotonic() - start < 5


def test_text_needs_a_source_and_conditions_nest(spark):
    with pytest.raises(g.PlanError, match="response or a generator"):
        g.Plan().add("t", g.Text("only a prompt")).validate()
    inner = g.Category(["b"], when={"row_id >= 0": g.Category(["c"])})
    plan = g.Plan().add("x", g.Category(["a"], when={"row_id >= 0": inner}))
    assert {r["x"] for r in plan.create(spark, 5)[0].collect()} == {"c"}
    assert plan.specs[0].sampler.all_values() == {"a", "b", "c"}


def test_profile_keeps_undeclared_values(spark):
    import json

    from tidemail.plans.report import profile_document
    plan = g.Plan().add("c", g.Category(["a", "b"]))
    doc = profile_document(plan, spark.createDataFrame([("a",), ("b",), ("z",), ("z",)], "c string"), 4).first()
    assert json.loads(doc["column_statistics"][0]["distribution"])["histogram"]["categories"] == ["z", "a", "b"]


def test_structured_values_must_fit_their_schema(spark):
    kind = "name string, price double, tags array<string>, sub struct<n:int,open:boolean>"
    rules = {"price": g.js.Rule(low=0, high=100), "tags": g.js.Rule(low=1), "tags[]": g.js.Rule(choices=("a", "b")), "sub.open": g.js.Rule(required=False)}
    good = '{"name": "x", "price": 1, "tags": ["a"], "sub": {"n": 3}}'
    cases = {good: None, '{}': "name: missing", '{"name":"b"}': "price: missing", '{"price":"cheap"}': "name: missing", '[]': "value: not an object",
             'null': "value: missing", 'x': "invalid json", good.replace('"x"', "5"): "name: not string", good.replace("1,", '"cheap",'): "price: not double",
             good.replace("1,", "1e2,"): None, good.replace("1,", "100.5,"): "price: over 100", good.replace("1,", "-0.1,"): "price: under 0",
             good.replace('["a"]', "[]"): "tags: length under 1", good.replace('["a"]', '["a", 2]'): "tags[]: not string",
             good.replace('["a"]', '["b", null]'): "tags[]: missing", good.replace('["a"]', '["b", "c"]'): "tags[]: not a choice",
             good.replace('["a"]', '{"0": "a"}'): "tags: not array<string>", good.replace("3}", "3.5}"): "sub.n: not int",
             good.replace("3}", "3000000000}"): "sub.n: not int", good.replace("3}", '3, "open": 1}'): "sub.open: not boolean",
             good.replace("3}", '3, "open": null}'): None, good.replace("3}", '3, "open": true, "more": [1]}'): None,
             good.replace('{"n": 3}', "null"): "sub: missing", good.replace('{"n": 3}', "3"): "sub: not an object"}
    texts = list(cases)

    def factory(how):
        return lambda p: texts[int(p)]
    plan = g.Plan().add("s", g.Structured("{{ row_id }}", generator=factory, schema=kind, rules=rules))
    kept, lost = plan.create(spark, len(texts), seed=1)
    assert {texts[r.row_id] for r in kept.collect()} == {t for t, why in cases.items() if why is None}
    assert {texts[r.row_id]: r.reasons for r in lost.collect()} == {t: [f"s: {why}"] for t, why in cases.items() if why}
    first = kept.where("row_id = 0").first().s
    assert (first["name"], first["price"], first["tags"], first["sub"]["n"], first["sub"]["open"]) == ("x", 1.0, ["a"], 3, None)


def test_structured_schemas_are_checked(spark):
    for schema, rules in (("", {}), ("m map<string,int>", {}), ("a int", {"b": g.js.Rule()}), ("`a.b` int", {})):
        with pytest.raises((g.PlanError, Exception), match="field|checked|PARSE|schema"):
            g.Plan().add("s", g.Structured("p", response="{}", schema=schema, rules=rules)).validate()


def test_rejects_evaluate_each_draw_once(spark):
    base = spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("o_orderkey"), F.lit("X").alias("seg"))
    plan = order_mail_plan("example.edu", priority_col="seg")
    kept, lost = plan.create_from(base, "k", 5)
    draws = [d._jdf.queryExecution().optimizedPlan().toString().count("md5(") for d in (kept, lost)]
    assert draws[1] <= draws[0]


def _counting(folder, fail_at=None):
    """A generator that notes every call; a mistake in its code ends the task at one prompt."""
    import os
    import uuid

    def factory(how):
        def fn(prompt):
            if prompt == fail_at:
                raise TypeError("half-way")
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(prompt)
            return None if prompt.endswith("3") else prompt.upper()
        return fn
    return factory


def test_journal_a_lost_task_or_rerun_does_not_call_again(spark, tmp_path):
    import os
    from collections import Counter

    from tidemail.plans.journal import Journal
    calls = tmp_path / "calls"
    calls.mkdir()

    def asked():
        return Counter(open(calls / f).read() for f in os.listdir(calls))

    def plan(fail_at=None, temperature=0.9):
        return g.Plan().add("t", g.Text("row {{ row_id }}", generator=_counting(str(calls), fail_at), max_parallel=1, temperature=temperature))
    path = str(tmp_path / "journal")
    with pytest.raises(Exception, match="half-way"):
        plan("row 25").create(spark, 40, seed=1, num_partitions=1, journal=Journal(path, every=4))
    assert asked() == Counter(f"row {i}" for i in range(25))
    kept, lost = plan().create(spark, 40, seed=1, num_partitions=3, journal=Journal(path, every=4))
    # of 25 answers only the last one was not yet written; three failed calls (3, 13, 23) are asked again
    assert asked() == Counter(f"row {i}" for i in range(40)) + Counter(["row 24", "row 3", "row 13", "row 23"])
    want = {i: f"ROW {i}" for i in range(40) if i % 10 != 3}
    assert {r.row_id: r.t for r in kept.collect()} == want and {r.row_id for r in lost.collect()} == {3, 13, 23, 33}
    plan().create(spark, 40, seed=1, num_partitions=2, journal=Journal(path))
    assert sum(asked().values()) == 44 + 4
    plan(temperature=0.1).create(spark, 2, seed=1, journal=Journal(path))           # other settings are other calls
    assert sum(asked().values()) == 44 + 4 + 2


def test_journal_of_a_task_run_again(tmp_path):
    from tidemail.plans.journal import Journal
    journal = Journal(str(tmp_path / "j"))
    first = journal.task("t", 3)
    first.write({"a": "A"})
    first.write({})
    first.write({"b": "B"})
    assert journal.task("t", 3).held == {"a": "A", "b": "B"} and journal.task("t", 4).held == {}
    assert Journal(str(tmp_path / "j")).task("t", 3).held == {}


def test_table_values_draw_like_lists(spark):
    """10,000 weighted values: the draws of a list, shares within 3 sigma, a plan that does not grow."""
    rows = [(i, 1 + (i * 7) % 5) for i in range(10_000)]
    sizes = []
    for n in (40, 10_000):
        table = spark.createDataFrame(rows[:n] + [(-1, 0), (None, 9)], "v int, w int")
        out = g.Plan().add("c", g.CategoryTable(table, "v", "w")).create(spark, 30_000, seed=3)[0]
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        if n == 40:
            lists = g.Plan().add("c", g.Category([v for v, _ in rows[:n]], [w for _, w in rows[:n]])).create(spark, 30_000, seed=3)[0]
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, lists.collect()))
    assert sizes[0] == sizes[1]
    counts = {r.w: r.n for r in out.join(table, out.c == table.v).groupBy("w").agg(F.count("*").alias("n")).collect()}
    assert sum(counts.values()) == 30_000
    for w in range(1, 6):
        p = w / 15                                         # 2,000 values of each weight
        assert abs(counts[w] - 30_000 * p) < 3 * math.sqrt(30_000 * p * (1 - p)) + 1
    with pytest.raises(g.PlanError, match="no column"):
        g.Plan().add("c", g.CategoryTable(table, "nope")).validate()
    with pytest.raises(g.PlanError, match="0 values"):
        g.Plan().add("c", g.CategoryTable(table.limit(0), "v")).create(spark, 3)


def test_table_subcategories_and_repeated_values(spark):
    lists = {"a": ["x", "y", "z"], "b": ["q"]}
    table = spark.createDataFrame([(k, v) for k, vs in lists.items() for v in vs], "k string, v string")
    plan = lambda sub: g.Plan().add("p", g.Category(["a", "b", "none"])).add("s", sub)
    kept, lost = plan(g.SubcategoryTable("p", table, "k", "v")).create(spark, 600, seed=2)
    want = [r for r in plan(g.Subcategory("p", lists | {"none": ["?"]})).create(spark, 600, seed=2)[0].collect()]
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in want if r.p != "none")
    assert lost.count() == sum(r.p == "none" for r in want)
    twice = spark.createDataFrame([("a", 1), ("b", 3), ("a", 2)], "v string, w int")
    got = g.Plan().add("c", g.CategoryTable(twice, "v", "w")).create(spark, 500, seed=4)[0].collect()
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(g.Plan().add("c", g.Category(["a", "b"], [3, 3])).create(spark, 500, seed=4)[0].collect())]


def test_unread_person_fields_are_pruned(spark):
    base = spark.createDataFrame([(1, "1-URGENT"), (2, "5-LOW")], "o_orderkey long, o_orderpriority string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    table, rejected = order_mail_plan().create_from(base, "o_orderkey", 42)
    built = order_mail_plan().build(base, "o_orderkey", 42)
    for df in (table, rejected):
        assert "contact.first_name" in plan(df) and "contact.birthday" not in plan(df)
    assert "contact.birthday" in plan(built.select("contact.birth_date"))
    assert set(built.columns) == {"o_orderkey", "o_orderpriority", *[c.name for c in order_mail_plan().specs]}
    row = built.first()
    assert row.receiver == f"{row.contact.first_name} {row.contact.last_name}" and row.receiver_age == row.contact.age


def test_draws_of_null_keys(spark):
    from tidemail.functions.rand import hash_hex
    df = spark.createDataFrame([(None,), (5,), (-1,)], "k long")
    old = F.md5(F.concat_ws(":", F.lit("42"), F.lit("a.b"), F.col("k").cast("string")))
    assert all(a == b for a, b in df.select(hash_hex(42, "a.b", "k"), old).collect())
