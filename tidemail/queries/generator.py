"""Generator queries (G1–G11, A10, F14–F17): one synthetic notice per order.

The oracles rebuild every draw in SQL from the same hash formula, so the
generated table is checked value by value.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemail.functions import text as tx
from tidemail.operators.profile import generation_yield
from tidemail.plans import generate as g
from tidemail.plans.order_mail import CARRIER_SHARES, CARRIERS, LANGUAGES, NOTICE_SHARES, NOTICE_SHARES_URGENT, NOTICES, order_mail_plan
from tidemail.queries import sqlfrag as s
from tidemail.registry import register
from tidemail.session import scratch_path
from tidemail.sources.sinks import write_artifacts
from tidemail.sources.tables import EMAILS_SQL, TEST_DOMAIN, emails, table

KEY = "o_orderkey"


def _u(name):
    return s.uniform(42, name, KEY)


def _lit(v):
    return s.q(v) if isinstance(v, str) else str(v)


def _list(values):
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _pick(values, name):
    return f"{_list(values)}[CAST(floor({_u(name)} * {len(values)}) AS BIGINT) + 1]"


def _weighted(values, weights, name):
    th = g.Category(values, weights).thresholds()
    parts = " ".join(f"WHEN {_u(name)} < '{t!r}'::DOUBLE THEN {_lit(v)}" for t, v in zip(th, values))
    return f"CASE {parts} ELSE {_lit(values[-1])} END"


def _depot(name="depot"):
    arms = " ".join(f"WHEN {s.q(k)} THEN {_list(v)}[CAST(floor({_u(name)} * {len(v)}) AS BIGINT) + 1]"
                    for k, v in CARRIERS.items())
    return f"CASE carrier {arms} END"


def _person_sql():
    def digits(f, n):
        return f"lpad(CAST(CAST(floor({_u('contact.' + f)} * {10 ** n}) AS BIGINT) AS VARCHAR), {n}, '0')"
    age = f"CAST(21 + floor({_u('contact.age')} * 50) AS BIGINT)"
    return f"""
  {age} AS age,
  {_pick(g.FIRST_NAMES, 'contact.first_name')} AS first_name,
  {_pick(g.LAST_NAMES, 'contact.last_name')} AS last_name,
  strftime(DATE '2025-01-01' - to_months(CAST(12 * {age} AS INTEGER))
           - to_days(CAST(floor({_u('contact.birthday')} * 364) + 1 AS INTEGER)), '%Y-%m-%d') AS birth_date,
  '555-01' || {digits('phone', 2)} AS phone_number,
  '000-' || {digits('ssn_a', 2)} || '-' || {digits('ssn_b', 4)} AS ssn,
  {digits('zipcode', 5)} AS zipcode"""


BASE_SQL = f"""
WITH b AS (SELECT o_orderkey, o_orderpriority FROM orders),
p AS (SELECT o_orderkey, o_orderpriority, {_person_sql()},
        {_weighted(list(CARRIERS), CARRIER_SHARES, 'carrier')} AS carrier,
        CASE WHEN o_orderpriority = '1-URGENT' THEN {_weighted(NOTICES, NOTICE_SHARES_URGENT, 'notice')}
             ELSE {_weighted(NOTICES, NOTICE_SHARES, 'notice')} END AS notice,
        {_pick(LANGUAGES, 'language')} AS language,
        CAST(round(1.0 + {_u('parcels')} * 5.0) AS BIGINT) AS parcels
      FROM b),
q AS (SELECT *, {_depot()} AS depot,
        first_name || ' ' || last_name AS receiver,
        TRY_CAST(CAST(age AS VARCHAR) AS INTEGER) AS receiver_age FROM p),
r AS (SELECT *,
        'Order ' || CAST(o_orderkey AS VARCHAR) || ': ' || upper(notice) AS title,
        'Hello ' || receiver || ', ' || CAST(parcels AS VARCHAR) || ' parcel(s) by ' || carrier || ' are ' || notice || '. '
          || CASE WHEN receiver_age IS NULL THEN NULL WHEN receiver_age < 40 THEN 'Track them in the app'
                  ELSE 'Call ' || depot END
          || ' or write to ' || lower({s.words('depot')}[2]) || '.'
          || lower(CASE WHEN len({s.words('depot')}) >= 1 THEN {s.words('depot')}[-1] END)
          || '@{TEST_DOMAIN}.' AS message,
        'Give a short title for a notice that order ' || CAST(o_orderkey AS VARCHAR) || ' is ' || notice || '.' AS title_prompt,
        'Tell ' || receiver || ', in language ' || language || ', that ' || CAST(parcels AS VARCHAR) || ' parcel(s) of order '
          || CAST(o_orderkey AS VARCHAR) || ' are ' || notice || ' at ' || depot || '. '
          || CASE WHEN receiver_age IS NULL THEN NULL WHEN receiver_age < 40 THEN 'Offer the app.' ELSE 'Offer a call.' END AS message_prompt
      FROM q)
"""


def _base(spark, sf_dir):
    # dozens of draws a row: spread an orders table that is one partition
    return table(spark, sf_dir, "orders", parallel=True).select(KEY, "o_orderpriority")


def _built(spark, sf_dir):
    return order_mail_plan(TEST_DOMAIN).build(_base(spark, sf_dir), KEY, 42)


@register("gen_samplers", BASE_SQL + """
SELECT o_orderkey, carrier, depot, notice, language, parcels FROM r
""")
def gen_samplers(spark, sf_dir):
    """G1 uniform, G2 weighted, G3 sub-category, G4 uniform int, G9 conditional."""
    return _built(spark, sf_dir).select(KEY, "carrier", "depot", "notice", "language", "parcels")


@register("gen_person", BASE_SQL + """
SELECT o_orderkey, age, first_name, last_name, birth_date, phone_number, ssn, zipcode FROM r
""")
def gen_person(spark, sf_dir):
    """Person struct fields (age range inclusive, birth date consistent)."""
    v = _built(spark, sf_dir)
    return v.select(KEY, *[F.col(f"contact.{f}").alias(f) for f in
                           ("age", "first_name", "last_name", "birth_date", "phone_number", "ssn", "zipcode")])


def _person_all_sql() -> str:
    """The fields of a person that :func:`_person_sql` leaves out."""
    c = lambda i: _list([x[i] for x in g.CITIES]) + f"[CAST(floor({_u('contact.city')} * {len(g.CITIES)}) AS BIGINT) + 1]"
    h = f"md5('42:contact.uuid:' || CAST({KEY} AS VARCHAR))"
    picks = {"bachelors_field": g.FIELDS, "education_level": g.EDUCATION, "ethnic_background": g.ETHNIC, "marital_status": g.MARITAL,
             "middle_name": g.MIDDLE_NAMES, "occupation": g.OCCUPATIONS, "sex": g.SEXES, "street_name": g.STREETS}
    unit = f"lpad(CAST(CAST(floor({_u('contact.unit_no')} * 100) AS BIGINT) AS VARCHAR), 2, '0')"
    return ",\n".join([f"{_pick(v, 'contact.' + k)} AS {k}" for k, v in picks.items()] + [
        f"{c(0)} AS city", f"{c(1)} AS state", f"{c(2)} AS county", "'USA' AS country", "'en_US' AS locale",
        f"lower({_pick(g.FIRST_NAMES, 'contact.first_name')} || '.' || {_pick(g.LAST_NAMES, 'contact.last_name')} || '@example.com') AS email_address",
        f"CAST(floor({_u('contact.street_number')} * 9000) + 100 AS BIGINT) AS street_number",
        f"CASE WHEN {_u('contact.unit')} < '0.3'::DOUBLE THEN 'Apt ' || {unit} END AS unit",
        "concat_ws('-', " + ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ") AS uuid"])


@register("gen_person_rest", f"SELECT {KEY}, {_person_all_sql()} FROM orders")
def gen_person_rest(spark, sf_dir):
    """The other 17 fields of the person struct."""
    v = order_mail_plan(TEST_DOMAIN).build(_base(spark, sf_dir), KEY, 42)
    shown = {"age", "first_name", "last_name", "birth_date", "phone_number", "ssn", "zipcode"}
    return v.select(KEY, *[F.col(f"contact.{f}").alias(f) for f in v.schema["contact"].dataType.names if f not in shown])


@register("gen_preview", BASE_SQL + """
SELECT o_orderkey, receiver, receiver_age, carrier, depot, notice, language, parcels, title, message
FROM r WHERE message IS NOT NULL AND o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)
""")
def gen_preview(spark, sf_dir):
    """O2: the records of the first ten orders."""
    return order_mail_plan(TEST_DOMAIN).preview_from(_base(spark, sf_dir), KEY, 10)


_GP_KINDS = {"receiver": "expression", "receiver_age": "expression", "carrier": "category", "depot": "subcategory", "notice": "category",
             "language": "category", "parcels": "uniform", "title": "llm-text", "message": "llm-text"}
#: Types as DuckDB names them, for the profile's own names.
_GP_TYPES = ("(VALUES ('VARCHAR', 'string', 'string'), ('BIGINT', 'int64', 'int'), ('INTEGER', 'int32', 'int')) AS k(duck, pyarrow_dtype, simple_dtype)")


@register("gen_column_types", BASE_SQL + ", t AS (" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column_name, any_value(typeof({c})) AS duck, '{k if k not in ('category', 'subcategory', 'uniform') else 'sampler'}' AS column_type, "
    f"{s.q(k) if k in ('category', 'subcategory', 'uniform') else 'NULL'} AS sampler_type FROM r" for c, k in _GP_KINDS.items()) + f""")
SELECT column_name, pyarrow_dtype, simple_dtype, column_type, sampler_type FROM t JOIN {_GP_TYPES} USING (duck)
""")
def gen_column_types(spark, sf_dir):
    """Engine type, simple type and declared kinds in the profile of the generated table."""
    doc = gen_profile(spark, sf_dir)
    c = doc.select(F.explode("column_statistics").alias("c"))
    return c.select(*[F.col(f"c.{f}").alias(f) for f in ("column_name", "pyarrow_dtype", "simple_dtype", "column_type", "sampler_type")])


@register("artifact_sink", BASE_SQL + """
SELECT o_orderkey, title, (SELECT count(*) FROM r WHERE message IS NOT NULL) AS num_records, (SELECT count(*) FROM orders) AS target_num_records
FROM r WHERE message IS NOT NULL
""")
def artifact_sink(spark, sf_dir):
    """The table and its profile, both written as artifacts and read back."""
    base, plan = _base(spark, sf_dir), order_mail_plan(TEST_DOMAIN)
    path = scratch_path(spark, "artifacts")
    write_artifacts(plan.create_from(base, KEY, 42)[0], gen_profile(spark, sf_dir), path)
    profile = spark.read.json(f"{path}/analysis").select("num_records", "target_num_records")
    # the profile is one row
    return spark.read.parquet(f"{path}/dataset").select(KEY, "title").join(F.broadcast(profile))


@register("gen_expressions", BASE_SQL + """
SELECT o_orderkey, receiver, receiver_age, title, message FROM r
""")
def gen_expressions(spark, sf_dir):
    """G6/G7 (offline) with F15 interpolation, F16 conditionals, F14/F17 words, P10 cast."""
    return _built(spark, sf_dir).select(KEY, "receiver", "receiver_age", "title", "message")


@register("gen_prompts", BASE_SQL + """
SELECT o_orderkey, title_prompt, message_prompt FROM r
""")
def gen_prompts(spark, sf_dir):
    """The prompt that each text column is generated from."""
    texts = {x.name: x.sampler for x in order_mail_plan(TEST_DOMAIN).specs if isinstance(x.sampler, g.Text)}
    return _built(spark, sf_dir).select(KEY, *[t.prompt_column().alias(f"{n}_prompt") for n, t in texts.items()])


@register("gen_table", BASE_SQL + """
SELECT o_orderkey, receiver, receiver_age, carrier, depot, notice, language, parcels, title, message
FROM r WHERE message IS NOT NULL AND title IS NOT NULL AND receiver_age IS NOT NULL
""")
def gen_table(spark, sf_dir):
    """G11 + P9: kept records, helper columns dropped."""
    t, _ = order_mail_plan(TEST_DOMAIN).create_from(_base(spark, sf_dir), KEY, 42)
    return t


@register("gen_rejected", BASE_SQL + """
SELECT o_orderkey, 'message' AS failed_columns FROM r
WHERE message IS NULL OR title IS NULL OR receiver_age IS NULL
""")
def gen_rejected(spark, sf_dir):
    """Records whose generation failed, with the failed columns."""
    _, rej = order_mail_plan(TEST_DOMAIN).create_from(_base(spark, sf_dir), KEY, 42)
    return rej.select(KEY, F.array_join("failed_columns", ",").alias("failed_columns"))


@register("gen_yield", BASE_SQL + """
SELECT count(*) FILTER (WHERE message IS NOT NULL) AS num_records,
       count(*) AS target_num_records,
       round(count(*) FILTER (WHERE message IS NOT NULL) / count(*)::DOUBLE, 6) AS yield_ratio
FROM r
""")
def gen_yield(spark, sf_dir):
    """A10: generated vs. target records (target = one per order)."""
    base = _base(spark, sf_dir)
    t, _ = order_mail_plan(TEST_DOMAIN).create_from(base, KEY, 42)
    return generation_yield(t, base.select(F.count(F.lit(1))).scalar())


#: A structured notice; some are not what the schema declares.
_TICKET = ('{"carrier": "{{ carrier }}", "parcels": {% if parcels == 2 %}"{{ parcels }}"{% elif parcels == 5 %}{{ parcels }}.5{% else %}{{ parcels }}{% endif %}'
           '{% if language != \'sv\' %}, "stop": {"depot": "{{ depot }}"{% if notice != \'delayed\' %}, "open": true{% endif %}}{% endif %}, "lang": ["{{ language }}"]}')
_TICKET_KIND = "carrier string, parcels bigint, stop struct<depot:string,open:boolean>, lang array<string>"
_TICKET_RULES = {"parcels": g.js.Rule(low=1, high=4), "lang[]": g.js.Rule(choices=("en", "nl", "sv")), "carrier": g.js.Rule(high=10)}


def _ticket_sql() -> str:
    """The same texts, judged by DuckDB's own JSON functions."""
    return BASE_SQL + """,
t AS (SELECT *, '{"carrier": "' || carrier || '", "parcels": '
    || CASE WHEN parcels = 2 THEN '"2"' WHEN parcels = 5 THEN '5.5' ELSE CAST(parcels AS VARCHAR) END
    || CASE WHEN language <> 'sv' THEN ', "stop": {"depot": "' || depot || '"'
         || CASE WHEN notice <> 'delayed' THEN ', "open": true' ELSE '' END || '}' ELSE '' END
    || ', "lang": ["' || language || '"]}' AS j FROM r),
w AS (SELECT *, CASE
    WHEN json_type(j, '$.carrier') IS NULL THEN 'carrier: missing'
    WHEN length(json_extract_string(j, '$.carrier')) > 10 THEN 'carrier: length over 10'
    WHEN json_type(j, '$.parcels') IS NULL THEN 'parcels: missing'
    WHEN json_type(j, '$.parcels') NOT IN ('UBIGINT', 'BIGINT') THEN 'parcels: not bigint'
    WHEN CAST(json_extract(j, '$.parcels') AS BIGINT) < 1 THEN 'parcels: under 1'
    WHEN CAST(json_extract(j, '$.parcels') AS BIGINT) > 4 THEN 'parcels: over 4'
    WHEN json_type(j, '$.stop') IS NULL THEN 'stop: missing'
    WHEN json_type(j, '$.stop.depot') IS NULL THEN 'stop.depot: missing'
    WHEN json_type(j, '$.stop.open') IS NULL THEN 'stop.open: missing'
    WHEN len(list_filter(CAST(json_extract(j, '$.lang') AS VARCHAR[]), lambda x: x NOT IN ('en', 'nl', 'sv'))) > 0 THEN 'lang[]: not a choice' END AS why FROM t)
"""


def _ticket_plan():
    return order_mail_plan(TEST_DOMAIN).add("ticket", g.Structured("A ticket for order {{ o_orderkey }}.", response=_TICKET, schema=_TICKET_KIND,
                                                                   rules=_TICKET_RULES))


@register("gen_structured", _ticket_sql() + """
SELECT o_orderkey, json_extract_string(j, '$.carrier') AS carrier, CAST(json_extract(j, '$.parcels') AS BIGINT) AS parcels,
       json_extract_string(j, '$.stop.depot') AS depot, CAST(json_extract(j, '$.stop.open') AS BOOLEAN) AS open,
       json_extract_string(j, '$.lang[0]') AS lang
FROM w WHERE why IS NULL AND message IS NOT NULL
""")
def gen_structured(spark, sf_dir):
    """Structured values that fit their declared schema."""
    kept, _ = _ticket_plan().create_from(_base(spark, sf_dir), KEY, 42)
    return kept.select(KEY, "ticket.carrier", "ticket.parcels", F.col("ticket.stop.depot").alias("depot"), F.col("ticket.stop.open").alias("open"),
                       F.col("ticket.lang")[0].alias("lang"))


@register("gen_structured_rejected", _ticket_sql() + """
SELECT o_orderkey, coalesce('ticket: ' || why, '') AS reasons,
       concat_ws(',', CASE WHEN message IS NULL THEN 'message' END, CASE WHEN why IS NOT NULL THEN 'ticket' END) AS failed_columns
FROM w WHERE why IS NOT NULL OR message IS NULL
""")
def gen_structured_rejected(spark, sf_dir):
    """Values that do not, with the first complaint."""
    _, rejected = _ticket_plan().create_from(_base(spark, sf_dir), KEY, 42)
    return rejected.select(KEY, F.array_join("reasons", ",").alias("reasons"), F.array_join("failed_columns", ",").alias("failed_columns"))


def _lookup_plan(spark, sf_dir):
    return (g.Plan().add("part", g.CategoryTable(table(spark, sf_dir, "part"), "p_partkey", "p_size"))
            .add("nation", g.CategoryTable(table(spark, sf_dir, "supplier"), "s_nationkey"))
            .add("supplier", g.SubcategoryTable("nation", table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey")))


@register("gen_lookup", f"""
WITH o AS (SELECT o_orderkey, {_u('part')} AS u1, {_u('nation')} AS u2, {_u('supplier')} AS u3 FROM orders),
pv AS (SELECT p_partkey AS v, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS DOUBLE) / CAST(sum(p_size) OVER () AS DOUBLE) AS high FROM part),
nc AS (SELECT s_nationkey AS v, count(*) AS n FROM supplier GROUP BY ALL),
nv AS (SELECT v, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS high FROM nc),
sv AS (SELECT s_nationkey AS parent, list(s_suppkey ORDER BY s_suppkey) AS vs FROM supplier GROUP BY ALL),
a AS (SELECT o.*, pv.v AS part FROM o ASOF JOIN pv ON o.u1 < pv.high),
b AS (SELECT a.*, nv.v AS nation FROM a ASOF JOIN nv ON a.u2 < nv.high)
SELECT o_orderkey, part, nation, vs[CAST(floor(u3 * len(vs)) AS BIGINT) + 1] AS supplier FROM b JOIN sv ON parent = nation
""")
def gen_lookup(spark, sf_dir):
    """G2, G3 from tables: a part by its size, a nation by its suppliers, one of these."""
    kept, _ = _lookup_plan(spark, sf_dir).create_from(_base(spark, sf_dir).select(KEY), KEY, 42)
    return kept


@register("staff_email", f"""
SELECT mail_id,
       {s.words('subject')}[1] AS first_word,
       lower({s.words('subject')}[2]) AS second_word,
       CASE WHEN len({s.words('subject')}) >= 1 THEN {s.words('subject')}[-1] END AS last_word,
       lower({s.words('subject')}[2] || '.' || CASE WHEN len({s.words('subject')}) >= 1
             THEN {s.words('subject')}[-1] END || '@{TEST_DOMAIN}') AS contact
FROM {EMAILS_SQL} e
""")
def staff_email(spark, sf_dir):
    """F14 / F17 on the first line of every mail."""
    e = emails(spark, sf_dir, labelled=False)
    return e.select("mail_id", tx.word_at("subject", 0).alias("first_word"),
                    F.lower(tx.word_at("subject", 1)).alias("second_word"),
                    tx.word_at("subject", -1).alias("last_word"),
                    tx.staff_email("subject", TEST_DOMAIN).alias("contact"))


@register("gen_profile")
def gen_profile(spark, sf_dir):
    """A5–A10 as one profile document of the generated table (the S9 artifact)."""
    from tidemail.plans.report import profile_columns, profile_document
    base = _base(spark, sf_dir)
    plan = order_mail_plan(TEST_DOMAIN)
    full = plan.build(base, KEY, 42)
    built = g.keep_rows(full, F.col("message").isNotNull(), profile_columns(plan))
    return profile_document(plan, built, base.select(F.count(F.lit(1))).scalar())


_GP_CATS = ["carrier", "depot", "notice", "language"]
_GP_TEXTS = ["title", "message"]
_GP_COLS = ["receiver", "receiver_age", "carrier", "depot", "notice", "language", "parcels", "title", "message"]


def _gp_sql() -> str:
    t = "(SELECT * FROM r WHERE message IS NOT NULL)"
    counts = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS num_records, count(*) - count({c}) AS num_null, "
        f"count(DISTINCT {c}) AS num_unique FROM {t} x" for c in _GP_COLS)
    vc = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} x "
        f"WHERE {c} IS NOT NULL GROUP BY ALL" for c in _GP_CATS)
    toks = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(avg(len({s.tokens(c)}))::DOUBLE, 2) AS completion_tokens_mean, "
        f"round(median(len({s.tokens(c)}))::DOUBLE, 2) AS completion_tokens_median, "
        f"round(stddev_samp(len({s.tokens(c)}))::DOUBLE, 2) AS completion_tokens_stddev FROM {t} x"
        for c in _GP_TEXTS)
    return BASE_SQL + f""",
cnt AS ({counts}),
vc AS ({vc}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v ASC) AS r1,
                     row_number() OVER (PARTITION BY column_name ORDER BY n ASC, v DESC) AS r2 FROM vc),
cat AS (SELECT column_name, max(CASE WHEN r1 = 1 THEN v END) AS most_common_value,
               max(CASE WHEN r2 = 1 THEN v END) AS least_common_value,
               string_agg(v || '=' || CAST(n AS VARCHAR), '|' ORDER BY r1) AS histogram
        FROM ranked GROUP BY column_name),
num AS (SELECT 'parcels' AS column_name, round(min(parcels)::DOUBLE, 2) AS num_min, round(max(parcels)::DOUBLE, 2) AS num_max,
               round(avg(parcels)::DOUBLE, 2) AS num_mean, round(stddev_samp(parcels)::DOUBLE, 2) AS num_stddev,
               round(median(parcels)::DOUBLE, 2) AS num_median FROM {t} x),
tok AS ({toks})
SELECT cnt.column_name, cnt.num_records, cnt.num_null, cnt.num_unique,
       CASE WHEN cat.column_name IS NOT NULL THEN 'categorical'
            WHEN num.column_name IS NOT NULL THEN 'numerical' END AS distribution_type,
       cat.most_common_value, cat.least_common_value, cat.histogram,
       num.num_min, num.num_max, num.num_mean, num.num_stddev, num.num_median,
       tok.completion_tokens_mean, tok.completion_tokens_median, tok.completion_tokens_stddev
FROM cnt LEFT JOIN cat USING (column_name) LEFT JOIN num USING (column_name) LEFT JOIN tok USING (column_name)
"""


@register("gen_profile_columns", _gp_sql())
def gen_profile_columns(spark, sf_dir):
    """The profile document of the generated table, one row per
    column (counts, distribution kind, most / least common value, the whole
    histogram in rank order, numerical summary, completion-token statistics)."""
    doc = gen_profile(spark, sf_dir)
    c = doc.select(F.explode("column_statistics").alias("c")).select("c.*")
    cat = F.from_json("distribution", "most_common_value string, least_common_value string, "
                                      "histogram struct<categories: array<string>, counts: array<bigint>>")
    num = F.from_json("distribution", "min double, max double, mean double, stddev double, median double")
    c = c.withColumns({"__cat": F.when(F.col("distribution_type") == "categorical", cat),
                       "__num": F.when(F.col("distribution_type") == "numerical", num)})
    hist = F.array_join(F.zip_with("__cat.histogram.categories", "__cat.histogram.counts",
                                   lambda v, n: F.concat(v, F.lit("="), n.cast("string"))), "|")
    return c.select("column_name", "num_records", "num_null", "num_unique", "distribution_type",
                    F.col("__cat.most_common_value").alias("most_common_value"),
                    F.col("__cat.least_common_value").alias("least_common_value"),
                    hist.alias("histogram"),
                    *[F.col(f"__num.{m}").alias(f"num_{m}") for m in ("min", "max", "mean", "stddev", "median")],
                    "completion_tokens_mean", "completion_tokens_median", "completion_tokens_stddev")
