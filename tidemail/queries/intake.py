"""Intake queries (S7, P7, P8): JSON mail records built from ``emails`` with
seeded defects, and URL gates on ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemail.operators.gates import gate_by_url, match_pattern_table, match_patterns
from tidemail.sources.requests import parse_requests
from tidemail.sources.tables import EMAILS_SQL, emails, table
from tidemail.registry import register


def intake_json(spark, sf_dir):
    """One JSON record per mail; defects by ``mail_id``: %7 number subject,
    %11 no sender, %13 null body, %19 not JSON, %23 an ``{"error"}`` object."""
    e = emails(spark, sf_dir, labelled=False)
    m = F.col("mail_id")
    url = F.concat(F.lit("https://mail.example.com/inbox/"), m.cast("string"))
    opts = {"ignoreNullFields": "false"}
    normal = F.to_json(F.struct("subject", "sender", "body", url.alias("url")), opts)
    payload = (F.when(m % 19 == 0, F.lit("not json"))
               .when(m % 23 == 0, F.to_json(F.struct(F.lit("boom").alias("error"))))
               .when(m % 7 == 0, F.to_json(F.struct(m.alias("subject"), "sender", "body"), opts))
               .when(m % 11 == 0, F.to_json(F.struct("subject", "body"), opts))
               .when(m % 13 == 0, F.to_json(F.struct("subject", "sender", F.lit(None).cast("string")
                                                     .alias("body")), opts))
               .otherwise(normal))
    return e.select("mail_id", payload.alias("payload"))


INTAKE_SQL = f"""
WITH e AS (SELECT * FROM {EMAILS_SQL} x),
j AS (
  SELECT mail_id,
         CASE WHEN mail_id % 19 = 0 THEN 'not json'
              WHEN mail_id % 23 = 0 THEN json_object('error', 'boom')::VARCHAR
              WHEN mail_id % 7 = 0 THEN json_object('subject', mail_id, 'sender', sender, 'body', body)::VARCHAR
              WHEN mail_id % 11 = 0 THEN json_object('subject', subject, 'body', body)::VARCHAR
              WHEN mail_id % 13 = 0 THEN json_object('subject', subject, 'sender', sender, 'body', NULL)::VARCHAR
              ELSE json_object('subject', subject, 'sender', sender, 'body', body,
                               'url', 'https://mail.example.com/inbox/' || CAST(mail_id AS VARCHAR))::VARCHAR
         END AS payload
  FROM e),
v AS (SELECT mail_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM j),
c AS (
  SELECT mail_id, payload,
         coalesce(json_type(payload) = 'OBJECT', false) AS is_obj,
         concat_ws(',',
           CASE WHEN coalesce(json_type(payload, '$.subject') = 'VARCHAR', false) THEN NULL ELSE 'subject' END,
           CASE WHEN coalesce(json_type(payload, '$.sender') = 'VARCHAR', false) THEN NULL ELSE 'sender' END,
           CASE WHEN coalesce(json_type(payload, '$.body') = 'VARCHAR', false) THEN NULL ELSE 'body' END) AS bad
  FROM v),
r AS (SELECT *, CASE WHEN NOT is_obj THEN 'invalid json'
                     WHEN bad <> '' THEN 'bad field: ' || bad END AS reason FROM c)
"""


@register("intake_valid", INTAKE_SQL + """
SELECT mail_id, payload ->> '$.subject' AS subject, payload ->> '$.sender' AS sender,
       payload ->> '$.body' AS body, payload ->> '$.timestamp' AS "timestamp", payload ->> '$.url' AS url
FROM r WHERE reason IS NULL
""")
def intake_valid(spark, sf_dir):
    """S7 valid side: all three fields present and strings."""
    valid, _ = parse_requests(intake_json(spark, sf_dir), "payload", keep=["mail_id"])
    return valid


@register("intake_rejected", INTAKE_SQL + """
SELECT mail_id, reason FROM r WHERE reason IS NOT NULL
""")
def intake_rejected(spark, sf_dir):
    """S7 reject side (the HTTP 422 answers of the original service)."""
    _, rej = parse_requests(intake_json(spark, sf_dir), "payload", keep=["mail_id"])
    return rej.select("mail_id", "reason")


@register("url_gate", """
SELECT page_id, url, coalesce(contains(url, 'blog'), false) AS kept,
       CASE WHEN coalesce(contains(url, 'blog'), false) THEN NULL
            ELSE 'URL outside blog' END AS message
FROM pages
""")
def url_gate(spark, sf_dir):
    """Keep pages whose URL contains a needle (case-sensitive); the rest get
    a fixed message.  Kept and refused are returned together with a flag."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    kept, refused = gate_by_url(p, "url", "blog", message="URL outside blog")
    return (kept.select("page_id", "url", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("message"))
            .unionByName(refused.select("page_id", "url", F.lit(False).alias("kept"), "message")))


PATTERNS = ["https://blog.*.example.com/*", "https://m.*/*", "http://*.example.org/*"]


@register("url_patterns", """
SELECT page_id, url,
       coalesce(regexp_matches(url, '^https://blog\\.[^/?#@]*\\.example\\.com/.*$')
             OR regexp_matches(url, '^https://m\\.[^/?#@]*/.*$')
             OR regexp_matches(url, '^http://[^/?#@]*\\.example\\.org/.*$'), false) AS allowed
FROM pages
""")
def url_patterns(spark, sf_dir):
    """Host allow-list in ``scheme://host/path`` wildcard patterns."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.withColumn("allowed", match_patterns("url", PATTERNS))


@register("url_allow_list", """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^:/]*://([^/]*)', 1) AS host FROM pages),
exact AS (SELECT DISTINCT host FROM p WHERE length(host) % 3 = 0),
inner_hosts AS (SELECT DISTINCT substr(host, strpos(host, '.') + 1) AS rest FROM p WHERE length(host) % 3 = 1),
ok AS (SELECT DISTINCT h.host FROM (SELECT DISTINCT host FROM p) h JOIN inner_hosts i ON ends_with(h.host, '.' || i.rest))
SELECT page_id, url, coalesce((starts_with(url, 'https://') AND host IN (SELECT host FROM exact)
                               OR starts_with(url, 'http://') AND host IN (SELECT host FROM ok))
                              AND regexp_matches(url, '^[^:/]*://[^/]*/'), false) AS allowed
FROM p
""")
def url_allow_list(spark, sf_dir):
    """P8 with a table of patterns, made of the pages' own hosts."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^[^:/]*://([^/]*)", 1)
    size = F.length(host) % 3
    exact = p.where(size == 0).select(F.concat(F.lit("https://"), host, F.lit("/*")).alias("pattern"))
    inner = p.where(size == 1).select(F.concat(F.lit("http://*."), F.expr("substring(regexp_extract(url, '^[^:/]*://([^/]*)', 1), "
                                      "instr(regexp_extract(url, '^[^:/]*://([^/]*)', 1), '.') + 1)"), F.lit("/*")).alias("pattern"))
    return match_pattern_table(p, "url", exact.unionByName(inner))

