"""CSV round trips (S1–S3, S5, S6, U1, P1): the ``emails`` view is written
as CSV parts into a fresh folder of the shared checkpoint area and read back
with the pandas-compatible reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemail.functions.text import NA_TOKENS
from tidemail.queries import sqlfrag as s
from tidemail.registry import register
from tidemail.session import scratch_path
from tidemail.sources import csv as cs
from tidemail.sources.sinks import read_pages, read_parts
from tidemail.sources.tables import EMAILS_SQL, emails

_NA = ", ".join(s.q(t) for t in NA_TOKENS)


def _na(c):
    return f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END"


@register("csv_roundtrip", f"""
SELECT mail_id, {_na('subject')} AS subject, {_na('body')} AS body, label FROM {EMAILS_SQL} e
""")
def csv_roundtrip(spark, sf_dir):
    """S5 then S1 + S2: values survive byte-exact; NA strings become null."""
    base = scratch_path(spark, "csv")
    cs.write_csv_parts(emails(spark, sf_dir).select("mail_id", "subject", "body", "label"), f"{base}/parts")
    back = cs.read_mail_csv(spark, f"{base}/parts")
    return back.select(F.col("mail_id").cast("bigint"), "subject", "body", F.col("label").cast("int"))


@register("parts_scan", f"""
SELECT mail_id, subject, body, sender, label FROM {EMAILS_SQL} e
""")
def parts_scan(spark, sf_dir):
    """A folder of Parquet parts, read as one table."""
    path = scratch_path(spark, "parts")
    emails(spark, sf_dir).select("mail_id", "subject", "body", "sender", "label").repartition(5).write.parquet(path)
    return read_parts(spark, path)


@register("pages_scan", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n_chars, md5(html) AS html_md5 FROM pages")
def pages_scan(spark, sf_dir):
    """HTML documents as rows."""
    pages = read_pages(spark, f"{sf_dir.rstrip('/')}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("html_md5"))


@register("csv_merge_index", f"""
SELECT row_number() OVER (ORDER BY mail_id) - 1 AS "index", mail_id, {_na('subject')} AS subject,
       {_na('body')} AS body, label
FROM {EMAILS_SQL} e
""")
def csv_merge_index(spark, sf_dir):
    """Parts merged into one CSV with a leading unnamed 0-based index."""
    base = scratch_path(spark, "csvmerge")
    cs.write_csv_parts(emails(spark, sf_dir).select("mail_id", "subject", "body", "label"), f"{base}/parts")
    cs.merge_csv(spark, f"{base}/parts", f"{base}/merged", order=[F.col("mail_id").cast("bigint")])
    back = cs.read_mail_csv(spark, f"{base}/merged")
    idx = back.columns[0]
    return back.select(F.col(f"`{idx}`").cast("bigint").alias("index"),
                       F.col("mail_id").cast("bigint"), "subject", "body", F.col("label").cast("int"))


@register("csv_corpus", f"""
WITH e AS (SELECT e.*, d.lang FROM {EMAILS_SQL} e JOIN documents d ON d.doc_id = e.mail_id)
SELECT coalesce({_na('subject')}, '') || ' ' || coalesce({_na('body')}, '') AS text, label, 'a' AS file
FROM e WHERE lang = 'en'
UNION ALL
SELECT coalesce({_na('body')}, '') AS text, label, 'b' AS file FROM e WHERE lang <> 'en'
""")
def csv_corpus(spark, sf_dir):
    """S3 + P1–P4 + U1: two CSV files with different headers (English mails
    with ``subject, body, label``; the rest with ``body, label`` only), each
    read with its own header, turned into ``text, label``, then unioned."""
    base = scratch_path(spark, "corpus")
    e = emails(spark, sf_dir, keep=("lang",))
    cs.write_csv_parts(e.filter(F.col("lang") == "en").select("subject", "body", "label"), f"{base}/a")
    cs.write_csv_parts(e.filter(F.col("lang") != "en").select("body", "label"), f"{base}/b")
    c = cs.read_corpus(spark, [f"{base}/a", f"{base}/b"])
    return c.select("text", "label", F.element_at(F.split("source", "/"), -1).alias("file"))
