"""Corpus queries: mail text, cleaning, sender rules, splits, counts, row index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemail.functions import sender as snd
from tidemail.functions import text as tx
from tidemail.operators import sampling
from tidemail.operators.counts import corpus_counts
from tidemail.queries import sqlfrag as s
from tidemail.registry import register
from tidemail.sources.tables import TEST_DOMAIN, emails, table

E = s.EMAILS_SQL


def mail_split_summary(spark, sf_dir):
    """Flagship: emails → training text → JS cleaning → sender trust → M1 split
    → counts per split × trusted × label (map-side partial aggregation)."""
    e = emails(spark, sf_dir, parallel=True)
    t = (e.select("mail_id", "label", "sender",
                  tx.clean_body(tx.training_text("subject", "body")).alias("clean"))
         .withColumn("trusted", snd.is_trusted("sender", TEST_DOMAIN)))
    t = sampling.split(t, "mail_id", 0.2, 42)
    return (t.groupBy("split", "trusted", "label")
            .agg(F.count(F.lit(1)).alias("n_mails"),
                 F.sum(F.length("clean")).cast("bigint").alias("clean_chars")))


register("mail_split_summary", f"""
SELECT CASE WHEN {s.uniform(42, 'split', 'mail_id')} < 0.2 THEN 'test' ELSE 'train' END AS split,
       {s.is_trusted('sender')} AS trusted,
       label,
       count(*) AS n_mails,
       CAST(sum(length({s.clean_body(s.training_text('subject', 'body'))})) AS BIGINT) AS clean_chars
FROM {E} e
GROUP BY ALL
""")(mail_split_summary)


@register("mail_text", f"""
SELECT mail_id,
       {s.training_text('subject', 'body')} AS text,
       coalesce(body, '') AS body_text,
       coalesce(nullif(subject, ''), 'Subject not found') || ' ' || coalesce(nullif(body, ''), 'Body not found') AS scoring_text
FROM {E} e
""")
def mail_text(spark, sf_dir):
    """P2 / P3 / P5 with F1 fallbacks ahead of the scoring text."""
    e = emails(spark, sf_dir, labelled=False)
    return e.select(
        "mail_id",
        tx.training_text("subject", "body").alias("text"),
        tx.body_text("body").alias("body_text"),
        tx.scoring_text(tx.or_default("subject", "Subject not found"),
                        tx.or_default("body", "Body not found")).alias("scoring_text"))


@register("mail_clean", f"""
SELECT mail_id,
       {s.js_trim("coalesce(nullif(subject, ''), 'Sender not found')")} AS subject_clean,
       {s.js_trim("coalesce(nullif(sender, ''), 'Sender not found')")} AS sender_clean,
       {s.clean_body("coalesce(nullif(body, ''), 'Body not found')")} AS body_clean,
       {s.collapse_newlines('body')} AS body_newlines,
       {s.collapse_ws('body')} AS body_ws
FROM {E} e
""")
def mail_clean(spark, sf_dir):
    """F1–F4 as the capture step applies them (subject fallback text kept as given)."""
    e = emails(spark, sf_dir, parallel=True, labelled=False)
    return e.select(
        "mail_id",
        tx.js_trim(tx.or_default("subject", "Sender not found")).alias("subject_clean"),
        tx.js_trim(tx.or_default("sender", "Sender not found")).alias("sender_clean"),
        tx.clean_body(tx.or_default("body", "Body not found")).alias("body_clean"),
        tx.collapse_newlines("body").alias("body_newlines"),
        tx.collapse_ws("body").alias("body_ws"))


@register("sender_rules", f"""
SELECT mail_id, sender,
       {s.sender_domain('sender')} AS domain,
       {s.is_trusted('sender')} AS trusted,
       coalesce(CASE WHEN coalesce(strpos(sender, '<') > 0 AND strpos(sender, '@') > 0, false)
                      AND len(string_split(string_split(string_split(sender, '<')[2], '>')[1], '@')) >= 2
                     THEN string_split(string_split(string_split(sender, '<')[2], '>')[1], '@')[-1] END
                = '{TEST_DOMAIN}', false) AS trusted_strict
FROM {E} e
""")
def sender_rules(spark, sf_dir):
    """F5 / F6 (and the strict variant) per mail."""
    e = emails(spark, sf_dir, labelled=False)
    return e.select("mail_id", "sender",
                    snd.sender_domain("sender").alias("domain"),
                    snd.is_trusted("sender", TEST_DOMAIN).alias("trusted"),
                    snd.is_trusted("sender", TEST_DOMAIN, strict=True).alias("trusted_strict"))


@register("training_view", f"""
SELECT {s.training_text('subject', 'body')} AS text, label FROM {E} e
""")
def training_view(spark, sf_dir):
    """The ``text, label`` table the trainer consumes."""
    from tidemail.sources.csv import with_text
    return with_text(emails(spark, sf_dir)).select("text", "label")


@register("split_assign", f"""
SELECT mail_id, label,
       CASE WHEN {s.uniform(42, 'split', 'mail_id')} < 0.2 THEN 'test' ELSE 'train' END AS split
FROM {E} e
""")
def split_assign(spark, sf_dir):
    """M1: map-only 80/20 split on a stable key."""
    return sampling.split(emails(spark, sf_dir).select("mail_id", "label"), "mail_id", 0.2, 42)


@register("holdout_rows", f"""
SELECT mail_id, {s.training_text('subject', 'body')} AS text, label
FROM {E} e WHERE {s.uniform(42, 'split', 'mail_id')} < 0.2
""")
def holdout_rows(spark, sf_dir):
    """M3: the same test rows, re-derived from a fresh load."""
    e = emails(spark, sf_dir).select("mail_id", tx.training_text("subject", "body").alias("text"), "label")
    return sampling.holdout(e, "mail_id", 0.2, 42)


@register("split_exact", f"""
SELECT mail_id, {s.training_text('subject', 'body')} AS text,
       CASE WHEN row_number() OVER (ORDER BY {s.uniform(42, 'split', 'mail_id')}, mail_id) - 1
                 < ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
FROM {E} e
""")
def split_exact(spark, sf_dir):
    """M2: exactly ceil(0.2 n) test rows, whole mails."""
    e = emails(spark, sf_dir, labelled=False).select("mail_id", tx.training_text("subject", "body").alias("text"))
    return sampling.split_exact(e, "mail_id", 0.2, 42)


@register("shuffle_order", """
SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:shuffle:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS shuffle_pos
FROM documents
""")
def shuffle_order(spark, sf_dir):
    """M4: seeded permutation position of every document."""
    return sampling.shuffle(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 42)


@register("row_index", """
SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS "index", doc_id, source, text FROM documents
""")
def row_index(spark, sf_dir):
    """0-based index in (source, doc_id) order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return sampling.with_row_index(d, ["source", "doc_id"], "index")


@register("corpus_counts", """
SELECT source, grouping(source) = 1 AS is_total, count(*) AS n_rows
FROM documents GROUP BY ROLLUP (source)
""")
def corpus_counts_q(spark, sf_dir):
    """A1: rows per source and in total."""
    return corpus_counts(table(spark, sf_dir, "documents"), "source")
