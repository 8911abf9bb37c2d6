"""Verdict queries: F7–F11 and F18 rules (exact), model jobs L1–L4 (rows only)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemail.functions import sender as snd
from tidemail.functions import text as tx
from tidemail.functions import verdict as vd
from tidemail.operators import metrics, sampling
from tidemail.operators.bayes import score_bayes, train_bayes
from tidemail.operators.embedding import EmbedParams, load_embedding, save_embedding, score_embedding, train_embedding
from tidemail.operators.model import TrainParams, score
from tidemail.operators.pieces import corpus_pieces, load_pieces
from tidemail.plans import scoring
from tidemail.plans.model_store import ModelStore
from tidemail.queries import sqlfrag as s
from tidemail.registry import register
from tidemail.session import checkpoint_dir, scratch_path
from tidemail.sources.requests import parse_requests
from tidemail.sources.sinks import write_verdicts
from tidemail.sources.tables import EMAILS_SQL, TEST_DOMAIN, emails, table

ORG = TEST_DOMAIN


def _q(x):
    return s.q(x)


@register("verdict_rules", f"""
WITH e AS (SELECT * FROM {EMAILS_SQL} x),
v AS (SELECT mail_id, sender,
        CASE WHEN label = 1 THEN 'LABEL_1' WHEN mail_id % 3 = 0 THEN 'Safe' ELSE 'LABEL_0' END AS label_name,
        CAST(mail_id % 100 AS DOUBLE) / 100.0::DOUBLE AS score
      FROM e),
w AS (SELECT mail_id, label_name,
        label_name <> 'LABEL_0' AS phish,
        CAST(floor(score * 100.0::DOUBLE) AS BIGINT) AS accuracy,
        CASE WHEN label_name IN ('LABEL_0', 'Safe') THEN 0 ELSE 1 END AS eval_label,
        {s.is_trusted('sender')} AS trusted
      FROM v)
SELECT *,
  CASE WHEN phish THEN {_q(vd.HEADLINE_PHISH)} ELSE {_q(vd.HEADLINE_SAFE)} END AS headline,
  'Confidence: ' || CAST(accuracy AS VARCHAR) || '%' AS confidence_line,
  CASE WHEN phish THEN {_q(vd.PATTERN_PHISH)} ELSE {_q(vd.PATTERN_SAFE)} END AS pattern_line,
  CASE WHEN trusted THEN {_q(vd.SENDER_TRUSTED.format(org=ORG))}
       ELSE {_q(vd.SENDER_UNTRUSTED.format(org=ORG))} END AS sender_line
FROM w
""")
def verdict_rules(spark, sf_dir):
    """F7 confidence, F8 serving decode, F9 evaluation decode, F10 texts, F6 trust,
    on label names and scores derived from the labelled mails."""
    e = emails(spark, sf_dir)
    v = e.select("mail_id", "sender",
                 F.when(F.col("label") == 1, "LABEL_1").when(F.col("mail_id") % 3 == 0, "Safe")
                 .otherwise("LABEL_0").alias("label_name"),
                 ((F.col("mail_id") % 100).cast("double") / F.lit(100.0)).alias("score"))
    w = v.select("mail_id", "label_name",
                 vd.decode_serving("label_name").alias("phish"),
                 vd.confidence("score").alias("accuracy"),
                 vd.decode_eval("label_name").alias("eval_label"),
                 snd.is_trusted("sender", TEST_DOMAIN).alias("trusted"))
    return w.withColumns(vd.verdict_texts("phish", "accuracy", "trusted", ORG))


@register("iso_timestamps", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_iso FROM events
""")
def iso_timestamps(spark, sf_dir):
    """ISO-8601 with milliseconds and ``Z``."""
    return table(spark, sf_dir, "events").select("event_id", vd.iso_ts("ts").alias("ts_iso"))


@register("body_snippets", f"""
SELECT mail_id,
       CASE WHEN length(body) > 500 THEN substr(body, 1, 500) || '...' ELSE body END AS snippet,
       replace(replace(replace(replace(replace(
         CASE WHEN length(body) > 500 THEN substr(body, 1, 500) || '...' ELSE body END,
         '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS snippet_html
FROM {EMAILS_SQL} e
""")
def body_snippets(spark, sf_dir):
    """500-character snippet and its HTML-escaped form."""
    e = emails(spark, sf_dir, labelled=False)
    sn = tx.snippet("body", 500)
    return e.select("mail_id", sn.alias("snippet"), tx.escape_html(sn).alias("snippet_html"))


def _trained(spark, sf_dir):
    """The classifier trained on the 80 % side of ``emails``, or the stored model
    of the same rows."""
    params = TrainParams()
    rows = emails(spark, sf_dir).select("mail_id", "subject", "body", "label")
    return scoring.trained_model(spark, rows, params, lambda: scoring.train_split(rows, "mail_id", params))


@register("model_report")
def model_report(spark, sf_dir):
    """L1 + L3: train on the 80 % side, classification report on the hold-out."""
    e = emails(spark, sf_dir)
    model = _trained(spark, sf_dir)
    t = e.withColumn("text", tx.training_text("subject", "body"))
    return scoring.evaluate(model, t, "mail_id")["report"]


_VOCAB = 30522


def _embedding(spark, sf_dir):
    """The embedding classifier of the same split, or the stored one."""
    path, params = public_tokenizers.path("word_bpe_49k.json"), EmbedParams()
    rows = emails(spark, sf_dir, parallel=True).select("mail_id", tx.training_text("subject", "body").alias("text"), "label")
    train = sampling.split(rows, "mail_id").filter(F.col("split") == "train").drop("split")

    def fit():
        pieces = corpus_pieces(train, "text", load_pieces(path), _VOCAB)
        return train_embedding(train, "mail_id", pieces, params)
    store = ModelStore(spark, f"{checkpoint_dir(spark)}/models")
    model = store.train_once("embedding", train, (path, _VOCAB, params), fit, lambda m, f: save_embedding(m, spark, f), lambda f: load_embedding(spark, f))
    return model, sampling.holdout(rows, "mail_id")


def _checks(scored, labels):
    """What must hold for any model's verdicts on the labelled hold-out."""
    known = scored.filter(F.col("label").isNotNull())
    return known.agg(F.count("*").alias("n_rows"), F.count_distinct("mail_id").alias("n_mails"),
                     F.count(F.when(~F.col("label_name").isin(labels), 1)).alias("n_bad_labels"),
                     F.count(F.when(~F.coalesce(F.col("score").between(0.5, 1.0), F.lit(False)), 1)).alias("n_bad_scores"))


#: The row set is exact, the rest are bounds that hold for any trained model.
_CHECKS_SQL = f"""
WITH e AS (SELECT mail_id FROM {EMAILS_SQL} x WHERE {s.uniform(42, 'split', 'mail_id')} < 0.2 AND label IS NOT NULL)
SELECT count(*) AS n_rows, count(DISTINCT mail_id) AS n_mails, 0::BIGINT AS n_bad_labels, 0::BIGINT AS n_bad_scores FROM e
"""


@register("logistic_checks", _CHECKS_SQL)
def logistic_checks(spark, sf_dir):
    """L1–L3: hold-out rows, label set and score range of the logistic model."""
    e = emails(spark, sf_dir).withColumn("text", tx.training_text("subject", "body"))
    held = sampling.holdout(e, "mail_id").select("mail_id", "text", "label")
    return _checks(score(_trained(spark, sf_dir), held, "text"), ["LABEL_0", "LABEL_1"])


@register("embedding_checks", _CHECKS_SQL)
def embedding_checks(spark, sf_dir):
    """L1–L3: the same of the embedding model (epochs, batches, learning rate, weight decay)."""
    model, held = _embedding(spark, sf_dir)
    return _checks(score_embedding(model, held), ["LABEL_0", "LABEL_1"])


@register("embedding_report")
def embedding_report(spark, sf_dir):
    """L3: classification report of the embedding model on the hold-out."""
    model, held = _embedding(spark, sf_dir)
    scored = score_embedding(model, held.filter(F.col("label").isNotNull())).withColumn("prediction", vd.decode_eval("label_name"))
    return metrics.classification_report(scored, "label", "prediction")


@register("holdout_twins", f"""
WITH e AS (SELECT mail_id, label, md5({s.training_text('subject', 'body')}) AS h, {s.uniform(42, 'split', 'mail_id')} < 0.2 AS held FROM {EMAILS_SQL} x),
t AS (SELECT DISTINCT h FROM e WHERE NOT held AND label IS NOT NULL)
SELECT count(*) AS n_held, count(*) FILTER (WHERE h IN (SELECT h FROM t)) AS n_with_twin FROM e WHERE held AND label IS NOT NULL
""")
def holdout_twins(spark, sf_dir):
    """Beside any accuracy: labelled hold-out rows whose text is in the training side too."""
    e = emails(spark, sf_dir).select("mail_id", F.md5(tx.training_text("subject", "body")).alias("h"), "label").filter(F.col("label").isNotNull())
    side = sampling.split(e, "mail_id")
    # one row a text, so a text that a third of all mails share is one row of the join
    texts = side.groupBy("h").agg(F.count(F.when(F.col("split") == "test", 1)).alias("n_held"), F.max(F.col("split") == "train").alias("trained"))
    return texts.agg(F.coalesce(F.sum("n_held"), F.lit(0)).alias("n_held"),
                     F.coalesce(F.sum(F.when(F.col("trained"), F.col("n_held"))), F.lit(0)).alias("n_with_twin"))


@register("model_verdicts")
def model_verdicts(spark, sf_dir):
    """L2 + L4: verdicts for every valid intake record."""
    from tidemail.queries.intake import intake_json
    model = _trained(spark, sf_dir)
    valid, _ = parse_requests(intake_json(spark, sf_dir), "payload", keep=["mail_id"])
    out = scoring.analyze(model, valid, TEST_DOMAIN, texts=True)
    return out.select("mail_id", "phish", "accuracy", "trusted", "domain", "headline", "confidence_line")


_BAYES_SQL = f"""
e AS (SELECT mail_id, label, {s.uniform(42, 'split', 'mail_id')} < 0.2 AS held,
             {s.tokens(s.training_text('subject', 'body'))} AS toks FROM {EMAILS_SQL} x),
tr AS (SELECT label, unnest(toks) AS token FROM e WHERE NOT held AND label IS NOT NULL),
c AS (SELECT token, sum(label) AS n1, sum(1 - label) AS n0 FROM tr GROUP BY token),
k AS (SELECT ln((sum(n0) + count(*) + 1)::DOUBLE) - ln((sum(n1) + count(*) + 1)::DOUBLE) AS unseen FROM c),
pr AS (SELECT ln((sum(label) + 1)::DOUBLE / (sum(1 - label) + 1)) AS prior FROM e WHERE NOT held AND label IS NOT NULL),
te AS (SELECT mail_id, unnest(toks) AS token FROM e WHERE held),
o AS (SELECT mail_id, sum(k.unseen + coalesce(ln((n1 + 1)::DOUBLE / (n0 + 1)), 0)) AS odds
      FROM te LEFT JOIN c USING (token), k GROUP BY mail_id),
r AS (SELECT e.mail_id, e.label, coalesce(o.odds, 0) + pr.prior AS odds FROM e LEFT JOIN o USING (mail_id), pr WHERE held),
b AS (SELECT mail_id, label, CASE WHEN odds > 0 THEN 1 ELSE 0 END AS predicted_label,
             round(1 / (1 + exp(-abs(odds))), 6) AS score FROM r)
"""


def _bayes_scored(spark, sf_dir):
    e = emails(spark, sf_dir).select("mail_id", tx.training_text("subject", "body").alias("text"), "label")
    model = train_bayes(sampling.split(e, "mail_id").filter(F.col("split") == "train"))
    return score_bayes(model, sampling.holdout(e, "mail_id"), ["mail_id", "label"])


@register("bayes_verdicts", f"""
WITH {_BAYES_SQL}
SELECT mail_id, 'LABEL_' || predicted_label AS label_name, score, predicted_label = 1 AS phish,
       CAST(floor(score * 100.0::DOUBLE) AS BIGINT) AS accuracy
FROM b
""")
def bayes_verdicts(spark, sf_dir):
    """L1, L2, O3, L4 with the Naive Bayes model: trained on the 80 % side, a
    verdict for every mail of the hold-out."""
    scored = _bayes_scored(spark, sf_dir).withColumn("score", F.round("score", 6))
    return scored.select("mail_id", "label_name", "score", vd.decode_serving("label_name").alias("phish"),
                         vd.confidence("score").alias("accuracy"))


@register("verdict_sink", f"""
WITH {_BAYES_SQL}
SELECT b.mail_id, predicted_label = 1 AS phish, CAST(floor(score * 100.0::DOUBLE) AS BIGINT) AS accuracy, {s.is_trusted('sender')} AS org
FROM b JOIN (SELECT mail_id, sender FROM {EMAILS_SQL} x) m USING (mail_id)
""")
def verdict_sink(spark, sf_dir):
    """Verdict records written as JSON lines and read back."""
    senders = emails(spark, sf_dir, labelled=False).select("mail_id", snd.is_trusted("sender", TEST_DOMAIN).alias("trusted"))
    out = bayes_verdicts(spark, sf_dir).join(senders, "mail_id")
    path = scratch_path(spark, "verdicts")
    write_verdicts(out, path, keep=["mail_id"], trusted_as="org")
    return spark.read.schema("mail_id long, phish boolean, accuracy long, org boolean").json(path)


@register("bayes_report", f"""
WITH {_BAYES_SQL}, known AS (SELECT * FROM b WHERE label IS NOT NULL),
{s.report_sql('known', 'label', 'predicted_label')}
""")
def bayes_report(spark, sf_dir):
    """L1 + L3 with the Naive Bayes model: report on the labelled hold-out."""
    scored = _bayes_scored(spark, sf_dir).filter(F.col("label").isNotNull())
    return metrics.classification_report(scored.withColumn("prediction", vd.decode_eval("label_name")), "label", "prediction")
