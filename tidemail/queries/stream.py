"""Streaming queries (T1, T2): the intake records of ``emails`` are written as
JSON lines into a fresh folder of the shared checkpoint area, scored by the
streaming job (``availableNow``), and the sinks are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemail.queries.intake import INTAKE_SQL, intake_json
from tidemail.queries import sqlfrag as s
from tidemail.queries.verdicts import _trained
from tidemail.registry import register
from tidemail.session import scratch_path
from tidemail.sources.tables import TEST_DOMAIN
from tidemail.streaming.score_stream import read_committed, score_stream


def _run(spark, sf_dir):
    base = scratch_path(spark, "stream")
    intake_json(spark, sf_dir).select("payload").write.mode("overwrite").text(f"{base}/in")
    model = _trained(spark, sf_dir)
    q = score_stream(spark, f"{base}/in", model, f"{base}/out", f"{base}/rejected", f"{base}/ckpt",
                     TEST_DOMAIN, available_now=True)
    q.awaitTermination()
    return base


@register("stream_rules", INTAKE_SQL + f"""
, ok AS (SELECT payload ->> '$.subject' AS subject, payload ->> '$.sender' AS sender,
                payload ->> '$.body' AS body, payload ->> '$.url' AS url FROM r WHERE reason IS NULL)
SELECT CAST(regexp_extract(url, '(\\d+)$', 1) AS BIGINT) AS mail_id,
       {s.sender_domain('sender')} AS domain, {s.is_trusted('sender')} AS trusted,
       CASE WHEN {s.is_trusted('sender')} THEN 'This email was sent from an official {TEST_DOMAIN} account'
            ELSE 'This email was NOT sent from an official {TEST_DOMAIN} account' END AS sender_line,
       length(subject || ' ' || body) AS text_chars
FROM ok
""")
def stream_rules(spark, sf_dir):
    """Rule columns of the streamed verdicts (exact); the model columns
    are present in the sink as well."""
    base = _run(spark, sf_dir)
    out, _ = read_committed(spark, f"{base}/out", f"{base}/rejected")
    return out.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("mail_id"),
                      "domain", "trusted", "sender_line",
                      F.length(F.concat_ws(" ", "subject", "body")).cast("bigint").alias("text_chars"))


@register("stream_rejects", INTAKE_SQL + """
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason
""")
def stream_rejects(spark, sf_dir):
    """Records answered apart, counted per reason."""
    base = _run(spark, sf_dir)
    _, rej = read_committed(spark, f"{base}/out", f"{base}/rejected")
    return rej.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
