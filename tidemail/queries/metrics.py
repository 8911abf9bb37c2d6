"""Evaluation and timing queries (A2–A4 on ``labels``, A11 on ``events``).

``labels.quality`` stands in for the true class and ``labels.toxic`` for the
prediction, so the metric operators get a full SQL oracle without a model.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemail.operators import metrics as m
from tidemail.queries import sqlfrag as s
from tidemail.registry import register
from tidemail.sources.tables import table


@register("eval_accuracy", """
SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy,
       count(*) AS n_rows
FROM labels
""")
def eval_accuracy(spark, sf_dir):
    a = m.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")
    return a.select(F.round("accuracy", 6).alias("accuracy"), "n_rows")


@register("eval_confusion", """
WITH lab AS (SELECT quality AS x FROM labels UNION SELECT toxic FROM labels),
cells AS (SELECT quality AS y, toxic AS p, count(*) AS n FROM labels GROUP BY ALL)
SELECT a.x AS true_label, b.x AS pred_label, coalesce(c.n, 0)::BIGINT AS n
FROM lab a CROSS JOIN lab b LEFT JOIN cells c ON c.y = a.x AND c.p = b.x
""")
def eval_confusion(spark, sf_dir):
    return m.confusion_matrix(table(spark, sf_dir, "labels"), "quality", "toxic")


@register("eval_report", "WITH " + s.report_sql("labels", "quality", "toxic"))
def eval_report(spark, sf_dir):
    return m.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")


@register("timing_summary", """
WITH r AS (
  SELECT event_type, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 10),
s AS (SELECT event_type, count(*) AS n_runs, avg(value) AS mean_ms, stddev_pop(value) AS std_ms
      FROM r GROUP BY event_type)
SELECT event_type, n_runs, round(mean_ms, 6) AS mean_ms, round(std_ms, 6) AS std_ms,
       round(1000.0 / mean_ms, 6) AS throughput_per_s,
       round((SELECT mean_ms FROM s WHERE event_type = 'view') / mean_ms, 6) AS speedup
FROM s
""")
def timing_summary(spark, sf_dir):
    """``value`` as milliseconds, ``event_type`` as the device, the lowest
    10 ``event_id`` of each type as warm-ups, ``view`` as the baseline."""
    ev = table(spark, sf_dir, "events")
    return m.timing_summary(ev, "event_type", "value", "event_id", warmups=10, baseline="view")
