"""Evaluation metrics (A2–A4) and the timing summary.

Everything starts from the cell counts ``groupBy(y, p).count()``, which Spark
aggregates map-side, so the shuffled data is (#classes² × #partitions) rows no
matter how many predictions there are or how skewed the classes are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """A2: share of rows where truth equals prediction."""
    hit = F.coalesce((F.col(y) == F.col(p)).cast("double"), F.lit(0.0))
    return df.agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_rows"))


def _cell_row(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: ``cells`` (array of (y, p, n), k² entries at most) and ``labels``
    (sorted union of both columns).  The only pass over the data is the
    partial-aggregated ``groupBy(y, p)``; everything after works on k² values."""
    cells = _cells(df, y, p).agg(F.collect_list(F.struct("y", "p", "n")).alias("cells"))
    labels = F.array_sort(F.array_distinct(F.flatten(F.transform("cells", lambda c: F.array(c["y"], c["p"])))))
    return cells.select("cells", labels.alias("labels"))


def confusion_matrix(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """A3: long form ``(true_label, pred_label, n)``; labels are the sorted union
    of both columns and zero cells are kept (k² rows)."""
    row = _cell_row(df, y, p)
    def key(a, b):
        return F.struct(a.alias("y"), b.alias("p"))
    lookup = F.map_from_entries(F.transform("cells", lambda c: F.struct(key(c["y"], c["p"]).alias("k"),
                                                                         c["n"].alias("v"))))
    grid = F.flatten(F.transform("labels", lambda t: F.transform("labels", lambda q: F.struct(
        t.alias("true_label"), q.alias("pred_label"),
        F.coalesce(F.element_at(lookup, key(t, q)), F.lit(0)).cast("bigint").alias("n")))))
    return row.select(F.inline(grid))


def per_class(df: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """Per class: support (true count), predicted count, true positives."""
    return _cell_row(df, y, p).select(F.inline(_per_class_array()))


def _per_class_array():
    def total(cond):
        return F.aggregate(F.filter("cells", cond), F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    return F.transform("labels", lambda lab: F.struct(
        lab.alias("cls"),
        total(lambda c: c["y"] == lab).alias("support"),
        total(lambda c: c["p"] == lab).alias("predicted"),
        total(lambda c: (c["y"] == lab) & (c["p"] == lab)).alias("tp")))


def _div(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_report(df: DataFrame, y: str = "label", p: str = "prediction",
                          digits: int = 6) -> DataFrame:
    """A4: precision, recall, F1 and support per class, then ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows; 0/0 counts as 0.0.

    One pass over the data (the cell counts); the per-class and summary rows
    are computed on that single bounded row."""
    row = _cell_row(df, y, p).select(_per_class_array().alias("pc"))

    def scores(c):
        prec = _div(c["tp"].cast("double"), c["predicted"])
        rec = _div(c["tp"].cast("double"), c["support"])
        return F.struct(c["cls"].cast("string").alias("label"), prec.alias("precision"), rec.alias("recall"),
                        _div(2 * prec * rec, prec + rec).alias("f1_score"), c["support"].alias("support"),
                        c["tp"].alias("tp"))
    row = row.select(F.transform("pc", scores).alias("cls"))
    tot = F.aggregate("cls", F.lit(0).cast("bigint"), lambda a, c: a + c["support"])
    tp = F.aggregate("cls", F.lit(0).cast("bigint"), lambda a, c: a + c["tp"])
    k = F.size("cls").cast("double")

    def mean(f):
        return F.aggregate("cls", F.lit(0.0), lambda a, c: a + c[f]) / k

    def weighted(f):
        return F.aggregate("cls", F.lit(0.0), lambda a, c: a + c[f] * c["support"]) / tot

    def line(label, prec, rec, f1, sup):
        return F.struct(label.alias("label"), prec.cast("double").alias("precision"),
                        rec.cast("double").alias("recall"), f1.cast("double").alias("f1_score"),
                        sup.cast("bigint").alias("support"))
    nul = F.lit(None)
    summary = F.array(
        line(F.lit("accuracy"), nul, nul, tp / tot, tot),
        line(F.lit("macro avg"), mean("precision"), mean("recall"), mean("f1_score"), tot),
        line(F.lit("weighted avg"), weighted("precision"), weighted("recall"), weighted("f1_score"), tot))
    per = F.transform("cls", lambda c: line(c["label"], c["precision"], c["recall"], c["f1_score"],
                                            c["support"]))
    out = row.select(F.inline(F.concat(per, summary)))
    return out.select("label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1_score")],
                      F.col("support").cast("bigint").alias("support"))


def timing_summary(runs: DataFrame, device: str, value_ms: str, order: str,
                   warmups: int = 10, baseline: str | None = None, digits: int = 6) -> DataFrame:
    """Per device, drop the first ``warmups`` runs (by ``order``, then by
    value), then the mean, population stddev, throughput (1000 / mean) and the
    speed-up ``mean(baseline) / mean``.

    The last warm-up of each device comes from ``row_number() <= warmups``,
    which Spark plans as a partial WindowGroupLimit before the shuffle
    (``warmups`` rows per device and map task).  The runs after it are
    aggregated once, with map-side partials, so slow warm-ups never enter a sum.
    Runs equal to the last warm-up in order and value are added as copies of it:

        n = n_after + e,   mean = (n_after mean_after + e v) / n,
        m2 = m2_after + (v - mean_after)^2 n_after e / n

    Only the table of last warm-ups (one row per device) is joined.
    """
    from pyspark.sql import Window
    at = F.struct(F.col(order).alias("o"), F.col(value_ms).alias("v"))
    runs = runs.select(device, at.alias("__at"))
    w = Window.partitionBy(device).orderBy("__at")
    first = runs.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= warmups)
    last = first.groupBy(F.col(device).alias("__device")).agg(F.collect_list("__at").alias("__first"))
    last = last.select("__device", F.array_max("__first").alias("__last"),
                       F.size(F.filter("__first", lambda x: x == F.array_max("__first"))).alias("__used"))
    j = runs.join(last, F.col(device).eqNullSafe(F.col("__device")), "left")
    after = F.when(F.col("__last").isNull() | (F.col("__at") > F.col("__last")), F.col("__at.v"))
    equal = F.when(F.col("__at") == F.col("__last"), F.col("__at.v"))
    a = j.groupBy(device).agg(F.count(after).alias("__n"), F.avg(after).alias("__mean"), F.var_pop(after).alias("__var"),
                              F.count(equal).alias("__eq"), F.max("__used").alias("__used"), F.max(equal).alias("__v"))
    e = F.when(F.col("__eq") > F.col("__used"), F.col("__eq") - F.col("__used")).otherwise(F.lit(0))
    n, mean, var, v = F.col("__n"), F.coalesce("__mean", F.lit(0.0)), F.coalesce("__var", F.lit(0.0)), F.coalesce("__v", F.lit(0.0))
    every = n + e
    s = a.filter(every > 0).select(
        device, every.alias("n_runs"), ((n * mean + e * v) / every).alias("mean_ms"),
        F.sqrt((var * n + (v - mean) * (v - mean) * n * e / every) / every).alias("std_ms"))
    s = s.withColumn("throughput_per_s", F.lit(1000.0) / F.col("mean_ms"))
    if baseline is not None:
        base = s.filter(F.col(device) == F.lit(baseline)).select("mean_ms").scalar()
        s = s.withColumn("speedup", base / F.col("mean_ms"))
    return s.select(device, "n_runs", *[F.round(c, digits).alias(c) for c in s.columns
                                        if c not in (device, "n_runs")])
