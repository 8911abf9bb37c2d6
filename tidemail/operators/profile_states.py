"""Profiles that merge (A5–A7): one row of fixed size a column.

:func:`profile_state` reads a part once and keeps, for each column, counts,
moments, a distinct-value sketch, a quantile sketch and the most frequent values.
States are tables: they are stored with their part, and the profile of any union of
parts comes from :func:`merge_states`, without reading a row again.

Exact: records, nulls, minimum, maximum; mean and standard deviation but for
rounding.  Within stated errors: distinct values (``lg_k`` = 14: about 0.8 % standard
error), quantiles (``k`` = 800: rank error about 0.4 %), the counts of the top values
(exact while a column has fewer different values than ``tracked``; beyond, too low by
the sketch's error at most).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.operators.profile import _as_string

LG_K, KLL_K, TRACKED = 14, 800, 10_000


def profile_state(df: DataFrame, cols: list[str] | None = None, nums: list[str] | None = None,
                  lg_k: int = LG_K, k: int = KLL_K, tracked: int = TRACKED) -> DataFrame:
    """One row for each of ``cols``; those in ``nums`` have numerical parts too.
    The table is read once; what is shuffled are the sketches of its tasks."""
    cols, nums = cols or df.columns, set(nums or [])
    rows = [F.struct(F.lit(c).alias("column_name"), _as_string(df, c).alias("v"),
                     (F.col(f"`{c}`") if c in nums else F.lit(None)).cast("double").alias("x")) for c in cols]
    long = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("v")).alias("n_null"), F.hll_sketch_agg("v", lg_k).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(v, {tracked}) FILTER (WHERE v IS NOT NULL)").alias("top"), F.count("x").alias("n_x"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2"), F.kll_sketch_agg_double("x", F.lit(k)).alias("quantiles"))


def merge_states(*states: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """The states of all parts as those of their union."""
    rows = reduce(DataFrame.unionByName, states)
    # squared distances from the common mean: those from each part's, and of the parts' means
    mean = F.sum(F.col("n_x") * F.col("mean")) / F.nullif(F.sum("n_x"), F.lit(0))
    merged = rows.groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_union_agg("distinct").alias("distinct"),
        F.expr(f"approx_top_k_combine(top, {tracked})").alias("top"), F.sum("n_x").alias("__n_x"), F.min("min").alias("min"), F.max("max").alias("max"),
        mean.alias("__mean"), F.sum("m2").alias("__m2"), F.collect_list(F.struct("n_x", "mean")).alias("__parts"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))
    apart = F.aggregate("__parts", F.lit(0.0), lambda a, p: a + F.coalesce(p["n_x"] * F.pow(p["mean"] - F.col("__mean"), F.lit(2)), F.lit(0.0)))
    return merged.select("column_name", "n", "n_null", "distinct", "top", F.col("__n_x").alias("n_x"), "min", "max", F.col("__mean").alias("mean"),
                         (F.col("__m2") + apart).alias("m2"), "quantiles")


def read_profile(states: DataFrame, quantiles: tuple[float, ...] = (0.5,), top: int = 10) -> DataFrame:
    """The profile that states say: counts, numbers of distinct values, moments,
    quantiles (``q<percent>``) and the ``top`` values with their counts."""
    has = F.col("n_x") > 0
    at = lambda q: F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(q))).alias(f"q{round(q * 100)}")
    return states.select(
        "column_name", F.col("n").alias("num_records"), F.col("n_null").alias("num_null"), F.hll_sketch_estimate("distinct").alias("num_unique"),
        "min", "max", "mean", F.when(F.col("n_x") > 1, F.sqrt(F.col("m2") / (F.col("n_x") - 1))).alias("stddev"), *[at(q) for q in quantiles],
        F.expr(f"approx_top_k_estimate(top, {top})").alias("top"))
