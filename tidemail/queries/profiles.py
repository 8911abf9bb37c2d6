"""Profile queries (A5–A9) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemail.operators import profile as pr
from tidemail.operators import profile_states as ps
from tidemail.queries import sqlfrag as s
from tidemail.registry import register
from tidemail.session import scratch_path
from tidemail.sources.tables import table

CUSTOMER_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _counts_sql(tbl: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS num_records, count(*) - count({c}) AS num_null, "
        f"count(DISTINCT {c}) AS num_unique FROM {tbl}" for c in cols)


def _numerical_sql(tbl: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, "
        f"round(avg({c})::DOUBLE, 6) AS mean, round(stddev_samp({c})::DOUBLE, 6) AS stddev, "
        f"round(median({c}::DOUBLE), 6) AS median FROM {tbl}" for c in cols)


register("profile_counts_customer", _counts_sql("customer", CUSTOMER_COLS))(
    lambda spark, sf_dir: pr.profile_counts(table(spark, sf_dir, "customer"), CUSTOMER_COLS))

register("profile_counts_part", _counts_sql("part", PART_COLS))(
    lambda spark, sf_dir: pr.profile_counts(table(spark, sf_dir, "part"), PART_COLS))

register("profile_counts_documents", _counts_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))(
    lambda spark, sf_dir: pr.profile_counts(table(spark, sf_dir, "documents")))


def _vc_sql(tbl, cols):
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {tbl} "
        f"WHERE {c} IS NOT NULL GROUP BY ALL" for c in cols)


CAT_PART = ["p_brand", "p_type", "p_size"]
register("profile_categorical", f"""
WITH vc AS ({_vc_sql('part', CAT_PART)}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v ASC) AS r1,
               row_number() OVER (PARTITION BY column_name ORDER BY n ASC, v DESC) AS r2 FROM vc)
SELECT column_name,
       max(CASE WHEN r1 = 1 THEN v END) AS most_common_value,
       max(CASE WHEN r2 = 1 THEN v END) AS least_common_value,
       count(*) AS num_categories
FROM r GROUP BY column_name
""")(lambda spark, sf_dir: pr.categorical_profile(table(spark, sf_dir, "part"), CAT_PART))

CAT_CUST = ["c_mktsegment", "c_nationkey"]
register("profile_histogram", f"""
WITH vc AS ({_vc_sql('customer', CAT_CUST)})
SELECT column_name, v AS value, n,
       CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v ASC) AS INTEGER) AS rank
FROM vc
""")(lambda spark, sf_dir: pr.histogram(table(spark, sf_dir, "customer"), CAT_CUST))

NUM_CUST = ["c_acctbal", "c_nationkey"]
register("profile_numerical", _numerical_sql("customer", NUM_CUST))(
    lambda spark, sf_dir: pr.numerical_profile(table(spark, sf_dir, "customer"), NUM_CUST))

NUM_PART = ["p_retailprice", "p_size"]
register("profile_numerical_part", _numerical_sql("part", NUM_PART))(
    lambda spark, sf_dir: pr.numerical_profile(table(spark, sf_dir, "part"), NUM_PART))


@register("token_stats", f"""
SELECT CASE WHEN role = 'assistant' THEN 'completion' ELSE 'prompt' END AS kind,
       count(*) AS n_texts,
       round(avg(len({s.tokens('text')}))::DOUBLE, 6) AS tokens_mean,
       round(median(len({s.tokens('text')}))::DOUBLE, 6) AS tokens_median,
       round(stddev_samp(len({s.tokens('text')}))::DOUBLE, 6) AS tokens_stddev
FROM conversations WHERE role IN ('system', 'user', 'assistant') GROUP BY ALL
""")
def token_stats(spark, sf_dir):
    """System and user turns as prompts, assistant turns as completions."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role").isin("system", "user", "assistant"))
    c = c.withColumn("kind", F.when(F.col("role") == "assistant", "completion").otherwise("prompt"))
    return pr.token_stats(c, "text", "kind")


_MERGED = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_orderkey"]
_MERGED_NUMS = ["l_quantity", "l_extendedprice", "l_discount"]


def _merged_sql() -> str:
    rows = []
    for c in _MERGED:
        num = c in _MERGED_NUMS
        values = ([f"round(min({c})::DOUBLE, 6)", f"round(max({c})::DOUBLE, 6)", f"round(avg({c})::DOUBLE, 4)", f"round(stddev_samp({c})::DOUBLE, 4)"]
                  if num else ["NULL::DOUBLE"] * 4)
        named = ", ".join(f"{v} AS {n}" for v, n in zip(values, ("min", "max", "mean", "stddev")))
        rows.append(f"SELECT '{c}' AS column_name, count(*) AS num_records, count(*) - count({c}) AS num_null, {named}, "
                    f"true AS unique_fits, {'true' if num else 'NULL::BOOLEAN'} AS median_fits FROM lineitem")
    return "\nUNION ALL\n".join(rows)


@register("profile_merged", _merged_sql())
def profile_merged(spark, sf_dir):
    """A5–A7 from the stored states of four parts: exact counts and moments, the
    distinct values and the median within their errors of the exact ones."""
    lines = table(spark, sf_dir, "lineitem")
    base, states = scratch_path(spark, "profile-states"), []
    for part in range(4):
        rows = lines.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(4)) == part)
        ps.profile_state(rows, _MERGED, _MERGED_NUMS).write.parquet(f"{base}/{part}")
        states.append(spark.read.parquet(f"{base}/{part}"))
    got = ps.read_profile(ps.merge_states(*states), (0.49, 0.5, 0.51))
    exact = pr.profile_counts(lines, _MERGED).select("column_name", F.col("num_unique").alias("__unique"))
    middle = pr.numerical_profile(lines, _MERGED_NUMS).select("column_name", F.col("median").alias("__median"))
    got = got.join(exact, "column_name").join(middle, "column_name", "left")
    return got.select("column_name", "num_records", "num_null", *[F.round(c, n).alias(c) for c, n in (("min", 6), ("max", 6), ("mean", 4), ("stddev", 4))],
                      (F.abs(F.col("num_unique") - F.col("__unique")) <= 0.04 * F.col("__unique")).alias("unique_fits"),
                      F.col("__median").between(F.col("q49"), F.col("q51")).alias("median_fits"))
