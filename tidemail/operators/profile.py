"""Column profiles (A5–A10) in a few shuffles, bounded output.

Long form instead of one ``countDistinct`` per column: every column is
stacked into ``(column_name, v)`` rows (long values replaced by their 16-byte
md5 so the shuffle stays narrow), counted per ``(column_name, v)`` with
map-side partial aggregation, then summarised per column.  A value holding a
third of all rows collapses to one row per map task before the shuffle.

* :func:`profile_counts`       A5  num_records, num_null, num_unique
* :func:`categorical_profile`  A6  most / least common value (count desc, value asc)
* :func:`histogram`            A6/O1 all values per column, ranked (opt-in top-k)
* :func:`numerical_profile`    A7  min, max, mean, stddev (sample), median
* :func:`column_types`         A8  engine type, simple type, column / sampler kind
* :func:`token_stats`          A9  mean / median / stddev of token counts
* :func:`generation_yield`     A10 records made vs. target
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.functions.text import token_count

# Values longer than this are counted by their md5 digest.
DIGEST_OVER = 32


def _as_string(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    col = F.col(f"`{c}`")
    if isinstance(dt, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def _long(df: DataFrame, cols: list[str], value) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column_name"), value(c).alias("v")) for c in cols]
    return df.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def value_counts(df: DataFrame, cols: list[str] | None = None, digest: bool = True) -> DataFrame:
    """``(column_name, v, n)``: count of every value of every column (v null = missing)."""
    cols = cols or df.columns

    def val(c):
        s = _as_string(df, c)
        if not digest:
            return s
        return F.when(F.length(s) > DIGEST_OVER, F.concat(F.lit("md5:"), F.md5(s))).otherwise(s)
    return _long(df, cols, val).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))


def profile_counts(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
                   rsd: float = 0.01) -> DataFrame:
    """A5: per column ``num_records``, ``num_null``, ``num_unique`` (nulls not counted).

    Exact by default (one shuffle of distinct values per map task).
    ``approx=True`` counts distinct values with a HyperLogLog sketch of
    relative error ``rsd`` instead: only fixed-size sketches are shuffled,
    whatever the number of distinct values."""
    if approx:
        cols = cols or df.columns
        lng = _long(df, cols, lambda c: _as_string(df, c))
        return lng.groupBy("column_name").agg(
            F.count(F.lit(1)).cast("bigint").alias("num_records"),
            (F.count(F.lit(1)) - F.count("v")).cast("bigint").alias("num_null"),
            F.approx_count_distinct("v", rsd).cast("bigint").alias("num_unique"))
    vc = value_counts(df, cols)
    return vc.groupBy("column_name").agg(
        F.sum("n").cast("bigint").alias("num_records"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("num_null"),
        F.count("v").cast("bigint").alias("num_unique"))


def categorical_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Most and least common non-null value; ties go to the smaller value."""
    vc = value_counts(df, cols, digest=False).filter(F.col("v").isNotNull())
    key = F.struct((-F.col("n")).alias("neg_n"), F.col("v").alias("v"))
    return vc.groupBy("column_name").agg(
        F.min_by("v", key).alias("most_common_value"),
        F.max_by("v", key).alias("least_common_value"),
        F.count(F.lit(1)).cast("bigint").alias("num_categories"))


def histogram(df: DataFrame, cols: list[str], max_bins: int | None = None) -> DataFrame:
    """``(column_name, value, n, rank)`` for every value of each column
    (count desc, value asc), as in the published profiles.

    For categorical columns: the ranking window holds one row per distinct
    value of a column.  ``max_bins`` (opt-in top-k) is planned as a partial
    group limit, so then no more than ``max_bins`` values per column and map
    task reach the shuffle."""
    vc = value_counts(df, cols, digest=False).filter(F.col("v").isNotNull())
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), F.col("v").asc())
    ranked = vc.withColumn("rank", F.row_number().over(w))
    if max_bins is not None:
        ranked = ranked.filter(F.col("rank") <= max_bins)
    return ranked.select("column_name", F.col("v").alias("value"), F.col("n").cast("bigint").alias("n"),
                         F.col("rank").cast("int").alias("rank"))


# Quantile grid of the optional second sketch pass of :func:`exact_median`,
# and the bracket size above which that pass runs.
MEDIAN_GRID = 1000
MEDIAN_DIRECT = 1_000_000


def exact_median(lng: DataFrame, accuracy: int = 100_000, direct: int = MEDIAN_DIRECT) -> DataFrame:
    """Exact median per ``column_name`` of long-form ``(column_name, v)`` rows,
    without gathering a column's values in one task.

    1. A ``percentile_approx`` sketch (bounded size) brackets the two middle
       ranks: its rank error is at most n/accuracy, the bracket is widened to
       4n/accuracy on each side, so it holds m ≈ 8n/accuracy rows.  Its result
       — one row per column — is the only thing that reaches the driver.
    2. Only when some bracket may exceed ``direct`` rows (n above ~10**11 at
       the default accuracy): a second sketch over the rows inside the bracket,
       at a fixed grid of ``MEDIAN_GRID - 1`` quantiles, narrows it to a few
       grid steps around the middle ranks (again widened by four times the
       sketch error).
    3. Rows below the final bracket are only counted; rows inside it are
       reduced to (value, count) pairs, so ties (even a value holding a third
       of all rows) collapse to one pair.
    4. A running count over the bracket finds ranks floor((n-1)/2) and
       floor(n/2); the median is their mean, as in ``percentile(v, 0.5)``.
    """
    spark = lng.sparkSession
    eps = 4.0 / accuracy
    lo_q, hi_q = max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)
    sk = lng.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("v", [lo_q, hi_q], accuracy).alias("b"))
    rows = [(r[0], int(r[1]), float(r[2][0]), float(r[2][1])) for r in sk.collect()]
    br = spark.createDataFrame(rows, "column_name string, n long, lo double, hi double")
    k1 = F.floor((F.col("n") - 1) / 2)
    k2 = F.floor(F.col("n") / 2)
    if any(8 * n / accuracy > direct for _, n, _, _ in rows):
        # one row per numerical column: a proven bound for the broadcast
        j = lng.join(F.broadcast(br), "column_name")
        in1 = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        grid = [i / MEDIAN_GRID for i in range(1, MEDIAN_GRID)]
        g = j.groupBy("column_name").agg(
            F.sum(F.when(F.col("v") < F.col("lo"), 1).otherwise(0)).cast("bigint").alias("below1"),
            F.sum(F.when(in1, 1).otherwise(0)).cast("bigint").alias("m"),
            F.percentile_approx(F.when(in1, F.col("v")), grid, accuracy).alias("g"))
        # grid index i holds the value near rank i*m/GRID of the bracket (1-based array)
        steps = F.col("m") / F.lit(float(MEDIAN_GRID))
        err = F.lit(4.0 / accuracy) * F.col("m")
        i_lo = F.floor((k1 - F.col("below1") - err) / steps) - 1
        i_hi = F.ceil((k2 - F.col("below1") + err) / steps) + 1
        br = g.join(F.broadcast(br), "column_name").select(
            "column_name", "n",
            F.when(i_lo >= 1, F.element_at("g", i_lo.cast("int"))).otherwise(F.col("lo")).alias("lo"),
            F.when(i_hi <= MEDIAN_GRID - 1, F.element_at("g", i_hi.cast("int"))).otherwise(F.col("hi")).alias("hi"))
    j2 = lng.join(F.broadcast(br), "column_name")
    below = j2.groupBy("column_name").agg(
        F.sum(F.when(F.col("v") < F.col("lo"), 1).otherwise(0)).cast("bigint").alias("below"))
    inside = (j2.filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
              .groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("c")))
    w = Window.partitionBy("column_name").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (inside.withColumn("upto", F.sum("c").over(w))
              .join(below, "column_name").join(F.broadcast(br.select("column_name", "n")), "column_name")
              .withColumn("first", F.col("below") + F.col("upto") - F.col("c"))
              .withColumn("last", F.col("below") + F.col("upto") - 1))
    hit1 = (F.col("first") <= k1) & (k1 <= F.col("last"))
    hit2 = (F.col("first") <= k2) & (k2 <= F.col("last"))
    return ranked.groupBy("column_name").agg(
        ((F.max(F.when(hit1, F.col("v"))) + F.max(F.when(hit2, F.col("v")))) / 2).alias("median"))


def numerical_profile(df: DataFrame, cols: list[str], approx: bool = False,
                      accuracy: int = 100_000, digits: int = 6) -> DataFrame:
    """Min, max, mean, sample stddev and median per numerical column.

    The median is exact (:func:`exact_median`, bounded memory per task);
    ``approx=True`` returns the sketch value alone (one pass fewer).
    """
    lng = _long(df, cols, lambda c: F.col(f"`{c}`").cast("double")).filter(F.col("v").isNotNull())
    stats = lng.groupBy("column_name").agg(
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("stddev"))
    if approx:
        med = lng.groupBy("column_name").agg(F.percentile_approx("v", 0.5, accuracy).alias("median"))
    else:
        med = exact_median(lng, accuracy)
    out = stats.join(med, "column_name", "left")
    return out.select("column_name", *[F.round(c, digits).alias(c)
                                       for c in ("min", "max", "mean", "stddev", "median")])


# Simple type names of the profile format.
_SIMPLE = {T.StringType: "string", T.LongType: "int", T.IntegerType: "int", T.ShortType: "int",
           T.ByteType: "int", T.DoubleType: "float", T.FloatType: "float", T.BooleanType: "bool",
           T.StructType: "dict", T.ArrayType: "list", T.MapType: "dict"}
_ARROW = {T.StringType: "string", T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16",
          T.ByteType: "int8", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "bool"}


def column_types(df: DataFrame, kinds: dict[str, tuple[str, str | None]] | None = None) -> list[dict]:
    """Engine type, simple type and declared kinds, from the schema (no job)."""
    out = []
    for f in df.schema.fields:
        t = type(f.dataType)
        kind, sampler = (kinds or {}).get(f.name, (None, None))
        arrow = _ARROW.get(t) or ("struct<" + ",".join(x.name for x in f.dataType.fields) + ">"
                                  if isinstance(f.dataType, T.StructType) else f.dataType.simpleString())
        out.append({"column_name": f.name, "pyarrow_dtype": arrow, "simple_dtype": _SIMPLE.get(t, "other"),
                    "column_type": kind, "sampler_type": sampler})
    return out


def token_stats(df: DataFrame, text_col: str, group_col: str | None = None, digits: int = 6) -> DataFrame:
    """Mean, median and sample stddev of the token count of a text column."""
    n = token_count(text_col).alias("n_tokens")
    base = df.select(*([group_col] if group_col else []), n)
    g = base.groupBy(group_col) if group_col else base.groupBy()
    return g.agg(F.count(F.lit(1)).cast("bigint").alias("n_texts"),
                 F.round(F.avg("n_tokens"), digits).alias("tokens_mean"),
                 F.round(F.median("n_tokens"), digits).alias("tokens_median"),
                 F.round(F.stddev_samp("n_tokens"), digits).alias("tokens_stddev"))


def generation_yield(df: DataFrame, target) -> DataFrame:
    """A10: records made, target (an int or a scalar Column) and their ratio."""
    t = target if isinstance(target, Column) else F.lit(int(target))
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("num_records")).select(
        "num_records", t.cast("bigint").alias("target_num_records"),
        F.round(F.col("num_records") / t.cast("double"), 6).alias("yield_ratio"))
