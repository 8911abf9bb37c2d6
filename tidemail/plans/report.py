"""Profile document of a generated table (A5–A10 together, written by S9).

One row: ``num_records``, ``target_num_records``, ``column_statistics``
(one struct per kept column: counts, types, declared kinds, and — by kind —
a categorical distribution with its whole histogram, a numerical
distribution, or prompt/completion token statistics),
``side_effect_column_names`` and ``column_profiles`` (always null).

Every part is computed by the distributed operators of ``operators/profile``;
only per-column summaries (bounded by the number of columns × declared values)
are brought together into the final row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemail.functions.templates import Template
from tidemail.functions.text import token_count
from tidemail.operators import profile as pr
from tidemail.plans.generate import Plan, Text

CATEGORICAL = ("category", "subcategory")
NUMERICAL = ("uniform",)


def _tok_stats(df: DataFrame, cols: dict[str, tuple[Column, Column]]) -> DataFrame | None:
    if not cols:
        return None
    parts = [F.struct(F.lit(c).alias("column_name"), token_count(comp).alias("completion"),
                      token_count(prompt).alias("prompt")) for c, (comp, prompt) in cols.items()]
    lng = df.select(F.explode(F.array(*parts)).alias("x")).select("x.*")

    def st(c):
        return [F.round(F.avg(c), 2).alias(f"{c}_tokens_mean"),
                F.round(F.median(c), 2).alias(f"{c}_tokens_median"),
                F.round(F.stddev_samp(c), 2).alias(f"{c}_tokens_stddev")]
    return lng.groupBy("column_name").agg(*st("completion"), *st("prompt"))


def profile_columns(plan: Plan) -> list[str]:
    """The built columns that a profile of the plan reads: those that are kept,
    and those that prompts name."""
    named = set().union(*(Template(s.sampler.prompt).refs for s in plan.specs if isinstance(s.sampler, Text)))
    kept = [s.name for s in plan.specs if not s.drop]
    return kept + sorted(named - set(kept))


def profile_document(plan: Plan, built: DataFrame, target, materialize: bool = True) -> DataFrame:
    """``built``: the generated rows that were kept, with helper columns still
    present (``Plan.build`` filtered by the caller, or ``create_from`` output
    when no prompt statistics are needed).

    The profile reads its input several times (counts, histograms, numerical
    and token statistics); ``materialize`` cuts the lineage once with a
    reliable checkpoint in the shared checkpoint folder, so the generation is
    not recomputed per pass and survives executor loss."""
    if materialize:
        from tidemail.session import checkpoint_dir
        checkpoint_dir(built.sparkSession)
        built = built.checkpoint(eager=True)
    kept = [s.name for s in plan.specs if not s.drop and s.name in built.columns]
    kinds = {s.name: s.sampler.kind for s in plan.specs}
    spark = built.sparkSession

    stats = pr.profile_counts(built, kept)
    types = pr.column_types(built.select(*kept), plan.kinds())
    meta = spark.createDataFrame(
        [(t["column_name"], t["pyarrow_dtype"], t["simple_dtype"], t["column_type"], t["sampler_type"])
         for t in types],
        "column_name string, pyarrow_dtype string, simple_dtype string, column_type string, sampler_type string")
    out = stats.join(meta, "column_name")

    cats = [c for c in kept if kinds[c] in CATEGORICAL]
    if cats:
        # whole histograms, also of values that the plan does not declare
        hist = pr.histogram(built, cats).groupBy("column_name").agg(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("h"))
        cp = pr.categorical_profile(built, cats).join(hist, "column_name").select(
            "column_name", F.to_json(F.struct(
                "most_common_value", "least_common_value",
                F.struct(F.transform("h", lambda x: x["value"]).alias("categories"),
                         F.transform("h", lambda x: x["n"]).alias("counts")).alias("histogram"),
            )).alias("categorical"))
        out = out.join(cp, "column_name", "left")
    else:
        out = out.withColumn("categorical", F.lit(None).cast("string"))

    nums = [c for c in kept if kinds[c] in NUMERICAL]
    if nums:
        np_ = pr.numerical_profile(built, nums, digits=2).select(
            "column_name", F.to_json(F.struct("min", "max", "mean", "stddev", "median")).alias("numerical"))
        out = out.join(np_, "column_name", "left")
    else:
        out = out.withColumn("numerical", F.lit(None).cast("string"))

    texts = {s.name: (F.col(s.name).cast("string"), Template(s.sampler.prompt).column())
             for s in plan.specs if isinstance(s.sampler, Text) and s.name in kept}
    ts = _tok_stats(built, texts)
    tok_cols = [f"{k}_tokens_{m}" for k in ("completion", "prompt") for m in ("mean", "median", "stddev")]
    if ts is not None:
        out = out.join(ts, "column_name", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in tok_cols})

    dist_type = (F.when(F.col("categorical").isNotNull(), F.lit("categorical"))
                 .when(F.col("numerical").isNotNull(), F.lit("numerical")))
    order = {c: i for i, c in enumerate(kept)}
    pos = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]),
                       F.col("column_name"))
    col_struct = F.struct(
        "column_name", "num_records", "num_null", "num_unique", "pyarrow_dtype", "simple_dtype",
        "column_type", "sampler_type", dist_type.alias("distribution_type"),
        F.coalesce(F.col("categorical"), F.col("numerical")).alias("distribution"),
        *tok_cols)
    t = target if isinstance(target, Column) else F.lit(int(target))
    # every column has the same record count: no separate count job and no join
    doc = out.select(pos.alias("pos"), "num_records", col_struct.alias("s")).agg(
        F.max("num_records").alias("num_records"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])
        .alias("column_statistics"))
    return doc.select(
        "num_records", t.cast("bigint").alias("target_num_records"), "column_statistics",
        F.array(*[F.lit(c) for c in plan.side_effect_columns()]).cast("array<string>")
        .alias("side_effect_column_names"),
        F.lit(None).cast("string").alias("column_profiles"))
