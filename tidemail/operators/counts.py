"""A1: row counts per source and in total (one rollup, map-side partial counts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_counts(df: DataFrame, source_col: str = "source") -> DataFrame:
    return (df.rollup(source_col)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 (F.grouping(source_col) == 1).alias("is_total"))
            .select(source_col, "is_total", "n_rows"))
