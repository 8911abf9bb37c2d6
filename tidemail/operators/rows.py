"""Row selection that keeps expensive projections evaluated once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_rows(df: DataFrame, cond: Column, cols: list) -> DataFrame:
    """Rows of ``df`` where ``cond`` holds, projected to ``cols``.

    Done through a 0-or-1 element array instead of a Filter: a deterministic
    Filter on computed columns is pushed below their projection by the
    optimizer, so an expensive expression (a parse, many hash draws) would be
    evaluated twice per row — once in the filter, once in the output."""
    row = F.struct(*cols)
    empty = F.array().cast(T.ArrayType(df.select(row).schema[0].dataType))
    return df.select(F.inline(F.when(cond, F.array(row)).otherwise(empty)))
