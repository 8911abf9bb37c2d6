"""Mail intake from JSON records.

A record is valid when it is a JSON object whose ``subject``, ``sender`` and
``body`` are all present and all JSON strings; anything else (bad JSON, a
missing field, ``null``, a number) goes to the reject output with a reason.
Extra fields (``timestamp``, ``url``, ...) are carried along but not required.

Plain ``from_json`` is not enough: it silently turns the number ``1`` into the
string ``"1"``.  The JSON is parsed once into a VARIANT and the type of every
field is checked with ``schema_of_variant``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.operators.rows import keep_rows

REQUIRED = ("subject", "sender", "body")
OPTIONAL = ("timestamp", "url")


def _is_string(v, f: str):
    return F.coalesce(F.expr(f"schema_of_variant(variant_get({v}, '$.{f}')) = 'STRING'"), F.lit(False))


def parse_json_records(df: DataFrame, json_col: str, keep: list[str] | None = None,
                       required=REQUIRED) -> DataFrame:
    """``keep`` + ``__raw`` + the parsed ``__v`` + ``__reason`` (null when valid)."""
    keep = list(keep or [])
    v = "__v"
    parsed = df.select(*keep, F.col(json_col).alias("__raw"),
                       F.expr(f"try_parse_json(`{json_col}`)").alias(v))
    is_obj = F.coalesce(F.expr(f"schema_of_variant({v}) LIKE 'OBJECT%'"), F.lit(False))
    bad = F.concat_ws(",", *[F.when(~_is_string(v, f), F.lit(f)) for f in required])
    return parsed.withColumn("__reason", F.when(~is_obj, F.lit("invalid json")).otherwise(
        F.when(bad != "", F.concat(F.lit("bad field: "), bad))))


def split_parsed(parsed: DataFrame, keep: list[str] | None = None, required=REQUIRED,
                 optional=OPTIONAL) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` from :func:`parse_json_records`."""
    keep = list(keep or [])
    v = "__v"
    # keep_rows: the JSON is parsed once per record, not again inside the filter
    valid = keep_rows(parsed, F.col("__reason").isNull(), [
        *keep,
        *[F.expr(f"variant_get({v}, '$.{f}', 'string')").alias(f) for f in required],
        *[F.expr(f"try_variant_get({v}, '$.{f}', 'string')").alias(f) for f in optional]])
    rejected = keep_rows(parsed, F.col("__reason").isNotNull(), [
        *keep, F.col("__reason").alias("reason"), F.col("__raw").alias("payload")])
    return valid, rejected


def parse_requests(df: DataFrame, json_col: str, keep: list[str] | None = None,
                   required=REQUIRED, optional=OPTIONAL) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into ``(valid, rejected)``; ``keep`` columns are passed through."""
    return split_parsed(parse_json_records(df, json_col, keep, required), keep, required, optional)
