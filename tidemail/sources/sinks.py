"""Sinks and simple sources: verdicts (S8), artifacts (S9), models (S10),
Parquet parts (S4) and HTML pages (S11)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """Every Parquet part of a directory."""
    return spark.read.parquet(path)


def read_pages(spark: SparkSession, path: str, wholetext: bool = False) -> DataFrame:
    """HTML documents as rows — a Parquet table of pages, or one row per
    file (``wholetext``) with the path as ``url``."""
    if wholetext:
        return (spark.read.text(path, wholetext=True)
                .select(F.input_file_name().alias("url"), F.col("value").alias("html")))
    return spark.read.parquet(path)


def write_verdicts(df: DataFrame, path: str, keep: list[str] | None = None, mode: str = "overwrite", trusted_as: str = "trusted") -> None:
    """``{phish, accuracy, trusted}`` records as JSON lines (plus ``keep`` ids);
    ``trusted_as`` names the last field (an organisation's own, say)."""
    df.select(*(keep or []), "phish", "accuracy", F.col("trusted").alias(trusted_as)).write.mode(mode).json(path)


def write_artifacts(df: DataFrame, profile: DataFrame | dict, path: str, mode: str = "overwrite") -> None:
    """The generated table as Parquet under ``dataset/`` and its profile as
    one JSON document under ``analysis/``."""
    df.write.mode(mode).parquet(f"{path}/dataset")
    spark = df.sparkSession
    if isinstance(profile, dict):
        spark.createDataFrame([(json.dumps(profile),)], "value string").coalesce(1) \
            .write.mode(mode).text(f"{path}/analysis")
    else:
        profile.coalesce(1).write.mode(mode).json(f"{path}/analysis")


def save_model(model, path: str) -> None:
    """Persist a fitted pipeline (weights and tokenizer settings together)."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
