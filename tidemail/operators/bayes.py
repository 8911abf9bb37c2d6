"""Multinomial Naive Bayes in DataFrame operations (L1, L2, O3).

A second classifier beside the logistic one of ``model.py``, with the same
contract: ``text, label`` (0 or 1) in, a label name and the probability of the
predicted class out.  The model is a table of token weights

    w(t) = ln((n1(t) + 1) / (N1 + V + 1)) - ln((n0(t) + 1) / (N0 + V + 1))

with n the token's count in a class, N all tokens of the class and V the
distinct training tokens; a token not seen in training counts as one of count
zero.  Fitting is one count with map-side partials.  Scoring counts tokens
within each row before the join, so a stop word is one row for each mail, and
the skew join splits it where the weights are too large to broadcast.

Defined results: rows without a label do not train; null text has no tokens and
is scored by the smoothed class shares; an empty training table gives even
odds, and even odds predict label 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.functions.text import tokens
from tidemail.session import scratch_path


@dataclass
class BayesModel:
    weights: DataFrame      # token, w
    prior: float            # log odds of label 1 before any token
    unseen: float           # weight of a token without a row


def train_bayes(df: DataFrame, text_col: str = "text", label_col: str = "label") -> BayesModel:
    spark = df.sparkSession
    y = F.col(label_col).cast("int")
    data = df.filter(y.isNotNull()).select(y.alias("y"), tokens(text_col).alias("toks"))
    path = scratch_path(spark, "bayes-counts")
    (data.select("y", F.explode("toks").alias("token")).groupBy("token")
     .agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).write.parquet(path))
    counts = spark.read.schema("token string, n1 long, n0 long").parquet(path)
    total1, total0, v = counts.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0)),
                                   F.count(F.lit(1))).first()
    docs1, docs0 = data.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    unseen = math.log(total0 + v + 1) - math.log(total1 + v + 1)
    weights = counts.select("token", (F.log((F.col("n1") + 1) / (F.col("n0") + 1)) + F.lit(unseen)).alias("w"))
    return BayesModel(weights, math.log((docs1 + 1) / (docs0 + 1)), unseen)


def score_bayes(model: BayesModel, df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` (columns that identify the row), ``label_name`` and ``score``,
    the probability of the predicted class."""
    words = (df.select(*keep, F.explode_outer(tokens(text_col)).alias("token"))
             .groupBy(*keep, "token").agg(F.count("token").alias("n")))
    odds = (words.join(model.weights, "token", "left").groupBy(*keep)
            .agg(F.sum(F.col("n") * F.coalesce("w", F.lit(model.unseen))).alias("odds")))
    odds = odds.withColumn("odds", F.col("odds") + F.lit(model.prior))
    return odds.select(*keep, F.when(F.col("odds") > 0, "LABEL_1").otherwise("LABEL_0").alias("label_name"),
                       (1 / (1 + F.exp(-F.abs("odds")))).alias("score"))
