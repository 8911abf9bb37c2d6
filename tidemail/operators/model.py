"""Text classifier: train (L1), score (L2), top class (O3).

The original fine-tunes a transformer on one GPU; that cannot be reproduced
here (no pretrained weights, single machine).  Re-aimed as a distributed
linear model with the same contract — ``text, label`` in, a label name and
the probability of the predicted class out:

    RegexTokenizer → HashingTF → IDF → LogisticRegression   (or NaiveBayes)

Training is MLlib's distributed L-BFGS; scoring is ``transform`` — map-only,
the fitted model is shipped to the executors once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.functions.text import TOKEN_RE


@dataclass
class TrainParams:
    num_features: int = 1 << 18
    min_doc_freq: int = 1
    reg_param: float = 0.1       # chosen on a validation slice of the training side
    elastic_net: float = 0.0
    max_iter: int = 50
    depth: int = 6               # of the trees that sum gradients: few sums of all features reach the driver, however many tasks there are
    classifier: str = "logistic"     # or "naive_bayes"
    text_col: str = "text"
    label_col: str = "label"


def train(df: DataFrame, params: TrainParams | None = None) -> PipelineModel:
    """L1: fit the pipeline on labelled rows (unlabelled rows are ignored)."""
    p = params or TrainParams()
    data = df.filter(F.col(p.label_col).isNotNull()).select(
        F.coalesce(F.col(p.text_col), F.lit("")).alias("__text"),
        F.col(p.label_col).cast("double").alias("__label"))
    tok = RegexTokenizer(inputCol="__text", outputCol="__tokens", pattern=TOKEN_RE, gaps=False,
                         toLowercase=True)
    tf = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=p.num_features)
    idf = IDF(inputCol="__tf", outputCol="features", minDocFreq=p.min_doc_freq)
    if p.classifier == "naive_bayes":
        clf = NaiveBayes(featuresCol="features", labelCol="__label")
    else:
        clf = LogisticRegression(featuresCol="features", labelCol="__label", regParam=p.reg_param,
                                 elasticNetParam=p.elastic_net, maxIter=p.max_iter, aggregationDepth=p.depth)
    # The IDF fit and the classifier each read the training set: tokenise and
    # hash it once and keep the sparse term counts (far smaller than the text).
    # A lost cached block is recomputed from its lineage.
    counts = tf.transform(tok.transform(data)).select("__tf", "__label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        idf_model = idf.fit(counts)
        clf_model = clf.fit(idf_model.transform(counts))
    finally:
        counts.unpersist()
    return PipelineModel(stages=[tok, tf, idf_model, clf_model])


def score(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """L2 + O3: adds ``label_name`` (``LABEL_0``/``LABEL_1``) and ``score``, the
    probability of the predicted class.  Map-only."""
    keep = df.columns
    t = model.transform(df.withColumn("__text", F.coalesce(F.col(text_col), F.lit(""))))
    prob = vector_to_array("probability")
    t = t.withColumn("label_name", F.concat(F.lit("LABEL_"), F.col("prediction").cast("int").cast("string")))
    t = t.withColumn("score", F.array_max(prob))
    return t.select(*keep, "label_name", "score")
