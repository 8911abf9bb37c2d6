"""Train / evaluate / analyze jobs (L3, L4, lifecycle 3.1).

``analyze`` is the one projection shared by batch scoring and the streaming
scorer: scoring text → classifier → verdict columns → sender rules.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.functions import sender as snd
from tidemail.functions import text as tx
from tidemail.functions import verdict as vd
from tidemail.operators import metrics, sampling
from tidemail.operators.model import TrainParams, score, train
from tidemail.session import checkpoint_dir, scratch_path
from tidemail.sources.csv import with_text

VERDICT_COLS = ["phish", "accuracy", "trusted"]


def analyze(model: PipelineModel, df: DataFrame, domain: str, org: str | None = None,
            subject: str = "subject", sender: str = "sender", body: str = "body",
            texts: bool = False) -> DataFrame:
    """L4: ``{phish, accuracy, trusted}`` per mail, plus ``domain``.

    ``accuracy`` is floor(100 × probability of the predicted class);
    ``texts=True`` adds the display lines (F10)."""
    base = df.withColumn("__scoring_text", tx.scoring_text(subject, body))
    s = score(model, base, "__scoring_text")
    out = s.withColumns({
        "phish": vd.decode_serving("label_name"),
        "accuracy": vd.confidence("score"),
        "domain": snd.sender_domain(sender),
        "trusted": snd.is_trusted(sender, domain),
    }).drop("__scoring_text")
    if texts:
        out = out.withColumns(vd.verdict_texts("phish", "accuracy", "trusted", org or domain))
    return out


def evaluate(model: PipelineModel, df: DataFrame, key: str, test_fraction: float = 0.2,
             seed: int = 42, text_col: str = "text", label_col: str = "label") -> dict[str, DataFrame]:
    """L3: re-derive the hold-out (M3), score it (L2), decode (F9), then
    accuracy, confusion matrix and classification report (A2–A4)."""
    test = sampling.holdout(df.filter(F.col(label_col).isNotNull()), key, test_fraction, seed)
    scored = score(model, test, text_col).withColumn("prediction", vd.decode_eval("label_name"))
    y = F.col(label_col).cast("int").alias("y_true")
    # written, so that the three results do not score the mails three times
    path = scratch_path(df.sparkSession, "scored")
    scored.select(y, "prediction").write.parquet(path)
    ev = df.sparkSession.read.parquet(path)
    return {"accuracy": metrics.accuracy(ev, "y_true", "prediction"),
            "confusion": metrics.confusion_matrix(ev, "y_true", "prediction"),
            "report": metrics.classification_report(ev, "y_true", "prediction")}


def trained_model(spark, data: DataFrame, params, train_fn) -> PipelineModel:
    """Train once, serve many (S10): the model of these training rows and
    parameters, from the store in the shared folder; trained where it is not there."""
    from tidemail.plans.model_store import ModelStore
    from tidemail.sources.sinks import load_model, save_model
    return ModelStore(spark, f"{checkpoint_dir(spark)}/models").train_once("logistic", data, params, train_fn, save_model, load_model)


def train_split(df: DataFrame, key: str, params: TrainParams | None = None, test_fraction: float = 0.2,
                seed: int = 42) -> PipelineModel:
    """Lifecycle 3.1: P1 text → M1 split → L1 on the train side."""
    t = with_text(df) if "text" not in df.columns else df
    tr = sampling.split(t, key, test_fraction, seed).filter(F.col("split") == "train")
    return train(tr, params)
