import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tidemail.functions import text as tx
from tidemail.functions import verdict as vd
from tidemail.operators import metrics, sampling
from tidemail.operators import embedding as em
from tidemail.operators.pieces import Pieces, load_pieces
from tidemail.plans.model_store import ModelStore, rows_digest
from tidemail.sources.tables import emails

PATH = public_tokenizers.path("word_bpe_49k.json")


def toy(spark, n=400):
    r = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "the", "of"]
    rows = []
    for i in range(n):
        w = r.choice(words, 12).tolist() + (["prize"] if i % 3 == 0 else [])
        rows.append((i if i % 4 else None, " ".join(w), int(i % 3 == 0) if i % 10 else None))
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_same_model_for_any_partitioning(spark):
    df, pieces = toy(spark), load_pieces(PATH)
    p = em.EmbedParams(shard_rows=100, max_len=16, dim=4, epochs=2)
    models = [em.train_embedding(df.repartition(n), "id", pieces, p) for n in (1, 5)]
    assert np.array_equal(models[0].flat(), models[1].flat())
    other = em.train_embedding(df, "id", pieces, em.EmbedParams(shard_rows=100, max_len=16, dim=4, epochs=2, seed=7))
    assert not np.array_equal(models[0].flat(), other.flat())


def test_gradient_is_that_of_the_loss():
    r = np.random.default_rng(2)
    n, ids, y = np.array([3, 0, 2]), np.array([2, 3, 2, 4, 4]), np.array([1, 0, 1])

    def model():
        q = np.random.default_rng(3)
        return em.EmbeddingModel(None, [0, 1], q.normal(size=(5, 4)), q.normal(size=(4, 2)), q.normal(size=2), 8)

    def loss(m):
        return -np.log(m.probabilities(ids, n)[np.arange(3), y]).mean()

    class Keep:
        def step(self, a, g, rows=slice(None)):
            self.g = np.zeros_like(a)
            self.g[rows] = g
    trainer = em.Trainer(model(), em.EmbedParams())
    trainer.steps = [Keep(), Keep(), Keep()]
    trainer.batch(ids, n, y)
    for name, step in zip(("vectors", "weights", "bias"), trainer.steps):
        base = getattr(model(), name)
        for at in map(tuple, r.integers(0, base.shape, (6, base.ndim))):
            up, down = model(), model()
            getattr(up, name)[at] += 1e-3
            getattr(down, name)[at] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - step.g[at]) < 1e-3


def test_learns_scores_and_saves(spark, tmp_dir):
    df, pieces = toy(spark), load_pieces(PATH)
    model = em.train_embedding(df, "id", pieces, em.EmbedParams(max_len=64, rate=0.05, epochs=5))
    odd = spark.createDataFrame([(1, "prize", 0.5), (2, "the of", None), (3, None, 1.0), (4, "", 1.0), (4, "x" * 5000, 1.0)], "id long, text string, score_of double")
    out = em.score_embedding(model, odd)
    assert out.columns == ["id", "text", "score_of", "label_name", "score"]
    got = {(r.id, r.score_of): r for r in out.collect()}
    assert len(got) == 4 and got[1, 0.5].label_name == "LABEL_1" and got[2, None].label_name == "LABEL_0"
    assert all(0.5 <= r.score <= 1 for r in got.values())
    em.save_embedding(model, spark, tmp_dir + "/m")
    back = em.load_embedding(spark, tmp_dir + "/m")
    assert np.array_equal(back.flat(), model.flat())
    assert sorted(map(str, em.score_embedding(back, odd).collect())) == sorted(map(str, out.collect()))
    with pytest.raises(ValueError, match="no labelled"):
        em.train_embedding(df.where("label is null"), "id", pieces)


def test_better_than_the_majority_on_the_hold_out(spark):
    sf01 = SF001.replace("sf0.001", "sf0.1")
    rows = emails(spark, sf01, parallel=True).select("mail_id", tx.training_text("subject", "body").alias("text"), "label").where("label is not null").cache()
    train = sampling.split(rows, "mail_id").filter(F.col("split") == "train")
    pieces, found = load_pieces(PATH), {}
    for length in (256, 2048):
        model = em.train_embedding(train, "mail_id", pieces, em.EmbedParams(max_len=length))
        scored = em.score_embedding(model, sampling.holdout(rows, "mail_id")).withColumn("p", vd.decode_eval("label_name"))
        report = {r.label: r for r in metrics.classification_report(scored, "label", "p").collect()}
        ones, n = report["1"].support, report["accuracy"].support
        most = max(ones, n - ones)
        found[length] = report["accuracy"].f1_score, report["macro avg"].f1_score
        assert found[length][1] > 1.3 * most / (n + most)
    # the telling words of many mails come after the first 256 pieces
    assert found[2048][0] > most / n and found[2048][1] > found[256][1]
    print(found)
    rows.unpersist()


def test_store_trains_once_and_again_when_rows_change(spark, tmp_dir):
    store, trained = ModelStore(spark, tmp_dir + "/models"), []
    df = toy(spark, 30)

    def get(data, params=1):
        def train():
            trained.append(1)
            return em.EmbeddingModel(Pieces({"a": 2}), [0, 1], np.zeros((3, 2), np.float32), np.zeros((2, 2), np.float32), np.full(2, len(trained), np.float32), 4)
        return store.train_once("toy", data, params, train, lambda m, f: em.save_embedding(m, spark, f), lambda f: em.load_embedding(spark, f))
    assert get(df).bias[0] == 1 and get(df.repartition(3)).bias[0] == 1 and len(trained) == 1
    relabelled = df.withColumn("label", F.when(F.col("label").isNotNull(), 1 - F.col("label")))
    assert get(relabelled).bias[0] == 2 and get(df, 2).bias[0] == 3 and get(df).bias[0] == 1
    assert rows_digest(df) != rows_digest(df.union(df.limit(1))) and rows_digest(df) != rows_digest(df.select("id", "text"))
    assert store.current("toy") is None
    for data in (df, relabelled):
        store.serve("toy", store.folder("toy", data, 1))
        assert em.load_embedding(spark, store.current("toy")).bias[0] == (1 if data is df else 2)
