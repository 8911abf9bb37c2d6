import os

from pyspark.sql import functions as F

from tidemail.operators import tokens as tk
from tidemail.operators.model import TrainParams, train
from tidemail.plans import scoring
from tidemail.queries.intake import intake_json
from tidemail.sources.requests import parse_requests
from tidemail.sources.sinks import load_model, save_model, write_verdicts
from tidemail.sources.tables import emails
from tidemail.streaming.score_stream import score_stream

from conftest import SF001


def _model(spark):
    e = emails(spark, SF001).select("mail_id", "subject", "body", "label")
    return scoring.train_split(e, "mail_id")


def test_train_evaluate_analyze(spark, tmp_dir):
    model = _model(spark)
    e = emails(spark, SF001).withColumn("text", F.concat_ws(" ", "subject", "body"))
    ev = scoring.evaluate(model, e, "mail_id")
    rep = {r["label"]: r for r in ev["report"].collect()}
    assert "accuracy" in rep and "macro avg" in rep
    assert 0.0 <= rep["accuracy"]["f1_score"] <= 1.0
    cm = ev["confusion"].collect()
    assert sum(r["n"] for r in cm) == rep["accuracy"]["support"]
    # smoke prediction on a literal mail
    one = spark.createDataFrame([("Win", "x <a@b.example>", "Click the link to claim your prize")],
                                "subject string, sender string, body string")
    v = scoring.analyze(model, one, "example.edu").first()
    assert v["phish"] in (True, False) and 50 <= v["accuracy"] <= 100 and v["trusted"] is False
    # save / load gives the same verdicts
    path = os.path.join(tmp_dir, "model")
    save_model(model, path)
    v2 = scoring.analyze(load_model(path), one, "example.edu").first()
    assert (v2["phish"], v2["accuracy"]) == (v["phish"], v["accuracy"])
    write_verdicts(scoring.analyze(model, one, "example.edu"), os.path.join(tmp_dir, "verdicts"))
    assert spark.read.json(os.path.join(tmp_dir, "verdicts")).count() == 1


def test_batch_equals_stream(spark, tmp_dir):
    model = _model(spark)
    payload = intake_json(spark, SF001)
    valid, rejected = parse_requests(payload, "payload", keep=["mail_id"])
    batch = {r["url"]: (r["phish"], r["accuracy"], r["trusted"])
             for r in scoring.analyze(model, valid, "example.edu").collect()}
    payload.select("payload").repartition(3).write.text(os.path.join(tmp_dir, "in"))
    q = score_stream(spark, os.path.join(tmp_dir, "in"), model, os.path.join(tmp_dir, "out"),
                     os.path.join(tmp_dir, "rej"), os.path.join(tmp_dir, "ck"), "example.edu",
                     max_files_per_trigger=1)
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(tmp_dir, "out"))
    stream = {r["url"]: (r["phish"], r["accuracy"], r["trusted"]) for r in out.collect()}
    assert stream == batch
    assert spark.read.parquet(os.path.join(tmp_dir, "rej")).count() == rejected.count()


def test_verdicts_and_rejects_appear_together(spark, tmp_dir, monkeypatch):
    """The job ends between the two writes of a batch; its verdicts are not shown
    before the batch is replayed."""
    import pytest
    from tidemail.streaming import score_stream as ss
    model = _model(spark)
    paths = {k: os.path.join(tmp_dir, k) for k in ("in", "out", "rej", "ck")}
    intake_json(spark, SF001).select("payload").repartition(3).write.text(paths["in"])

    def run():
        return score_stream(spark, paths["in"], model, paths["out"], paths["rej"], paths["ck"], "example.edu", max_files_per_trigger=1)
    split, seen = ss.split_parsed, []

    def broken(parsed):
        valid, rejected = split(parsed)
        seen.append(1)
        if len(seen) == 2:                         # the second batch has verdicts, and its rejects cannot be written
            rejected = rejected.withColumn("reason", F.raise_error(F.lit("lost between the writes")))
        return valid, rejected
    monkeypatch.setattr(ss, "split_parsed", broken)
    with pytest.raises(Exception, match="lost between"):
        run().awaitTermination()
    out, rejected = ss.read_committed(spark, paths["out"], paths["rej"])
    assert {r.batch_id for r in out.select("batch_id").distinct().collect()} == {0} == {r.batch_id for r in rejected.select("batch_id").distinct().collect()}
    assert os.path.isdir(os.path.join(paths["out"], "batch_id=1"))       # written, not shown
    run().awaitTermination()
    out, rejected = ss.read_committed(spark, paths["out"], paths["rej"])
    assert out.select("batch_id").distinct().count() == 3
    assert out.count() + rejected.count() == intake_json(spark, SF001).count()
    assert out.select("url").distinct().count() == out.count()
    commits = ss.Commits(spark, paths["out"])
    commits.enter(2)
    assert commits.batches() == [0, 1, 2]
    commits.withdraw(2)
    assert commits.batches() == [0, 1] and ss.read_committed(spark, tmp_dir, tmp_dir) == (None, None)


def test_vocab_and_encode(spark):
    df = spark.createDataFrame([(1, "b a b c"), (2, "a zz"), (3, ""), (4, None)], "id long, t string")
    vocab = tk.build_vocab(df, "t", 2)
    v = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert v == {"[PAD]": 0, "[UNK]": 1, "a": 2, "b": 3}
    for most in (2, 1):                  # looked up in the tasks; joined
        enc = tk.encode(df.withColumn("label", F.col("id") % 2), vocab, "id", "t", 3, max_broadcast=most)
        assert {r["id"]: (r["ids"], r["label"]) for r in enc.collect()} == {1: ([3, 2, 3], 1), 2: ([2, 1], 0), 3: ([], 1), 4: ([], 0)}
    # null and repeated keys keep their rows in both ways
    odd = spark.createDataFrame([(1, "b a"), (1, "c zz a b"), (None, "a"), (None, None), (5, "")], "id long, t string")
    got = [sorted(map(str, tk.encode(odd, vocab, "id", "t", 3, max_broadcast=most).collect())) for most in (2, 1)]
    assert got[0] == got[1] and len(got[0]) == 5 and "Row(id=None, ids=[2])" in got[0]
    for size, want in ((1, ["a"]), (3, ["a", "b", "c"]), (9, ["a", "b", "c", "zz"]), (0, [])):
        got = tk.build_vocab(df, "t", size).where("token_id > 1").orderBy("token_id").collect()
        assert [r["token"] for r in got] == want and [r["token_id"] for r in got] == list(range(2, 2 + len(want)))


def test_few_gradients_reach_the_driver(spark):
    df = spark.range(0, 400, 1, 40).select(F.concat(F.lit("w"), F.col("id") % 7).alias("text"), (F.col("id") % 2).alias("label"))
    sizes, sc = [], spark.sparkContext
    sc.setJobGroup("gradients", "gradients")
    model = train(df, TrainParams(num_features=1 << 10, max_iter=2))
    tracker = sc.statusTracker()
    for job in tracker.getJobIdsForGroup("gradients"):
        stages = [tracker.getStageInfo(s) for s in tracker.getJobInfo(job).stageIds]
        sizes.append(min(s.numTasks for s in stages if s is not None))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert model.stages[-1].getAggregationDepth() == 6 and sizes[-1] <= 4
