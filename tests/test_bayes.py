import math
from collections import Counter

from pyspark.sql import functions as F

from tidemail.operators.bayes import score_bayes, train_bayes

ROWS = [(1, "win a prize now", 1), (2, "meeting at noon", 0), (3, "claim the prize prize", 1), (4, None, 0),
        (5, "lunch at noon", None), (6, "", 1)]
SCHEMA = "id long, text string, label int"


def _brute(rows, text):
    n = {0: Counter(), 1: Counter()}
    docs = Counter()
    for _, t, y in rows:
        if y is not None:
            docs[y] += 1
            n[y].update((t or "").split())
    v = len(set(n[0]) | set(n[1]))
    odds = math.log((docs[1] + 1) / (docs[0] + 1))
    for w in (text or "").split():
        odds += math.log((n[1][w] + 1) / (sum(n[1].values()) + v + 1)) - math.log((n[0][w] + 1) / (sum(n[0].values()) + v + 1))
    return "LABEL_1" if odds > 0 else "LABEL_0", 1 / (1 + math.exp(-abs(odds)))


def test_scores_match_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    given = spark.createDataFrame([*ROWS, (7, "prize unknown unknown", None), (8, "noon noon meeting", None)], SCHEMA)
    got = {r["id"]: r for r in score_bayes(train_bayes(df), given, ["id"]).collect()}
    assert len(got) == 8
    for i, text, _ in given.collect():
        name, score = _brute(ROWS, text)
        assert got[i]["label_name"] == name
        assert abs(got[i]["score"] - score) < 1e-9


def test_no_training_rows_and_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = train_bayes(none)
    got = score_bayes(model, spark.createDataFrame([(1, "a b", None)], SCHEMA), ["id"]).first()
    assert (got["label_name"], got["score"]) == ("LABEL_0", 0.5)
    assert score_bayes(model, none, ["id"]).count() == 0


def test_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    one = score_bayes(train_bayes(df.coalesce(1)), df, ["id"]).withColumn("score", F.round("score", 9))
    many = score_bayes(train_bayes(df.repartition(5)), df.repartition(3), ["id"]).withColumn("score", F.round("score", 9))
    assert sorted(one.collect()) == sorted(many.collect())
