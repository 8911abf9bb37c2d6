"""The classifier and the language filters against plain Python, and the pipeline on odd rows."""
import math
import re
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
import xxhash
from conftest import SF001
from pyspark.sql import functions as F
from tidemail.llm import lang_bloom, line_templates, quality_classifier as qc
from tidemail.llm.common import written


# ----------------------------------------------------------- quality classifier

def plain_features(doc):
    """(text features, metadata features) of a row as dictionaries."""
    text = brute.lower(doc["text"] or "")
    words = brute.WORD.findall(text)
    place = lambda s, bits: xxhash.xxh64_intdigest(s.encode()) >> (64 - bits)
    counts = Counter(place(w, 16) for w in words)
    norm = math.sqrt(sum(n * n for n in counts.values()))
    out = {k: n / norm for k, n in counts.items()}
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    for i, v in enumerate((len(counts) / max(n, 1), math.log1p(n) / 8, min(1, 10 * symbols / max(n, 1)))):
        out[(1 << 16) + i] = v
    lang, source = (doc[c] if doc[c] is not None else "\0" for c in ("lang", "source"))
    size = max(1, doc["n_chars"] or 0)
    meta = defaultdict(float)
    for name in (f"l={lang}", f"s={source}", f"n={math.floor(2 * math.log2(size))}", f"ls={lang}/{source}"):
        meta[place(name, 12)] += 0.5
    return out, meta


def plain_scores(model, doc):
    z = []
    for view, f in zip(("text", "meta"), plain_features(doc)):
        w, (slope, shift) = model.weights[view], model.calibration[view]
        z.append(slope * (sum(w[k] * v for k, v in f.items()) + w[-1]) + shift)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    return sigmoid(z[0]), sigmoid(z[1]), sigmoid(model.mix[0] * z[0] + model.mix[1] * z[1] + model.mix[2])


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF001.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF001.replace('sf0.001', 'sf0.01')}/labels.parquet")
    model = qc.train(docs, labels)
    assert model.mix is not None
    return model


def test_scores_of_a_fitted_model_match_plain_python(spark, fitted):
    rows = [(1, "Some # plain * text, some text", "en", "src1", 30, 1.0), (2, None, None, None, None, 2.0), (None, "", "xx", "new", -5, None),
            (4, "word é 漢字 " * 20_000, "de", "src0", 200_000, 3.0), (4, "tie", "en", "src0", 3, 0.0), (4, "tie", "en", "src0", 3, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    docs = docs.union(spark.read.parquet(f"{SF001}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "lang", "source", "n_chars", "0.5 score"))
    key = lambda r: (str(r[0]), *(round(x, 6) for x in r[1:]))
    got = sorted(tuple(r) for r in map(key, qc.score(docs, fitted).collect()))
    want = sorted(key((d["doc_id"], *plain_scores(fitted, d))) for d in docs.collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and all(abs(a - b) < 2e-4 for a, b in zip(g[1:], w[1:]))
    assert qc.score(docs.limit(0), fitted).count() == 0


def test_fit_is_the_minimum_of_the_loss():
    r = np.random.default_rng(4)
    table = r.normal(size=(80, 3))
    label, weight = (table @ [1, -2, 0.5] + r.normal(size=80) > 0).astype(float), r.uniform(0.5, 2, 80)
    w = qc.logistic(qc._dense(*table.T), label, weight, 3, ridge=0.01, steps=200)

    def loss(w):
        total = 0.0
        for x, y, k in zip(table, label, weight):
            z = sum(a * b for a, b in zip(x, w)) + w[-1]
            total += k * math.log1p(math.exp(-z if y else z))
        return total / weight.sum() + 0.005 * sum(a * a for a in w[:-1])
    for i in range(4):
        for step in (-0.02, 0.02):
            other = w.copy()
            other[i] += step
            assert loss(other) > loss(w)


# ------------------------------------------------------------------ languages

def plain_grams(text):
    """N-grams of 2 to 4 characters of the words (letters), each between two spaces."""
    text = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text or "").lower()
    out = Counter()
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        padded = f" {w} "
        for n in (2, 3, 4):
            for i in range(len(padded) - n + 1):
                g = padded[i:i + n]
                if not (g[0] == " " and g[-1] == " ") and " " not in g[1:-1]:
                    out[g] += 1
    return out


def test_languages_match_plain_sets(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r.doc_id % 3:
            counts[r.lang].update(plain_grams(r.text))
    share = {l: {g: n / sum(c.values()) for g, n in c.items()} for l, c in counts.items()}
    top = Counter()
    for s in share.values():
        for g, x in s.items():
            top[g] = max(top[g], x)
    held = {l: {g for g, x in s.items() if x >= 1e-5 and 8 * x >= top[g]} for l, s in share.items()}
    filters = lang_bloom.train(docs.where("doc_id % 3 <> 0"))
    odd = spark.createDataFrame([(-1, None), (-2, "12 %"), (-3, "the " * 50_000), (-4, "x"), (-4, "x"), (None, "und")], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(odd)
    got = defaultdict(list)
    for r in lang_bloom.predict(every, filters).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert got[-1] == got[-2] == [("und", 0.0)] and got[-3][0][0] == "en" and len(got[-4]) == 2 and got[-4][0] == got[-4][1]
    wrong = 0
    for r in rows:
        grams = plain_grams(r.text)
        found = {l: sum(n for g, n in grams.items() if g in h) for l, h in held.items()}
        best = max(sorted(found), key=found.get)
        lang, score = got[r.doc_id][0]
        if sum(found.values()):
            second = sorted(found.values())[-2]
            wrong += lang != best and found[best] - second > 0.02 * found[best]
            assert abs(score - found[best] / sum(found.values())) < 0.03 or lang != best
    assert wrong == 0


def test_equal_languages_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "same words", l) for i, l in enumerate(["b", "a"] * 20)], "doc_id long, text string, lang string")
    filters = lang_bloom.train(docs)
    given = spark.createDataFrame([(1, "same words")], "doc_id long, text string")
    assert lang_bloom.predict(given, filters).first().lang_pred == "a"           # a tie goes to the first name
    for taken in ("lang_pred", "score"):
        with pytest.raises(ValueError, match="exist"):
            lang_bloom.predict(given.withColumn(taken, F.lit(1)), filters)
    with pytest.raises(ValueError, match="exists"):
        line_templates.dedup_lines(given.withColumn("n", F.lit(1)), count="n")


# ------------------------------------------------------------- lines, pipeline

def test_lines_of_repeated_rows_and_a_very_long_text(spark):
    long = "\n".join(f"line number {i} of many others" for i in range(20_000)) + "\nthis line is shared by all"
    rows = [(1, long), (2, "this line is shared by all\nown words in here"), (2, "this line is shared by all\nown words in here"), (3, "x" * 300_000), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("drop", F.lit("clash"))
    got = sorted((r.doc_id, r.text) for r in line_templates.dedup_lines(docs).collect())
    assert got == [(1, long), (2, "own words in here"), (2, "own words in here"), (3, "x" * 300_000), (4, None)]


def test_pipeline_on_odd_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumns({"h": F.lit(1), "row_hash": F.lit("x"), "pred": F.lit(None).cast("string")})
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "only an english text of the and of in the", "en", None, 1),
                                 (900_000, "", "en", "s", 0), (900_001, None, "fr", "s", None), (900_001, None, "fr", "s", None)],
                                "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for start in (docs, docs.limit(0)):
        held = start
        for name, stage in corpus_pipeline.STAGES:
            columns, before = held.columns, held.count()
            held = written(stage(spark, held, SF001), name)
            assert held.count() <= before
            if name != corpus_pipeline.STAGES[-1][0]:
                assert held.columns == columns
    assert held.count() == 0
