"""Quality classification by co-training two views of a page.

One classifier reads the text's content (hashed words and a few shares), the
other the page's metadata (language, source, length).  In every round each view
scores the unlabelled pool, and documents of which it is confident, by its
calibrated probability, become pseudo-labels for the other view.  After the
rounds each view is calibrated by a logistic fit on a labelled slice that no
view was trained on, a second fit on that slice weighs the two calibrated views,
and all documents are scored.

Fitting reads two bounded samples, chosen by a hash of doc_id, whose hashed
features alone reach the driver: about ``sample_rows`` of the labelled documents
outside the hold-out (all, if there are no more, however many documents have no
label), and about ``pool_rows`` of those without a label as the pool.  A class
of under half of ``sample_rows`` is taken whole; where the classes are sampled
at different rates, their weights make up for it.  Scoring reads every document,
whole, in one pass without a shuffle.  A hash of doc_id deals the labelled documents to
training (remainders 3 to 9), calibration (2) and hold-out (0 and 1, never used).

Defined results: null text has no words, null metadata is a value of its own;
null labels count as unlabelled, several labels of a document as their highest;
without both classes in training and calibration every score is the labelled
share of quality 1 (0.5 without labels); repeated rows are scored each; an empty
table gives no rows; extra columns never enter.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.llm.common import blocks, coded, row_crc_mod, split_words, text_of, written

VIEWS = ("text", "meta")
BITS = {"text": 16, "meta": 12}
_SHAPE = 3                                   # dense features after the hashed words


def fold() -> Column:
    return row_crc_mod("doc_id", 10)


def held_out() -> Column:
    return fold().isin(0, 1)


@dataclass
class Rows:
    """Sparse rows: each row's features lie between two offsets."""
    off: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def __len__(self):
        return len(self.off) - 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.off))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner(), weights=self.value * w[self.at], minlength=len(self))

    def pick(self, which: np.ndarray) -> Rows:
        n = np.diff(self.off)[which]
        at = np.arange(n.sum()) + np.repeat(self.off[which] - (np.cumsum(n) - n), n)
        return Rows(np.concatenate([[0], np.cumsum(n)]), self.at[at], self.value[at])


def _hashed(values: pa.Array, bits: int) -> np.ndarray:
    keys = values.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return (np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys)) >> np.uint64(64 - bits)).astype(np.int64)


def text_rows(batch: pa.RecordBatch) -> Rows:
    """Hashed word counts, of length 1 together, and three shares."""
    text = pc.ascii_lower(text_of(batch))
    flat, off = split_words(text)
    index, values = coded(flat)
    n, dim = batch.num_rows, 1 << BITS["text"]
    doc = np.repeat(np.arange(n), np.diff(off))
    code, count = np.unique(doc * dim + _hashed(values, BITS["text"])[index], return_counts=True)
    owner, at = code // dim, code % dim
    norm = np.sqrt(np.bincount(owner, weights=count.astype(float) ** 2, minlength=n))
    words = np.diff(off)
    per_doc = np.bincount(owner, minlength=n)
    symbols = pc.count_substring_regex(text, r"[#*$%&|<>]").to_numpy(zero_copy_only=False)
    shape = np.stack([per_doc / np.maximum(words, 1), np.log1p(words) / 8, np.minimum(1, 10 * symbols / np.maximum(words, 1))], 1)
    owner = np.concatenate([owner, np.repeat(np.arange(n), _SHAPE)])
    at = np.concatenate([at, dim + np.tile(np.arange(_SHAPE), n)])
    value = np.concatenate([count / norm[code // dim], shape.ravel()])
    order = np.argsort(owner, kind="stable")
    return Rows(np.concatenate([[0], np.cumsum(per_doc + _SHAPE)]), at[order], value[order])


def meta_rows(batch: pa.RecordBatch) -> Rows:
    """Language, source, length class, and language with source, hashed."""
    lang, source = (pc.fill_null(batch.column(c).cast(pa.string()), "\0") for c in ("lang", "source"))
    size = np.maximum(1, pc.fill_null(batch.column("n_chars").cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
    length = pa.array(np.floor(2 * np.log2(size)).astype(int).astype(str))
    names = [pc.binary_join_element_wise(*(pa.scalar(x) if isinstance(x, str) else x for x in parts), "")
             for parts in (("l=", lang), ("s=", source), ("n=", length), ("ls=", lang, "/", source))]
    at = np.stack([_hashed(x.cast(pa.string()), BITS["meta"]) for x in names], 1)
    return Rows(np.arange(batch.num_rows + 1) * len(names), at.ravel(), np.full(at.size, 0.5))


def _features(batches):
    for b in blocks(batches):
        t, m = text_rows(b), meta_rows(b)
        off = lambda r: pa.array(r.off.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("doc_id", "label", "rate", "fold")), pa.ListArray.from_arrays(off(t), pa.array(t.at.astype(np.int32))),
             pa.ListArray.from_arrays(off(t), pa.array(t.value.astype(np.float32))),
             pa.ListArray.from_arrays(off(m), pa.array(m.at.astype(np.int32)))], names=["doc_id", "label", "rate", "fold", "at", "value", "meta"])


# -------------------------------------------------------------------- fitting

def logistic(rows: Rows, label: np.ndarray, weight: np.ndarray, dim: int, ridge: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Weights (the last one the intercept) of a ridge logistic fit, by L-BFGS."""
    owner, total = rows.owner(), weight.sum()
    sign = 2 * label - 1

    def loss(w):
        z = sign * (np.bincount(owner, weights=rows.value * w[rows.at], minlength=len(rows)) + w[-1])
        r = -sign * weight / (1 + np.exp(np.clip(z, -500, 500))) / total
        g = np.bincount(rows.at, weights=rows.value * r[owner], minlength=dim + 1) + ridge * w
        g[-1] = r.sum()
        return (weight * np.logaddexp(0, -z)).sum() / total + ridge / 2 * (w[:-1] @ w[:-1]), g
    w = np.zeros(dim + 1)
    f, g = loss(w)
    past: list[tuple] = []
    for _ in range(steps):
        d, a = -g, []
        for s, y, rho in reversed(past):
            a.append(rho * (s @ d))
            d = d - a[-1] * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y, rho), x in zip(past, reversed(a)):
            d = d + s * (x - rho * (y @ d))
        step = 1.0
        while True:
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 2
        s, y = step * d, g2 - g
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y, 1 / (s @ y))]
        done = abs(f - f2) < 1e-7
        w, f, g = w + s, f2, g2
        if done:
            break
    return w


def _dense(*columns: np.ndarray) -> Rows:
    table = np.stack(columns, 1)
    return Rows(np.arange(len(table) + 1) * table.shape[1], np.tile(np.arange(table.shape[1]), len(table)), table.ravel())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class CoTrained:
    """The fitted views, their calibration and their weights."""
    prior: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: dict[str, np.ndarray] = field(default_factory=dict)
    mix: np.ndarray | None = None

    def logit(self, view: str, rows: Rows) -> np.ndarray:
        w, (slope, shift) = self.weights[view], self.calibration[view]
        return slope * (rows.dot(w[:-1]) + w[-1]) + shift

    def scores(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        if self.mix is None:
            return [np.full(batch.num_rows, self.prior)] * 3
        z = [self.logit("text", text_rows(batch)), self.logit("meta", meta_rows(batch))]
        return [_sigmoid(z[0]), _sigmoid(z[1]), _sigmoid(self.mix[0] * z[0] + self.mix[1] * z[1] + self.mix[2])]


def samples(docs: DataFrame, labels: DataFrame, sample_rows: int, pool_rows: int) -> tuple[DataFrame, float]:
    """doc_id, label (null in the pool), fold and rate (the share of its class
    that is sampled) of the documents to fit on, and the labelled share of
    quality 1.  Reads no text."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    # counted before the join, so that a doc_id of many rows is one row in it
    each = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    each = written(each.withColumn("fold", fold().cast("int")), "labelled")
    good, labelled = F.col("label") >= 0.5, F.col("label").isNotNull()
    fits = labelled & ~F.col("fold").isin(0, 1)
    count = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    n0, n1, pool, prior = each.agg(count(fits & ~good), count(fits & good), count(~labelled),
                                   F.sum(F.col("n") * F.col("label")) / F.nullif(count(labelled), F.lit(0))).first()
    half = sample_rows / 2
    rate = [min(1.0, max(half, sample_rows - other) / max(n, 1)) for n, other in ((n0, n1), (n1, n0))]
    rate = F.when(~labelled, min(1.0, pool_rows / max(pool, 1))).when(good, rate[1]).otherwise(rate[0])
    chosen = each.where(fits | ~labelled).select("doc_id", "label", "fold", rate.alias("rate"), "n")
    return (chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (F.col("rate") * (1 << 30)).cast("long")),
            0.5 if prior is None else prior)


def train(docs: DataFrame, labels: DataFrame, rounds: int = 2, confident: float = 0.95, pseudo_weight: float = 0.3,
          sample_rows: int = 10_000, pool_rows: int = 10_000, id_rows: int = 4) -> CoTrained:
    chosen, prior = samples(docs, labels, sample_rows, pool_rows)
    sample = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), "doc_id")
    # of a doc_id of many rows about ``id_rows`` are taken, by a hash of their text; weights make up for it
    thin = F.least(F.lit(1.0), F.lit(float(id_rows)) / F.col("n"))
    sample = sample.where(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(1 << 30)) < (thin * (1 << 30)).cast("long")).withColumn("rate", F.col("rate") * thin).drop("n")
    # and never more, where these rows are copies of each other
    sample = sample.limit(2 * (sample_rows + pool_rows))
    schema = T.StructType([sample.schema["doc_id"], *T.StructType.fromDDL(
        "label double, rate double, fold int, at array<int>, value array<float>, meta array<int>").fields])
    rows = written(sample.mapInArrow(_features, schema), "co-training")
    got = rows.orderBy("doc_id").toArrow().combine_chunks()
    label = pc.fill_null(got.column("label"), -1.0).to_numpy()
    part = got.column("fold").to_numpy()
    flat = lambda c: got.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = lambda c: np.concatenate([[0], np.cumsum(pc.list_value_length(got.column(c)).to_numpy())])
    if not len(label):
        return CoTrained(prior)
    views = {"text": Rows(sizes("at"), flat("at").astype(np.int64), flat("value").astype(float)),
             "meta": Rows(sizes("meta"), flat("meta").astype(np.int64), np.full(len(flat("meta")), 0.5))}
    dims = {"text": (1 << BITS["text"]) + _SHAPE, "meta": 1 << BITS["meta"]}
    fit, check, pool = (np.flatnonzero(x) for x in ((label >= 0) & (part > 2), (label >= 0) & (part == 2), label < 0))
    model = CoTrained(prior)
    if len(set(label[fit])) < 2 or len(set(label[check])) < 2:
        return model
    extra = {v: (pool[:0], label[:0]) for v in VIEWS}
    each = 1 / got.column("rate").to_numpy()
    each /= each[label >= 0].mean()
    for k in range(rounds + 1):
        for v in VIEWS:
            more, said = extra[v]
            which = np.concatenate([fit, more])
            weight = np.concatenate([each[fit], np.full(len(more), pseudo_weight)])
            model.weights[v] = logistic(views[v].pick(which), np.concatenate([label[fit], said]), weight, dims[v])
            model.calibration[v] = np.array([1.0, 0.0])
            model.calibration[v] = logistic(_dense(model.logit(v, views[v].pick(check))), label[check], each[check], 1, 1e-3)
        if k < rounds:
            for v, other in (VIEWS, VIEWS[::-1]):
                p = _sigmoid(model.logit(v, views[v].pick(pool)))
                sure = (p >= confident) | (p <= 1 - confident)
                extra[other] = (pool[sure], (p[sure] >= confident).astype(float))
    model.mix = logistic(_dense(*(model.logit(v, views[v].pick(check)) for v in VIEWS)), label[check], each[check], 2, 1e-3)
    return model


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, meta_score and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def run(batches):
        for b in blocks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in shared.value.scores(b))],
                                             names=["doc_id", "text_score", "meta_score", "score"])
    names = ("text_score", "meta_score", "score")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in names)]))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, held_out, the views' scores, score, and good."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "text_score", "meta_score", "score",
                                                   (F.col("score") >= threshold).alias("good"))
