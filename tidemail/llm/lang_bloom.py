"""Language identification with language-bitmask n-gram filters.

Training counts the character n-grams (2 to 4, word edges included) of every
word by language.  An n-gram belongs to a language's filter if it makes up at
least ``min_share`` of that language's n-grams (so a filter holds at most
1 / min_share of them, whatever the corpus) and at least ``1 / spread`` of its
share in the language where it is commonest.  The Bloom filters of all
languages lie bit-sliced in one array: slot s holds a mask with one bit for
each language, so the AND of a few slots gives all languages that contain an
n-gram at once.

Training reads a bounded sample of labelled rows (``max_rows``), every row's
prediction its whole text.  A document's score of a language is its number of n-grams in that filter,
corrected for the filter's false positives; the largest wins, ties go to the
first language in order.  ``score`` is the winner's share of all corrected
counts (0 if no n-gram is known).  It falls as languages are added, so
``keep_identified`` judges by another number: the share of the document's
n-grams in the winner's filter, over that share in the language's own training
text (n-grams seen once there count as not held, as new text has others).  Other languages' filters do not enter it.

Defined results: null text or text without a letter is ``und`` with score 0;
text of which no n-gram is known gets the commonest training language with
score 0; without training rows everything is ``und``; rows with null lang do
not train; repeated rows count as often as they occur; extra columns never
enter a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.llm.common import blocks, coded, fresh, row_crc_mod, split_words, text_of, translate, written

LENGTHS = (2, 3, 4)
#: A block's n-grams take some 60 times its bytes in memory.
_BLOCK = 2 << 20
UND = "und"
#: ASCII letters stay, other ASCII becomes a space.
_LETTERS = np.full(256, 0x20, np.uint8)
for _b in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LETTERS[_b] = _b
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams (hashed) of each word, and the word each comes from."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    text = " " + pc.binary_join(whole, " ")[0].as_py() + " "
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = points == 0x20
    word = np.cumsum(space) - 1
    grams, owner = [], []
    for n in LENGTHS:
        if len(points) < n:
            continue
        code = np.zeros(len(points) - n + 1, np.uint64)
        inner = np.zeros(len(code), np.uint8)
        for j in range(n):
            piece = slice(j, j + len(code))
            code = (code ^ points[piece]) * _MIX
            code ^= code >> np.uint64(29)
            if 0 < j < n - 1:
                inner |= space[piece]
        ok = (inner == 0) & ~(space[:len(code)] & space[n - 1:n - 1 + len(code)])
        grams.append(code[ok] * _MIX + np.uint64(n))
        owner.append(word[:len(code)][ok])
    return np.concatenate(grams), np.concatenate(owner)


def _words(batch: pa.RecordBatch, column: str):
    flat, off = split_words(pc.utf8_lower(translate(text_of(batch, column), _LETTERS)))
    index, values = coded(flat)
    return index, off, values


def _counter(batches):
    """(lang, gram, n) of each block of rows."""
    for b in blocks(batches, max_bytes=_BLOCK):
        index, off, values = _words(b, "text")
        lang, langs = coded(b.column("lang"))
        per_word = np.repeat(lang, np.diff(off))
        grams, owner = ngrams(values)
        code, inverse = np.unique(grams, return_inverse=True)
        out = []
        for l in range(len(langs)):
            n = np.bincount(index[per_word == l], minlength=len(values))
            each = np.bincount(inverse, weights=n[owner], minlength=len(code)).astype(np.int64)
            has = each > 0
            out.append(pa.RecordBatch.from_arrays(
                [pa.array([langs[l].as_py()] * int(has.sum()), pa.string()), pa.array(code[has].view(np.int64)),
                 pa.array(each[has])], names=["lang", "gram", "n"]))
        yield from out


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], commonest: str | None,
                 slots: int = 1 << 20, probes: int = 4, usual: np.ndarray | None = None):
        self.langs, self.commonest, self.slots, self.probes = langs, commonest, slots, probes
        #: Share of each language's training n-grams that its filter holds, without those seen once: what new text may hold.
        self.usual = np.ones(len(langs)) if usual is None else usual
        self.mask = np.zeros(((len(langs) + 63) // 64, slots), np.uint64)
        for l, name in enumerate(langs):
            for at in self._places(grams[name]):
                np.bitwise_or.at(self.mask[l // 64], at, np.uint64(1 << (l % 64)))
        fill = [float(np.mean((self.mask[l // 64] >> np.uint64(l % 64)) & np.uint64(1))) for l in range(len(langs))]
        self.false = np.array([f ** probes for f in fill])

    def _places(self, grams: np.ndarray):
        for k in range(self.probes):
            x = (grams ^ np.uint64(0xD1B54A32D192ED03 * (k + 1) & (1 << 64) - 1)) * _MIX
            yield ((x ^ (x >> np.uint64(32))) * _MIX >> np.uint64(40)).astype(np.int64) % self.slots

    def hits(self, grams: np.ndarray, owner: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Per word: n-grams in each language's filter, and n-grams in all."""
        rows = np.full((len(self.mask), len(grams)), (1 << 64) - 1, np.uint64)
        for at in self._places(grams):
            rows &= self.mask[:, at]
        each = [np.bincount(owner[(rows[l // 64] >> np.uint64(l % 64)) & np.uint64(1) == 1], minlength=n_words)
                for l in range(len(self.langs))]
        return np.array(each).reshape(len(self.langs), n_words), np.bincount(owner, minlength=n_words)


def train(docs: DataFrame, min_share: float = 1e-5, spread: float = 8.0, max_rows: int = 20_000, each_rows: int = 500) -> Filters:
    """Filters from the text and non-null lang of about ``max_rows`` labelled
    rows (all, if there are no more), chosen by a hash of doc_id and text, and of at
    least about ``each_rows`` rows of each language, so that a rare language of a
    large corpus has a filter too.  What reaches the driver is at most
    1 / min_share n-grams for each language."""
    rows = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    rows_of = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    n = sum(rows_of.values())
    if n > max_rows:
        rate = {l: int(min(1.0, max(max_rows / n, each_rows / k)) * (1 << 30)) for l, k in rows_of.items()}
        under = F.element_at(F.create_map(*[F.lit(x) for kv in rate.items() for x in kv]), F.col("lang"))
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < under)
    rows = rows.select("text", "lang")
    counts = rows.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "ngrams")
    total = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    if not total:
        return Filters([], {}, None)
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for kv in total.items() for x in kv]), F.col("lang"))
    own = counts.withColumn("share", share).where(F.col("share") >= min_share)
    top = own.groupBy("gram").agg(F.max("share").alias("top"))
    kept = own.join(top, "gram").where(F.col("share") * spread >= F.col("top")).select("lang", "gram", "n").toArrow()
    langs = sorted(total)
    names = kept.column("lang").to_pylist()
    codes = kept.column("gram").to_numpy().view(np.uint64)
    of = np.array([langs.index(x) for x in names], np.int64)
    n = kept.column("n").to_numpy()
    usual = np.bincount(of, weights=np.where(n > 1, n, 0), minlength=len(langs)) / [total[l] for l in langs]
    return Filters(langs, {l: codes[of == i] for i, l in enumerate(langs)}, min(langs, key=lambda l: (-total[l], l)), usual=usual)


def _predictor(filters_bc, column: str, pred: str, score: str, held: str | None):
    def run(batches):
        f = filters_bc.value
        n_langs = len(f.langs)
        for b in blocks(batches, column, _BLOCK):
            index, off, values = _words(b, column)
            letter = pc.match_substring_regex(text_of(b, column), r"\p{L}").to_numpy(zero_copy_only=False)
            if not n_langs:
                best, share, own, letter = np.zeros(b.num_rows, np.int64), *np.zeros((2, b.num_rows)), np.zeros(b.num_rows, bool)
            else:
                per_word, n_grams = f.hits(*ngrams(values), len(values))
                doc = np.repeat(np.arange(b.num_rows), np.diff(off))
                total = np.bincount(doc, weights=n_grams[index], minlength=b.num_rows)
                found = np.array([np.bincount(doc, weights=per_word[l][index], minlength=b.num_rows) for l in range(n_langs)])
                real = np.maximum(0, (found - total * f.false[:, None]) / (1 - f.false[:, None]))
                best, every = real.argmax(0), real.sum(0)
                share = np.divide(real.max(0), every, out=np.zeros(b.num_rows), where=every > 0)
                usual = total * np.maximum(f.usual, 1e-9)[best]
                own = np.divide(real.max(0), usual, out=np.zeros(b.num_rows), where=usual > 0)
                best = np.where(every > 0, best, f.langs.index(f.commonest))
            names = np.array([*f.langs, UND], object)[np.where(letter, best, n_langs)]
            out = {pred: pa.array(names, pa.string()), score: pa.array(np.where(letter, share, 0.0))}
            if held:
                out[held] = pa.array(np.where(letter, own, 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, *out.values()], names=[*b.schema.names, *out])
    return run


def predict(docs: DataFrame, filters: Filters, pred: str = "lang_pred", score: str = "score",
            held: str | None = None) -> DataFrame:
    """``docs`` with two new columns: the language and its score.  ``held``
    names a third one: the share of n-grams in the language's filter, over
    that share in its training text.  The names must be new."""
    if clash := {pred, score, held} & set(docs.columns):
        raise ValueError(f"columns exist: {sorted(clash)}")
    bc = docs.sparkSession.sparkContext.broadcast(filters)
    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType()),
                           *([T.StructField(held, T.DoubleType())] if held else [])])
    return docs.mapInArrow(_predictor(bc, "text", pred, score, held), schema)


def held_out() -> Column:
    return row_crc_mod("doc_id", 4) == 2


def report(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    filters = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_held: float = 0.5) -> DataFrame:
    """Rows of which the identified language's filter holds at least
    ``min_held`` of what it holds of that language's training text."""
    filters = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    pred, score, held = fresh(docs, "pred", "score", "held")
    return predict(docs, filters, pred, score, held).where((F.col(pred) != UND) & (F.col(held) >= min_held)).select(*docs.columns)
