"""Target-distribution importance resampling by bit-sliced aggregation.

A document's features are all runs of one to three consecutive words; each falls
into one of ``BUCKETS`` buckets by the crc32 of its bytes.  A bucket's gain is the
smoothed log ratio of its share among the target's features to its share among
the documents'.  A document's weight is the sum of its features' gains.

The sum is taken over bit planes.  A document's bucket counts become planes of
one bit a bucket: plane j holds bit j of every count.  The gains, as two's
complement integers, become planes likewise, the highest being negative.  Then

    weight = sum over j, k of 2^j * 2^k * popcount(plane_j & gain_k)

with a minus for the sign plane, exact in integers.  A task holds the planes of
a few documents at a time.  The bucket totals are one row a bucket and task,
added up by Spark, so ``BUCKETS`` rows are what the driver and the tasks get.

Features are hashed without building their strings: crc32 is linear, so the
crc of a run is the crc of its beginning, shifted by the length of the next
word, xor the crc of that word.

The draw takes the highest scores (weight plus Gumbel noise from a hash of
doc_id).  An approximate quantile gives a score that is surely not above the cut;
the rows from there on are ordered in range partitions and numbered from counts
of the partitions.  No task sees all rows, and no row is joined.

Defined results: null text has no words (weight 0); a null doc_id draws with the
hash of ``<seed>:`` and comes after others in ties; repeated rows count, score
and rank one by one (rows equal in all returned columns are interchangeable); an
empty table gives no rows, an empty target gains from the smoothing only; extra
columns never enter.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.llm.common import blocks, coded, split_words, text_of, translate, written
from tidemail.operators.sampling import with_row_index

BUCKETS = 10_000
#: Documents, and words, whose counts a task holds at once.
GROUP_DOCS, GROUP_WORDS = 64, 1 << 18

#: Upper-case ASCII to lower case; other ASCII that is no letter or digit to a space.
_BYTES = np.arange(256, dtype=np.uint8)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_WORD = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | (_BYTES >= 128)
WORD_BYTES = np.where(_UPPER, _BYTES + 32, np.where(_WORD, _BYTES, 32)).astype(np.uint8)


# ------------------------------------------------------------- crc32 of runs

class Shift:
    """crc32 values moved past a number of bytes: ``crc(a + b)`` is
    ``shift(crc(a), len(b)) ^ crc(b)``.  Level i has a table for each of 0 to 255
    times 256^i bytes, built from the level below."""

    def __init__(self):
        self.levels = [self._tables(lambda c: (c >> np.uint32(8)) ^ _zero_byte()[c & np.uint32(255)])]

    @staticmethod
    def _tables(step) -> np.ndarray:
        t = np.empty((256, 4, 256), np.uint32)
        t[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(1, 256):
            t[n] = step(t[n - 1])
        return t

    @staticmethod
    def _apply(t: np.ndarray, n, c: np.ndarray) -> np.ndarray:
        return t[n, 0, c & 255] ^ t[n, 1, (c >> 8) & 255] ^ t[n, 2, (c >> 16) & 255] ^ t[n, 3, c >> 24]

    def __call__(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        level, top = 0, int(n.max(initial=0))
        while top >> (8 * level):
            if level == len(self.levels):
                below = self.levels[-1]
                self.levels.append(self._tables(lambda x: self._apply(below, 1, self._apply(below, 255, x))))
            c = self._apply(self.levels[level], (n >> (8 * level)) & 255, c)
            level += 1
        return c


def _zero_byte() -> np.ndarray:
    """What one zero byte makes of a register with only its low byte set."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_SHIFT = Shift()
_SPACE = np.uint32(zlib.crc32(b" "))


def words_of(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    return split_words(translate(texts, WORD_BYTES))


def n_features(n_words: np.ndarray) -> np.ndarray:
    return n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)


def bucket_counts(texts: pa.StringArray, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of documents: the first one's place, their words, and their
    features' counts by bucket (documents x buckets)."""
    flat, off = words_of(texts)
    index, values = coded(flat)
    raw = values.cast(pa.binary()).to_pylist()
    crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    spaced = _SHIFT(crc, np.ones(len(raw), np.int64)) ^ _SPACE       # the word and the space after it
    n_words = np.diff(off)
    first = 0
    while first < len(texts):
        end = int(np.searchsorted(off, off[first] + GROUP_WORDS, "right")) - 1
        end = min(max(end, first + 1), first + GROUP_DOCS, len(texts))
        counts = np.zeros((end - first) * buckets, np.int64)
        for a in range(int(off[first]), int(off[end]), GROUP_WORDS):
            b = min(a + GROUP_WORDS, int(off[end]))
            w = index[a:min(b + 2, int(off[end]))]                    # runs that begin in [a, b)
            doc = np.searchsorted(off[first:end + 1], np.arange(a, a + len(w)), "right") - 1
            found = [(doc[:b - a], crc[w[:b - a]])]
            if len(w) > 1:
                pair = _SHIFT(spaced[w[:-1]], size[w[1:]]) ^ crc[w[1:]]
                same = (doc[:-1] == doc[1:])[:b - a]
                found.append((doc[:-1][:b - a][same], pair[:b - a][same]))
            if len(w) > 2:
                begun = _SHIFT(pair[:-1], np.ones(len(w) - 2, np.int64)) ^ _SPACE
                three = _SHIFT(begun, size[w[2:]]) ^ crc[w[2:]]
                same = (doc[:-2] == doc[2:])[:b - a]
                found.append((doc[:-2][:b - a][same], three[:b - a][same]))
            at = np.concatenate([d * buckets + c % np.uint32(buckets) for d, c in found])
            counts += np.bincount(at, minlength=len(counts))
        yield first, n_words[first:end], counts.reshape(end - first, buckets)
        first = end


def bucket_totals(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: a row a bucket and
    task, added up by Spark."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in blocks(batches, "__text"):
            for _, _, counts in bucket_counts(text_of(b, "__text"), buckets):
                total += counts.sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = df.select(F.col(text).alias("__text")).mapInArrow(run, "bucket int, n long")
    summed = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()          # at most ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[summed.column("bucket").to_numpy()] = summed.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share ratio."""
    s_all, t_all, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + k)) / ((s + 1) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


# ------------------------------------------------------------------ bit planes

def planes(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as 64-bit words."""
    packed = np.packbits(bits.astype(bool), axis=-1, bitorder="little")
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """Two's complement planes, the last one negative."""
    width = max(int(np.abs(gain).max(initial=0)).bit_length() + 1, 2)
    return planes((gain[None, :] >> np.arange(width)[:, None]) & 1)


def weights(counts: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Exact sums of count * gain a document, by AND and popcount."""
    out = np.zeros(len(counts), np.int64)
    most = counts.max(axis=1, initial=0)
    for j in range(int(most.max(initial=0)).bit_length()):
        rows = np.flatnonzero(most >> j)                              # documents with a count of 2^j or more
        plane = planes((counts[rows] >> j) & 1)
        for k, g in enumerate(gain):
            n = np.bitwise_count(plane & g).sum(axis=1, dtype=np.int64) << (j + k)
            out[rows] += -n if k == len(gain) - 1 else n
    return out


# ---------------------------------------------------------------------- draw

def noise(doc_id: int | None, seed: int = 42) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, target: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, n_words, n_features, weight and score."""
    gain = gain_planes(gains(bucket_totals(docs, buckets=buckets), bucket_totals(target, buckets=buckets)))

    def run(batches):
        for b in blocks(batches, "__text"):
            got = [(n, weights(c, gain)) for _, n, c in bucket_counts(text_of(b, "__text"), buckets)]
            n, w = (np.concatenate(x) for x in zip(*got))
            z = np.array([noise(i, seed) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (n, n_features(n), w, w + z))],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text"))
            .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long"))


def draw(scored: DataFrame, percent: int = 5, min_words: int = 20, accuracy: int = 10_000) -> DataFrame:
    """All rows with ``rank``: 1, 2, ... for the floor(percent * N / 100) highest
    scores of the N rows of ``min_words`` words or more, null for others.

    ``accuracy`` is of the quantile that narrows the rows to be ordered; it
    decides work, never ranks."""
    table = written(scored, "scored")
    can = F.col("n_words") >= min_words
    share = max(0.0, 1 - percent / 100 - 4 / accuracy)
    n, cut = table.where(can).agg(F.count("*"), F.percentile_approx("score", share, accuracy)).first()
    most = percent * n // 100
    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not most:
        return table.select(*names, F.lit(None).cast("long").alias("rank"))
    high = can & (F.col("score") >= cut)
    if table.where(high).count() < most:                 # not by the quantile's bound; kept so that ranks never depend on it
        high = can
    # rows alike in every column spread over the ranges by their place in the table
    above = table.where(high).withColumn("place", F.monotonically_increasing_id())
    at = with_row_index(above, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"], "rank")
    rank = F.when(F.col("rank") < most, F.col("rank") + 1)
    rest = table.where(F.coalesce(~high, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    return at.select(*names, rank.alias("rank")).unionByName(rest.select(*names, "rank"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return draw(score(docs, benchmark)).select("doc_id", "n_features", "weight", "score", "rank")
