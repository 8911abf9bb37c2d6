"""N-gram language-model scoring over sharded Elias-Fano tries.

The model is a bigram model with absolute discounting that backs off to
smoothed unigrams: P(w | h) = (c(h, w) - D) / c(h) for bigrams seen in training,
else D * n(h) / c(h) * P(w), with n(h) the distinct words after h, P(w) the
base's unigram estimate, and P(w) alone after an unseen h.  A text begins after
a start mark and ends in an end token.

N-grams are sharded by a hash of their context, so that everything about a
context lies in one shard.  The number of shards follows from the measured bytes of
text, ``SHARD_BYTES`` each, and a shard is one task.  Each block of texts sends a
shard one compressed message: its distinct bigrams there, with the documents
that hold them.  The shard's task puts its messages into a file of its own, adds up
their bigram counts message by message, builds a trie of two levels, writes it to
one file and maps it into memory:

* contexts, as an Elias-Fano sequence of their hashes, with monotone pointers
  (Elias-Fano again) to their bigrams;
* bigrams, as numbers in the shard's vocabulary, made monotone by adding the
  last value of the context before; a word is found by a successor search from
  its context's own base inside its context's range;
* log probabilities, quantised to 8 bits a level, codebooks by equal shares.

The task then scores its messages, one at a time, and returns each document's part of the sums,
unigram counts, and, for unseen bigrams, the words to look up.  Those are joined
to the unigram table by a shuffle join.  Nothing grows on the driver.

Words are identified by 64-bit hashes.

Defined results: null text is empty and scores its end token; rows with a null
doc_id train; repeated rows each train and are each scored; an empty table
gives no rows; extra columns never enter; without training rows the counts are
zero and scores are those of the smoothed empty model.
"""

from __future__ import annotations

import json
import math
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemail.llm.common import blocks, coded, row_crc_mod, split_words, text_of, written
from tidemail.llm.elias_fano import EliasFano

#: Bytes of text a shard stands for, and bigrams it adds up at once.
SHARD_BYTES = 16 << 20
PENDING = 1 << 19
#: Bytes of text a task cuts into messages at once.
MESSAGE_BYTES = 3 << 20
DISCOUNT = 0.75
ALPHA = 0.1
#: Hashes of the marks before and after a text; words hash with another seed.
START, END = xxhash.xxh64_intdigest(b"start", 1), xxhash.xxh64_intdigest(b"end", 1)


def held_out() -> Column:
    return row_crc_mod("doc_id", 10) == 0


# ------------------------------------------------------------------ messages

def _pack(**arrays: np.ndarray) -> bytes:
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays.values()))


def _unpack(message: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(message)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, n in json.loads(raw[4:at]):
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    return out


def _messages(shards: int):
    """Per block: one message a shard, and one (shard -1) of its documents."""
    def run(batches):
        part, before = TaskContext.get().partitionId(), 0
        for b in blocks(batches, "text", MESSAGE_BYTES):
            flat, off = split_words(pc.ascii_lower(text_of(b)))
            index, values = coded(flat)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, values.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(values))
            hashes = np.concatenate([hashes, np.array([START, END], np.uint64)])
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            hashes = hashes[order]
            n_words = np.diff(off)
            doc = np.repeat(np.arange(b.num_rows), n_words + 1)
            word = np.insert(place[index], off[1:], place[-1])
            prev = np.insert(place[index], off[:-1], place[-2])
            v = len(hashes)
            pair = prev * v + word
            by = np.argsort(pair, kind="stable")
            pair, doc = pair[by], doc[by]
            new_pair = np.concatenate([[True], pair[1:] != pair[:-1]])
            new_post = new_pair | np.concatenate([[True], doc[1:] != doc[:-1]])
            posts = np.flatnonzero(new_post)
            times = np.diff(np.concatenate([posts, [len(pair)]])).astype(np.uint32)
            post_doc, post_pair = doc[posts].astype(np.uint32), np.cumsum(new_pair)[posts] - 1
            pairs = pair[new_pair]
            first, second = hashes[pairs // v], hashes[pairs % v]
            n_posts = np.bincount(post_pair, minlength=len(pairs)).astype(np.uint32)
            # by shard, and in a shard by context and word as before; a pair's posts stay together
            shard = (first % np.uint64(shards)).astype(np.int64)
            by = np.argsort(shard, kind="stable")
            first, second, n_of = first[by], second[by], n_posts[by]
            post_at = (np.cumsum(n_posts.astype(np.int64)) - n_posts)[by]
            bounds = np.searchsorted(shard[by], np.arange(shards + 1))
            key = (part << 40) + before
            before += b.num_rows
            train = b.column("train").to_numpy(zero_copy_only=False)
            out = [(-1, key, _pack(doc_id=pc.fill_null(b.column("doc_id"), 0).to_numpy(zero_copy_only=False),
                                   null=b.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.uint8),
                                   train=train.astype(np.uint8), n=n_words + 1))]
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                lo, hi = bounds[s], bounds[s + 1]
                a, n = first[lo:hi], n_of[lo:hi].astype(np.int64)
                c = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                p = np.arange(int(n.sum())) + np.repeat(post_at[lo:hi] - (np.cumsum(n) - n), n)
                out.append((s, key, _pack(context=a[c], n_pairs=np.diff(np.concatenate([c, [len(a)]])).astype(np.uint32),
                                          word=second[lo:hi], n_posts=n_of[lo:hi], doc=post_doc[p], times=times[p],
                                          train=train.astype(np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary()))],
                                             names=["shard", "key", "message"])
    return run


# ---------------------------------------------------------------- the trie

def _codebook(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most 256 levels by equal shares, and each value's level."""
    distinct, at, n = np.unique(values, return_inverse=True, return_counts=True)
    if len(distinct) <= 256:
        return distinct, at.astype(np.uint8)
    level = np.minimum((np.cumsum(n) - n) * 256 // len(values), 255)
    level = np.unique(level, return_inverse=True)[1]
    book = np.bincount(level, weights=distinct * n) / np.bincount(level, weights=n)
    return book, level[at].astype(np.uint8)


class Trie:
    """One shard's contexts and bigrams (sorted by context, then word)."""

    def __init__(self, context: np.ndarray, word: np.ndarray, count: np.ndarray, occurs: np.ndarray, contexts: np.ndarray):
        """``contexts``: sorted distinct hashes; ``occurs``: their counts."""
        self.contexts = EliasFano(contexts)
        self.vocabulary = np.unique(word)
        ids = np.searchsorted(self.vocabulary, word).astype(np.int64)
        size = np.bincount(context, minlength=len(contexts))
        ends = np.cumsum(size)
        last = np.where(size > 0, ids[ends - 1] if len(ids) else 0, -1) + 1
        self.pointers = EliasFano(np.concatenate([[0], ends]))
        base = np.concatenate([[0], np.cumsum(last)])
        self.bases = EliasFano(base)
        self.words = EliasFano((base[:-1][context] + ids).astype(np.uint64))
        self.book, self.level = _codebook(np.log10((count - DISCOUNT) / occurs[context]))
        self.bow_book, self.bow_level = _codebook(np.log10(np.where(size > 0, DISCOUNT * size, 1) / np.maximum(occurs, 1)))
        self._map()

    def _map(self):
        """The levels' arrays go to one file that is mapped into memory."""
        owners = [(e, n) for e in (self.contexts, self.pointers, self.bases, self.words) for n in ("high", "ones", "low")]
        owners += [(self, n) for n in ("vocabulary", "level", "bow_level")]
        with tempfile.TemporaryFile() as f:
            places = []
            for o, n in owners:
                a = getattr(o, n)
                places.append((f.tell(), a.dtype, len(a)))
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
            f.write(b"\0" * 8)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        for (o, n), (at, kind, size) in zip(owners, places):
            setattr(o, n, np.frombuffer(held, kind, size, at))

    def score(self, context: np.ndarray, n_words: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word (``n_words`` of them after each context): its log10
        probability or, where the bigram is unseen, the context's backoff
        weight (0 for an unseen context); and which are seen."""
        if not self.contexts.n:
            return np.zeros(len(word)), np.zeros(len(word), bool)
        at = self.contexts.find(context)
        known = at >= 0
        safe = np.maximum(at, 0)
        lo, hi, base = (x.astype(np.int64) for x in (self.pointers[safe], self.pointers[safe + 1], self.bases[safe]))
        bow = np.where(known, self.bow_book[self.bow_level[safe]], 0.0)
        hi = np.where(known, hi, lo)
        ids = np.searchsorted(self.vocabulary, word)
        ids = np.minimum(ids, max(0, len(self.vocabulary) - 1))
        has = self.vocabulary[ids] == word if len(self.vocabulary) else np.zeros(len(word), bool)
        of = np.repeat(np.arange(len(context)), n_words)
        found = self.words.find((base[of] + ids).astype(np.uint64), lo[of], np.where(has, hi[of], lo[of]))
        seen = found >= 0
        value = np.where(seen, self.book[self.level[np.maximum(found, 0)]] if len(self.book) else 0.0, bow[of])
        return value, seen


class Counts:
    """Training counts of a shard's bigrams, added up message by message."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = self.held = 0

    def add(self, m: dict):
        pair = np.repeat(np.arange(len(m["word"])), m["n_posts"])
        n = np.bincount(pair, weights=m["times"] * m["train"][m["doc"]], minlength=len(m["word"])).astype(np.int64)
        has = n > 0
        self.parts.append((np.repeat(m["context"], m["n_pairs"])[has], m["word"][has], n[has]))
        self.pending += int(has.sum())
        if self.pending > max(PENDING, self.held):       # as many again as are held: each is added up a few times only
            self.compact()

    def compact(self):
        if self.pending:
            first, word, count = (np.concatenate(x) for x in zip(*self.parts))
            self.parts.clear()
            by = np.lexsort((word, first))
            first, word, count = first[by], word[by], count[by]
            new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (word[1:] != word[:-1])]))
            self.parts = [(first[new], word[new], np.add.reduceat(count, new))]
            self.held, self.pending = len(new), 0

    def trie(self) -> tuple[Trie, np.ndarray, np.ndarray]:
        """The trie, its contexts and their counts."""
        self.compact()
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        first, word, count = self.parts.pop() if self.parts else none
        contexts, c = np.unique(first, return_inverse=True)
        del first
        occurs = np.bincount(c, weights=count, minlength=len(contexts)).astype(np.int64)
        return Trie(c, word, count, occurs, contexts), contexts, occurs


_NAMES = ["kind", "key", "other", "n", "n_known", "base", "score"]
_KINDS = (pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
#: Kinds of rows that a shard returns.
DOCUMENT, UNIGRAM, PART, UNSEEN = range(4)


def _rows(kind, key, other=None, n=None, n_known=None, base=None, score=None):
    size = len(key)
    cols = [np.full(size, kind, np.int8), key, other, n, n_known, base, score]
    return pa.RecordBatch.from_arrays([pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def _messages_of(f, ends: list[int]) -> Iterator[dict]:
    """The messages kept in a file, one at a time."""
    f.seek(0)
    for start, end in zip([0, *ends], ends):
        yield _unpack(f.read(end - start))


def _shard_task(batches):
    """One shard's messages, and those of some documents."""
    with tempfile.TemporaryFile() as f:
        keys, ends, counts = [], [], Counts()
        for b in batches:
            for shard, key, message in zip(b.column("shard").to_pylist(), b.column("key").to_pylist(), b.column("message")):
                message = message.as_buffer()
                m = _unpack(message)
                if shard < 0:
                    ids = pa.array(m["doc_id"], pa.int64(), mask=m["null"].astype(bool))
                    yield _rows(DOCUMENT, key + np.arange(len(ids)), ids, m["n"], m["train"].astype(np.int64))
                    continue
                counts.add(m)
                f.write(message)
                keys.append(key)
                ends.append(f.tell())
        if not keys:
            return
        trie, contexts, occurs = counts.trie()
        real = contexts != np.uint64(START)
        yield _rows(UNIGRAM, contexts[real].view(np.int64), None, occurs[real])
        for key, m in zip(keys, _messages_of(f, ends)):
            value, seen = trie.score(m["context"], m["n_pairs"], m["word"])
            at = np.searchsorted(contexts, m["context"])
            at = np.minimum(at, max(0, len(contexts) - 1))
            c = np.where(contexts[at] == m["context"], occurs[at], 0) if len(contexts) else np.zeros(len(m["context"]), np.int64)
            token = m["context"] != np.uint64(START)          # a context is a token of its text, but for the mark
            pair = np.repeat(np.arange(len(m["word"])), m["n_posts"])
            of = np.repeat(np.arange(len(c)), m["n_pairs"])[pair]
            doc, times = m["doc"].astype(np.int64), m["times"].astype(np.float64)
            n_docs = len(m["train"])
            add = lambda x: np.bincount(doc, weights=times * x, minlength=n_docs)
            touched = np.flatnonzero(np.bincount(doc, minlength=n_docs))
            yield _rows(PART, key + touched, None, None, add((token & (c > 0))[of])[touched].astype(np.int64),
                        add((np.log10(c + ALPHA) * token)[of])[touched], add(value[pair])[touched])
            miss = ~seen[pair]
            if miss.any():
                yield _rows(UNSEEN, key + doc[miss], m["word"][pair[miss]].view(np.int64), m["times"][miss].astype(np.int64))


def score(docs: DataFrame, train: Column, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, trains (its value of ``train``), n_tokens, n_known,
    train_tokens, base_score and score."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // shard_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    messages = rows.mapInArrow(_messages(shards), "shard int, key long, message binary")
    # documents' own messages go everywhere, a shard's to the task of its number
    place = F.when(F.col("shard") < 0, F.xxhash64("key") % shards).otherwise(F.col("shard").cast("long"))
    out = written(messages.repartitionById(shards, F.pmod(place, F.lit(shards)).cast("int")).mapInArrow(
        _shard_task, "kind byte, key long, other long, n long, n_known long, base double, score double"), "lm")
    unigrams = out.where(F.col("kind") == UNIGRAM).select(F.col("key").alias("word"), F.col("n").alias("c"))
    documents = out.where(F.col("kind") == DOCUMENT).select("key", F.col("other").alias("doc_id"), F.col("n").alias("n_tokens"),
                                                            (F.col("n_known") == 1).alias("trains"))
    tokens, types = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = documents.where("trains").count()
    total, distinct = tokens + ends, types + (ends > 0)
    mass = math.log10(total + ALPHA * (distinct + 1))
    end = math.log10(ends + ALPHA)
    unseen = (out.where((F.col("kind") == UNSEEN)).select("key", F.col("other").alias("word"), "n").groupBy("key", "word").agg(F.sum("n").alias("n")))
    end_hash = END - (1 << 64) if END >> 63 else END
    c = F.when(F.col("word") == end_hash, F.lit(ends)).otherwise(F.coalesce("c", F.lit(0)))
    backed = (unseen.join(unigrams, "word", "left").groupBy("key")
              .agg(F.sum(F.col("n") * (F.log10(c + F.lit(ALPHA)) - F.lit(mass))).alias("score")))
    parts = out.where(F.col("kind") == PART).select("key", "n_known", "base", "score")
    parts = parts.unionByName(backed.select("key", F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base"), "score"))
    sums = parts.groupBy("key").agg(F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return documents.join(sums, "key", "left").select(
        "doc_id", "trains", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.lit(end) - F.col("n_tokens") * F.lit(mass)).alias("base_score"), "score")


def report(docs: DataFrame) -> DataFrame:
    return score(docs, ~held_out()).select("doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                                           "base_score", "score")
