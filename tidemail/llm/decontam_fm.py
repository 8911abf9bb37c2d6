"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task.  Its text is the sequence of word
numbers of the benchmark's vocabulary; words the benchmark does not have, and
runs shorter than its shortest window, can be in no occurrence and stand as
one separator symbol.  Over that sequence the task builds a suffix array, its
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.
All benchmark windows are searched backwards together; occurrences are located
by walking to the next sampled position, and merged into removal spans.

The benchmark is the query set.  It is sent to the tasks in blocks of bounded
size (``block_bytes`` of text); each block is one more pass of the same stage,
without a shuffle.

Defined results: null or wordless text has no words and no hits; an item
without words has no window; an item of fewer words than ``window`` is one
window; an item with a null id marks words but is not listed; repeated rows
are judged each on its own; an empty benchmark or table gives no hits or rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.llm.common import blocks, fresh, split_words, text_of, translate

#: Words: runs of digits, letters and non-ASCII characters, A-Z in lower case.
_WORD_BYTES = np.full(256, 0x20, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD_BYTES[_b] = _b
for _b in range(0x41, 0x5B):
    _WORD_BYTES[_b] = _b + 32

HIT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())),
    T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_SEPARATOR, _FIRST = 1, 2


def words_of(text: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    return split_words(translate(text, _WORD_BYTES))


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.shifts = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self.levels, self.zeros = [], []
        for s in self.shifts:
            bit = (symbols >> s) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(len(symbols) - self.levels[-1].ones)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of ``symbol`` before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for s, level, zeros in zip(self.shifts, self.levels, self.zeros):
            one = (symbol >> s) & 1 == 1
            a, b, c = level.rank(start), level.rank(lo), level.rank(hi)
            start, lo, hi = (np.where(one, zeros + r, i - r) for r, i in ((a, start), (b, lo), (c, hi)))
        return lo - start, hi - start

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its occurrences before ``i``."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for s, level, zeros in zip(self.shifts, self.levels, self.zeros):
            one = level.get(i)
            a, b = level.rank(start), level.rank(i)
            symbol |= one.astype(np.int64) << s
            start, i = (np.where(one, zeros + r, x - r) for r, x in ((a, start), (b, i)))
        return symbol, i - start


class FMIndex:
    """Over a symbol sequence that ends in the unique smallest symbol 0."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = 16):
        order = suffix_array(seq)
        self.n = len(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.bwt = WaveletMatrix(seq[order - 1], n_symbols)
        marked = order % sample == 0
        self.marks, self.samples = Bits(marked.astype(np.uint8)), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of equal length) that occur, and their suffix ranges."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, j]
            lo, hi = self.bwt.rank(symbol, lo, hi)
            lo, hi = self.first[symbol] + lo, self.first[symbol] + hi
            live = hi > lo
            which, lo, hi = which[live], lo[live], hi[live]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, todo, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            done = self.marks.get(rows)
            out[todo[done]] = self.samples[self.marks.rank(rows[done])] + steps
            todo, rows = todo[~done], rows[~done]
            symbol, before = self.bwt.step(rows)
            rows, steps = self.first[symbol] + before, steps + 1
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling."""
    rank, width = seq.astype(np.int64), 1
    while True:
        nxt = np.zeros_like(rank)
        nxt[:-width or None] = rank[width:] + 1 if width < len(rank) else 0
        key = rank * (int(nxt.max(initial=0)) + 1) + nxt
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank[order] = new
        width *= 2
        if new[-1] == len(seq) - 1 or width >= 2 * len(seq):
            return order


class Phrases:
    """The distinct windows of one block of benchmark items, as flat arrays: for
    each length the windows' words, and the items of each window as a range of
    ``items`` (places in ``names``)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        flat, off = words_of(pa.array([t or "" for _, t in items], pa.string()))
        codes = flat.dictionary_encode()
        self.vocabulary, ids = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(_FIRST)
        self.names = sorted({i for i, _ in items if i is not None})
        place = {x: k for k, x in enumerate(self.names)}
        code = np.array([place.get(i, -1) for i, _ in items], np.int64)
        n_words = np.diff(off)
        length = np.minimum(n_words, window)
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(length[length > 0]).tolist():
            mine = np.flatnonzero(length == n)
            many = n_words[mine] - n + 1                    # one, for an item of fewer words than the window
            of = np.repeat(mine, many)
            start = off[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            rows = ids[start[:, None] + np.arange(n)]
            key = rows.view(np.dtype((np.void, rows.itemsize * n))).ravel()
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            pairs = np.unique(which * (len(items) + 1) + code[of] + 1)
            pairs = pairs[pairs % (len(items) + 1) > 0]        # items without an id mark words only
            ends = np.searchsorted(pairs // (len(items) + 1), np.arange(len(first) + 1))
            self.by_length.append((rows[first].astype(np.int64), ends, pairs % (len(items) + 1) - 1))

    @property
    def shortest(self) -> int:
        return min((rows.shape[1] for rows, _, _ in self.by_length), default=0)


def _shard_hits(flat: pa.StringArray, off: np.ndarray, phrases: Phrases):
    """Covered words (0/1), and the (document, item) hits of one shard."""
    n = len(flat)
    edge = np.zeros(n + 1, np.int64)
    found: list[set] = [set() for _ in range(len(off) - 1)]
    if not n or not phrases.by_length:
        return edge[:n], found
    ids = pc.fill_null(pc.index_in(flat, value_set=phrases.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.concatenate([[False], ids >= 0, [False]])
    new_doc = np.zeros(n + 1, bool)
    new_doc[off] = True
    # runs of benchmark words inside one document
    begin = np.flatnonzero(known[1:-1] & (~known[:-2] | new_doc[:-1]))
    end = np.flatnonzero(known[1:-1] & (~known[2:] | new_doc[1:])) + 1
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return edge[:n], found
    size = end - begin
    at = np.arange(size.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    place = np.arange(len(at)) + np.repeat(np.arange(len(size)), size)
    seq = np.full(len(at) + len(size) + 1, _SEPARATOR, np.int64)
    seq[place], seq[-1] = ids[at] + _FIRST, 0
    word = np.zeros(len(seq), np.int64)
    word[place] = at
    index = FMIndex(seq, len(phrases.vocabulary) + _FIRST)
    for rows, ends, items in phrases.by_length:
        which, lo, hi = index.search(rows)
        count = hi - lo
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        start = word[index.locate(where)]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + rows.shape[1], -1)
        pairs = np.unique(np.stack([np.searchsorted(off, start, "right") - 1, np.repeat(which, count)], 1), axis=0)
        for d, p in pairs.tolist():
            found[d].update(phrases.names[i] for i in items[ends[p]:ends[p + 1]])
    return (np.cumsum(edge[:n]) > 0).astype(np.int64), found


def _searcher(phrases_bc, column: str, out: str, prior: bool, shard_bytes: int):
    def judge(shard: list[pa.RecordBatch]):
        batch = pa.concat_batches(shard) if len(shard) > 1 else shard[0]
        flat, off = words_of(text_of(batch, column))
        cover, found = _shard_hits(flat, off, phrases_bc.value)
        if prior:
            old = batch.column(out).to_pylist()
            for d, r in enumerate(old):
                for a, b in zip(r["starts"], r["ends"]):
                    cover[off[d] + a:off[d] + b] = 1
                found[d].update(r["items"])
            batch = batch.drop_columns([out])
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        first = np.zeros(len(flat) + 1, bool)
        first[off] = True
        left = np.concatenate([[0], cover[:-1]]) if len(cover) else cover
        right = np.concatenate([cover[1:], [0]]) if len(cover) else cover
        begin = np.flatnonzero((cover == 1) & ((left == 0) | first[:-1]))
        end = np.flatnonzero((cover == 1) & ((right == 0) | first[1:])) + 1
        spans = np.bincount(doc[begin], minlength=len(off) - 1)
        list_off = pa.array(np.concatenate([[0], np.cumsum(spans)]).astype(np.int32))
        hits = pa.StructArray.from_arrays([
            pa.array(np.diff(off), pa.int64()),
            pa.ListArray.from_arrays(list_off, pa.array(begin - off[doc[begin]], pa.int64())),
            pa.ListArray.from_arrays(list_off, pa.array(end - off[doc[begin]], pa.int64())),
            pa.array([sorted(x) for x in found], pa.list_(pa.string())),
        ], names=HIT.names)
        return pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, out])

    def run(batches):
        shard, size = [], 0
        for b in blocks(batches, column):
            shard.append(b)
            size += b.column(column).nbytes
            if size >= shard_bytes:
                yield judge(shard)
                shard, size = [], 0
        if shard:
            yield judge(shard)
    return run


def mark(docs: DataFrame, benchmark: DataFrame, out: str = "hit", window: int = 13, text: str = "text",
         item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20,
         shard_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with a struct column ``out``: its number of words, the merged
    spans of words inside occurrences (``starts``, ``ends``, in words), and the
    ids of the items that occur, sorted as strings.  ``out`` must be new."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).dropDuplicates()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n_blocks = size // block_bytes + 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, HIT)])
    for k in range(n_blocks):
        block = [tuple(r) for r in items.where(part == k).collect()]
        phrases = spark.sparkContext.broadcast(Phrases(block, window))
        docs = docs.mapInArrow(_searcher(phrases, text, out, k > 0, shard_bytes), schema)
    return docs


def report(docs: DataFrame, benchmark: DataFrame, min_share: int = 20, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and
    contaminated (some hit, and ``min_share`` * n_hit >= n_words)."""
    marked = mark(docs.select("doc_id", "text"), benchmark, "hit", **options)
    n_hit = F.aggregate(F.zip_with("hit.starts", "hit.ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return (marked.select("doc_id", F.col("hit.n_words").alias("n_words"), n_hit.alias("n_hit"),
                          F.size("hit.items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("hit.items", ","), 256).alias("items_sha256"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_share: int = 20, **options) -> DataFrame:
    """The documents that are not contaminated, all columns as they were."""
    hit, = fresh(docs, "hit")
    marked = mark(docs, benchmark, hit, **options)
    n_hit = F.aggregate(F.zip_with(F.col(hit).starts, F.col(hit).ends, lambda a, b: b - a), F.lit(0).cast("long"),
                        lambda x, y: x + y)
    return marked.where((n_hit == 0) | (min_share * n_hit < F.col(hit).n_words)).drop(hit)
