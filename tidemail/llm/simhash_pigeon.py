"""SimHash near-duplicates with pigeonring candidate filtering.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles.  Fingerprints link at ``distance`` (4) or fewer differing bits.

The 64 bits are cut into ``distance + 1`` segments on a ring.  By the
pigeonring principle two fingerprints within the distance have a segment from
which every chain of l consecutive segments differs in at most
l * distance / segments bits (0, 1, 2, 3, 4).  So a pair is met under its
chain's first segment, which is equal; the second, at most one bit apart, is
probed by its 14 values in sorted order; longer chains are counted before the
full Hamming check.

Copies meet as one distinct fingerprint.  A bucket of more than
``bucket_rows`` fingerprints is cut by its rows' second segments, and what stays
large after that into chunks, of which each pair goes to a task of its own;
every task returns a spanning forest of its links, never all pairs.  Components come from alternating star contraction.

Defined results: a text of fewer words than the shingle length is one shingle;
null or wordless text has fingerprint zero and links like any other; rows with
a null doc_id belong to components but never name one (a component of null
ids only has a null id); repeated rows are kept.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.llm.common import blocks, fresh, split_words, text_of, written
from tidemail.llm.components import components

SEED = 42
#: Text handled at once, in bytes: its words and their places take some 15 times that.
_BLOCK = 1 << 20
#: Shingles joined and hashed at once; each is an object of some 100 bytes.
_RUN = 1 << 16


def _shingle_hashes(flat: pa.StringArray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, and each text's number of them.  Shingles
    are joined in runs of ``_RUN``, however long a text."""
    n_words = np.diff(off)
    full = n_words >= size
    count = np.where(full, n_words - size + 1, (n_words > 0).astype(np.int64))
    flat = flat.cast(pa.binary())
    hashes = np.zeros(int(count.sum()), np.uint64)
    short = np.repeat(~full, count)
    at = np.flatnonzero(~short)
    start = (np.repeat(off[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(hashes)))[at]
    sep = pa.scalar(b" ", pa.binary())
    for i in range(0, len(at), _RUN):
        first, last = start[i], start[min(i + _RUN, len(at)) - 1]          # ascending
        whole = pc.binary_join_element_wise(*(flat.slice(first + j, last - first + 1) for j in range(size)), sep)
        keys = whole.take(pa.array(start[i:i + _RUN] - first)).to_numpy(zero_copy_only=False)
        hashes[at[i:i + _RUN]] = np.fromiter(map(xxhash.xxh64_intdigest, keys, repeat(SEED)), np.uint64, len(keys))
    if short.any():
        words = (b" ".join(flat.slice(a, b - a).to_pylist()) for a, b in zip(off, off[1:]) if 0 < b - a < size)
        hashes[short] = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, int(short.sum()))
    return hashes, count


def _majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text, bits set in over half its hashes."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        ends = np.cumsum(count)
        weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
        ones = np.zeros((len(full), 64), np.int64)
        for k, d in enumerate(full):
            for a in range(ends[d] - count[d], ends[d], 1 << 16):
                part = hashes[a:min(a + (1 << 16), ends[d])]
                bits = np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
                ones[k] += bits.sum(0, dtype=np.uint32)
        out[full] = ((2 * ones > count[full][:, None]) * weight).sum(1, dtype=np.uint64)
    return out


def _fingerprinter(text: str, fp: str, shingle: int):
    def run(batches):
        for b in blocks(batches, text, _BLOCK):
            flat, off = split_words(pc.ascii_lower(text_of(b, text)))
            prints = _majority(*_shingle_hashes(flat, off, shingle)).view(np.int64)
            b = b.drop_columns([text])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints)], names=[*b.schema.names, fp])
    return run


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp (the 64 bits as a signed long) of every row."""
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("fp", T.LongType())])
    return docs.select(*keep, "text").mapInArrow(_fingerprinter("text", "fp", shingle), schema)


# ------------------------------------------------------------------- links

def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, bits) of the ring's segments."""
    m = distance + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _link_buckets(rows: np.ndarray, fp: np.ndarray, side: np.ndarray, bucket: np.ndarray, ring: np.ndarray,
                  distance: int, max_pairs: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of whole buckets as a forest: (fp, smaller fp).

    ``ring`` is the number of the chain's first segment; ``side`` is 2 where a
    group is not cut, else 0 or 1, and rows of the same side of a cut group are
    compared in another task; 3 more marks a guest, and guests are compared
    where one of the two is at home."""
    segs = _segments(distance)
    m = len(segs)
    u = fp.view(np.uint64)
    second = np.zeros(len(fp), np.int64)
    width = np.zeros(len(fp), np.int64)
    for s in range(m):
        shift, w = segs[(s + 1) % m]
        mine = ring == s
        second[mine] = ((u[mine] >> np.uint64(shift)) & np.uint64((1 << w) - 1)).astype(np.int64)
        width[mine] = w
    key = rows * (1 << 33) + second          # rows: dense bucket number
    order = np.argsort(key, kind="stable")
    key, u, side, ring, width, fps = key[order], u[order], side[order], ring[order], width[order], fp[order]
    guest, side = side >= 3, side % 3
    n = len(key)
    root = np.arange(n)
    masks = np.array([[sum(((1 << segs[(s + j) % m][1]) - 1) << segs[(s + j) % m][0] for j in range(l)) for l in range(2, m)]
                      for s in range(m)], np.uint64)
    for bit in range(-1, int(width.max(initial=0))):
        if bit < 0:
            a = np.arange(n)
            lo, hi = a + 1, np.searchsorted(key, key, "right")
        else:
            a = np.flatnonzero((width > bit) & ((key >> bit) & 1 == 0))
            lo = np.searchsorted(key, key[a] | (1 << bit), "left")
            hi = np.searchsorted(key, key[a] | (1 << bit), "right")
        total = np.concatenate([[0], np.cumsum(hi - lo)])
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, total[i] + max_pairs, "right")) - 1)
            for lo_cut in range(0, int((hi - lo)[i:j].max(initial=0)), max_pairs) if j == i + 1 else (0,):
                c = np.minimum(hi[i:j] - lo[i:j] - lo_cut, max_pairs) if j == i + 1 else hi[i:j] - lo[i:j]
                p = np.repeat(a[i:j], c)
                q = np.repeat(lo[i:j] + lo_cut - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
                ok = ((side[p] == 2) | (side[p] != side[q])) & ~(guest[p] & guest[q]) & (root[p] != root[q])
                p, q = p[ok], q[ok]
                x = u[p] ^ u[q]
                for l in range(2, m):          # chains of l segments: at most l * distance / m bits
                    ok = np.bitwise_count(x & masks[ring[p], l - 2]) <= l * distance // m
                    p, q, x = p[ok], q[ok], x[ok]
                ok = np.bitwise_count(x) <= distance
                if ok.any():
                    up = _forest(n, root[p[ok]], root[q[ok]])
                    root = up[root]
            i = j
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def _bucket_linker(distance: int, block_rows: int):
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def link(group: pa.Table):
            cols = {c: group.column(c).to_numpy().astype(np.int64) for c in ("bucket", "cut", "ring", "side", "fp")}
            new = np.concatenate([[True], (np.diff(cols["bucket"]) != 0) | (np.diff(cols["cut"]) != 0)])
            x, y = _link_buckets(np.cumsum(new), cols["fp"], cols["side"], cols["bucket"], cols["ring"], distance)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= block_rows:
                t = pa.Table.from_batches(held).combine_chunks()
                last = [t.column(c)[-1].as_py() for c in ("bucket", "cut")]
                whole = pc.or_(pc.not_equal(t.column("bucket"), last[0]), pc.not_equal(t.column("cut"), last[1]))
                done = pc.sum(whole).as_py() or 0
                if done:
                    yield link(t.slice(0, done))
                held = t.slice(done).to_batches()
                size = t.num_rows - done
        if held:
            yield link(pa.Table.from_batches(held).combine_chunks())
    return run


def links(prints: DataFrame, distance: int = 4, bucket_rows: int = 8192, block_rows: int = 200_000) -> DataFrame:
    """Links between distinct fingerprints (column fp) as a forest (a, b) with
    the same components as all pairs within the distance.

    A bucket (rows with the same first segment) of more than ``bucket_rows`` is
    cut into 2^bits groups by the top bits of the second segment, of which a
    pair differs in one bit at most: a row is at home in its own group and a
    guest in those one bit away, so it is copied 1 + bits times, however large
    the bucket.  Guests meet rows at home only."""
    spark = prints.sparkSession
    if not distance:                    # distinct fingerprints have no links
        return spark.createDataFrame([], "a long, b long")
    segs = _segments(distance)
    m = len(segs)
    widest = min(20, *(w for _, w in segs))
    ring = F.explode(F.array(*(F.struct(
        F.lit(i).alias("ring"), F.shiftright(F.shiftleft("fp", 64 - s - w), 64 - w).alias("value"),
        F.shiftleft("fp", 64 - sum(segs[(i + 1) % m])).alias("second")) for i, (s, w) in enumerate(segs))))
    rows = prints.select("fp", ring.alias("r")).select(
        "fp", F.col("r.ring").alias("ring"), F.col("r.second").alias("second"),
        (F.col("r.ring") * (1 << 14) + F.pmod(F.col("r.value"), F.lit(1 << 14))).cast("int").alias("bucket"))
    # at most one row for each of the (distance + 1) * 2^13 buckets
    heavy = (rows.groupBy("bucket").count().where(F.col("count") > bucket_rows)
             .select("bucket", F.least(F.lit(widest), F.ceil(F.log2(F.col("count") / bucket_rows))).cast("int").alias("bits")))
    rows = (rows.join(F.broadcast(heavy), "bucket", "left")
            .withColumn("home", F.expr("CASE WHEN bits IS NULL THEN 0L ELSE shiftrightunsigned(second, 64 - bits) END")))
    places = F.expr("""CASE WHEN bits IS NULL THEN array(named_struct('grp', home, 'guest', 0))
        ELSE concat(array(named_struct('grp', home, 'guest', 0)),
                    transform(sequence(0, bits - 1), j -> named_struct('grp', home ^ shiftleft(1L, j), 'guest', 1))) END""")
    rows = rows.withColumn("g", F.explode(places)).select("fp", "ring", "bucket", "bits", "g.grp", "g.guest")
    # groups that stay large (near copies of one text), guests counted, are cut into chunks, and into none where no row
    # is at home, since guests of one group meet in groups of their own; written, so that its size decides the join
    crowded = written(rows.where("bits IS NOT NULL").groupBy("bucket", "grp").agg(F.count("*").alias("n"), F.min("guest").alias("away"))
                      .where(F.col("n") > 2 * bucket_rows)
                      .select("bucket", "grp", F.when(F.col("away") == 0, F.ceil(F.col("n") / bucket_rows)).otherwise(0).cast("int").alias("chunks")),
                      "simhash-crowded")
    rows = rows.join(crowded, ["bucket", "grp"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.greatest("chunks", F.lit(1))).cast("int")
    # cut number of chunk pair (i, j), i <= j; a row of chunk c goes to all pairs with c
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        (F.least(mine, o).cast("long") * F.col("chunks") + F.greatest(mine, o)).alias("pair"),
        F.when(mine == o, 2).when(mine < o, 0).otherwise(1).alias("side")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("pair"), F.lit(2).alias("side")))
    rows = rows.withColumn("p", F.explode(F.when(F.col("chunks").isNull(), one).when(F.col("chunks") > 0, pairs))).select(
        "bucket", (F.col("grp") * (1 << 40) + F.col("p.pair")).alias("cut"), F.col("ring").cast("int").alias("ring"),
        (F.col("p.side") + 3 * F.col("guest")).cast("int").alias("side"), "fp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "bucket", "cut").sortWithinPartitions("bucket", "cut")
            .mapInArrow(_bucket_linker(distance, block_rows), "a long, b long"))


def cluster(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) per row."""
    prints = written(fingerprints(docs, shingle), "simhash")
    return prints.join(_component_of(prints, distance), "fp", "left")


def _component_of(prints: DataFrame, distance: int) -> DataFrame:
    """fp and component_id of every distinct fingerprint."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    stars = components(written(links(classes.select("fp"), distance), "simhash-links"))
    rooted = classes.join(stars.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def report(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    return cluster(docs, shingle, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One document of each component stays, all columns as they were: the one
    with the smallest doc_id; of rows that share it, the one with the smallest
    row hash; of rows equal in every column, one.  Rows without a doc_id are
    no candidates for removal and stay."""
    digest, copies = fresh(docs, "row_hash", "copies")
    hashed = docs.withColumn(digest, F.xxhash64(*(F.col(c) for c in docs.columns)))
    prints = written(fingerprints(hashed.where("doc_id is not null"), shingle, ("doc_id", digest)), "simhash")
    best = (prints.join(_component_of(prints, distance), "fp").where(F.col("doc_id") == F.col("component_id"))
            .groupBy("doc_id", digest).agg(F.count("*").alias(copies))
            .groupBy("doc_id").agg(F.min(F.struct(digest, copies)).alias("row")).select("doc_id", "row.*"))
    best = written(best, "simhash-best")
    # texts stream past the keys; only rows that come more than once are sorted
    once, more = (hashed.join(best.where(rows).select("doc_id", digest).hint("shuffle_hash"), ["doc_id", digest], "left_semi")
                  for rows in (F.col(copies) == 1, F.col(copies) > 1))
    return (once.select(*docs.columns).unionByName(more.dropDuplicates(["doc_id", digest]).select(*docs.columns))
            .unionByName(docs.where("doc_id is null")))
