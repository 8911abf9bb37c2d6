"""Bounds that hold when a third of all rows share a doc_id, have none, or are copies."""
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from tidemail.llm import common, lang_bloom, quality_classifier, simhash_pigeon, token_files
from tokenizers import Tokenizer

WORD = public_tokenizers.path("word_bpe_49k.json")


def hot_docs(spark, n=3000):
    """A third without a doc_id, a third of one doc_id (half of it one text), a third as usual."""
    def row(i):
        text = "the same words" if i % 6 == 1 else f"words {i} of a text with number {i * 7 % 1000}"
        return (None if i % 3 == 0 else -5 if i % 3 == 1 else i, text, "en" if i % 2 else "de", "s", len(text), "clash")
    return spark.createDataFrame([row(i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long, place string")


def test_samples_are_bounded(spark):
    docs = hot_docs(spark)
    got = common.sampled(docs, 3000, 100).collect()
    assert 20 < len(got) <= 200 and sum(r.doc_id is None for r in got) < 100
    copies = docs.withColumn("text", F.lit("one text")).withColumn("doc_id", F.lit(1))
    assert common.sampled(copies, 3000, 100).count() in (0, 200)
    assert common.sampled(docs, 3000, 3000).count() == 3000


def test_classifier_takes_few_rows_of_a_doc_id(spark, monkeypatch):
    docs = hot_docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(-6, 3000)], "doc_id long, quality int")
    taken = []

    def written(df, name):
        out = common.written(df, name)
        if name == "co-training":
            taken.append(Counter(r.doc_id for r in out.select("doc_id").collect()))
        return out
    monkeypatch.setattr(quality_classifier, "written", written)
    model = quality_classifier.train(docs, labels, sample_rows=200, pool_rows=200)
    assert len(taken) == 1 and taken[0][-5] < 40 and 50 < sum(taken[0].values()) < 800
    out = quality_classifier.score(docs, model)
    assert out.count() == 3000 and out.where(F.col("score").isNull() | F.isnan("score")).count() == 0


def test_language_of_few_rows_has_a_filter(spark):
    rows = [(i, "plain english words here and there", "en") for i in range(3000)] + [(None, "qxzw vvkj zzqy xxwk", "xx")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = lang_bloom.train(docs, max_rows=50, each_rows=20)
    assert filters.langs == ["en", "xx"]
    pred = lang_bloom.predict(spark.createDataFrame([(1, "zzqy qxzw"), (2, "english words"), (3, None)], "doc_id long, text string"), filters)
    assert {r.doc_id: r.lang_pred for r in pred.collect()} == {1: "xx", 2: "en", 3: "und"}


def test_token_files_spread_hot_ids_and_read_one(spark):
    docs = hot_docs(spark, 600)
    folder = token_files.write_files(docs, WORD, block_bytes=400)
    held = token_files.files(spark, folder).collect()
    per_part = Counter()
    dictionary = token_files._dictionary(spark, folder)
    for r in held:
        f = token_files.TokenFile(bytes(r.file), dictionary)
        per_part[r.part] += len(f.doc_ids)
        assert r.with_null == (None in f.doc_ids)
    assert sum(per_part.values()) == 600 and max(per_part.values()) < 200
    ends = sorted((r.base, r.base + r.n_tokens) for r in held)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    library = Tokenizer.from_file(WORD)
    for doc_id in (5, -5, None, 12345):
        want = sorted([*library.encode(r.text, add_special_tokens=False).ids, 1] for r in docs.collect() if r.doc_id == doc_id)
        assert sorted(x.tolist() for x in token_files.read_one(spark, folder, doc_id)) == want
    assert "SortMergeJoin" not in token_files.files(spark, folder)._jdf.queryExecution().executedPlan().toString()


def test_a_crowd_with_equal_segments_is_linked_whole(spark):
    segs = simhash_pigeon._segments(4)
    r = random.Random(4)
    (s0, w0), (s1, w1) = segs[:2]
    fixed = (r.getrandbits(w0) << s0) | (r.getrandbits(w1) << s1)
    free = ((1 << 64) - 1) & ~((((1 << w0) - 1) << s0) | (((1 << w1) - 1) << s1))
    prints = {fixed | (r.getrandbits(64) & free) for _ in range(500)}
    prints |= {p ^ (1 << r.choice(range(64))) ^ (1 << r.choice(range(64))) for p in list(prints)[:100]}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash_pigeon.links(df, 4, bucket_rows=20, block_rows=100)
    root = {x: x for x in signed}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for x in found.collect():
        root[top(x.a)] = top(x.b)
    a = np.array(prints, np.uint64)
    want = {x: x for x in signed}

    def high(x):
        while want[x] != x:
            x = want[x]
        return x
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= 4):
            want[high(signed[i])] = high(signed[i + 1 + j])
    same = lambda f: sorted(sorted(v) for v in {k: [x for x in signed if f(x) == k] for k in map(f, signed)}.values())
    assert same(top) == same(high)


def test_benchmark_windows_are_flat_arrays():
    from tidemail.llm import decontam_fm
    r = random.Random(6)
    items = [(r.choice(["a", "b", None, "c"]), " ".join(r.choice("xyz") for _ in range(r.choice([0, 1, 3, 5, 30])))) for _ in range(60)] + [("d", None)]
    phrases = decontam_fm.Phrases(items, 4)
    want = {}
    for item, text in items:
        w = (text or "").split()
        for i in range(max(1, len(w) - 3) if w else 0):
            want.setdefault(tuple(w[i:i + 4]), set()).update({item} - {None})
    words = phrases.vocabulary.to_pylist()
    got = {tuple(words[c - decontam_fm._FIRST] for c in row): {phrases.names[i] for i in items_of[ends[k]:ends[k + 1]]}
           for rows, ends, items_of in phrases.by_length for k, row in enumerate(rows.tolist())}
    assert got == want
    # a block of 4 MB stays small
    import tracemalloc
    big = [(str(i), " ".join(f"w{r.randint(0, 50_000)}" for _ in range(2000))) for i in range(330)]
    tracemalloc.start()
    decontam_fm.Phrases(big, 13)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_shingles_are_joined_in_runs(monkeypatch):
    joined = []

    class Arrow:
        def __getattr__(self, name):
            return getattr(pc, name)

        def binary_join_element_wise(self, *words):
            joined.append(len(words[0]))
            return pc.binary_join_element_wise(*words)

    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 3, 4, 5, 2, 5000, 0, 3, 17, 4)]
    monkeypatch.setattr(simhash_pigeon, "pc", Arrow())
    monkeypatch.setattr(simhash_pigeon, "_RUN", 1000, raising=False)
    got = simhash_pigeon._majority(*simhash_pigeon._shingle_hashes(*common.split_words(pa.array(texts)), 4))
    assert got.tolist() == [brute.simhash(t) for t in texts]
    assert max(joined) < 1100          # one run and the gaps between texts


def test_near_dedup_sorts_repeated_rows_only(spark):
    text = "some words of a text that comes more than once"
    rows = [(i, f"{i} {i * 7} {i * 11} a text of its own {i * 13}") for i in range(20)] + \
        [(100, text)] * 3 + [(101, text)] + [(102, "other " * 9)] * 2 + [(102, "another text of this id and its words")] + [(None, text)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = simhash_pigeon.keep_first(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    got = Counter(tuple(r) for r in kept.collect())
    want = brute.near_components([(d, brute.simhash(t)) for d, t in rows if d is not None])
    assert sorted(d for d, _ in got.elements() if d is not None) == sorted(set(want.values()))
    assert got[(100, text)] == 1 and got[(None, text)] == 2
