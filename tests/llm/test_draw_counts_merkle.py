import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF001
from pyspark.sql import functions as F
from test_rules_lines import odd_docs
from tidemail.llm import importance, merkle, queries, token_counts
from tokenizers import Tokenizer

PIECE = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


# ---------------------------------------------------------------- importance

def runs(text):
    w = brute.ITEM_WORD.findall(brute.lower(text or ""))
    return len(w), [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def buckets_of(text):
    return Counter(zlib.crc32(x.encode()) % 10000 for x in runs(text)[1])


def brute_draw(docs, target):
    """(doc_id, n_features, weight, score, rank) as the contract says."""
    s, t = sum((buckets_of(x) for _, x in docs), Counter()), sum((buckets_of(x) for x in target), Counter())
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text in docs:
        n_words, found = runs(text)
        weight = sum(gain[b] * n for b, n in buckets_of(text).items())
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([n_words, doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((r for r in out if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    rank = {id(r): i + 1 for i, r in enumerate(can[:5 * len(can) // 100])}
    return sorted((tuple(r[1:]) + (rank.get(id(r)),) for r in out), key=str)


def test_crc_of_runs():
    r = random.Random(1)
    shift = importance.Shift()
    for size in (0, 1, 5, 255, 256, 300, 70_000):
        a, b = r.randbytes(9), r.randbytes(size)
        got = shift(np.array([zlib.crc32(a)], np.uint32), np.array([size])) ^ np.uint32(zlib.crc32(b))
        assert got[0] == zlib.crc32(a + b)


@pytest.mark.parametrize("words", [7, 1 << 18])
def test_bucket_counts_over_any_slices(monkeypatch, words):
    monkeypatch.setattr(importance, "GROUP_WORDS", words)
    texts = ["", "one", "One two", "one two three one two three", "é漢字 9-9 x_y [Z]", " ", "a " * 300, "Ä b c" + "q" * 700 + " r"]
    seen = 0
    for first, n_words, counts in importance.bucket_counts(pa.array(texts)):
        for i, (n, c) in enumerate(zip(n_words, counts), first):
            want = buckets_of(texts[i])
            assert n == runs(texts[i])[0] and {int(b): int(c[b]) for b in np.flatnonzero(c)} == dict(want), texts[i]
            seen += 1
    assert seen == len(texts)


def test_bit_planes_are_exact():
    r = np.random.default_rng(3)
    gain = r.integers(-40_000, 40_000, 10_000)
    counts = r.integers(0, 3, (6, 10_000))
    counts[2] = 0
    counts[4, :50] = 1 << 20
    assert importance.weights(counts, importance.gain_planes(gain)).tolist() == (counts @ gain).tolist()
    assert importance.weights(counts, importance.gain_planes(np.zeros(10_000, np.int64))).tolist() == [0] * 6


def test_importance_matches_brute_force(spark):
    extra = tuple(" ".join(random.Random(i).choices(["cat", "dog", "Ox", "emu", "yak"], k=25)) for i in range(30))
    for docs, target in ((odd_docs(spark, extra), spark.createDataFrame([("the of cat dog",), (None,), ("emu 9 yak",)], "text string")),
                         (documents(spark), spark.read.parquet(f"{SF001}/benchmark.parquet"))):
        got = sorted((tuple(r) for r in importance.report(docs, target).collect()), key=str)
        want = brute_draw([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
        assert got == want and any(r[-1] for r in got)


def test_importance_edges(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "text string")
    assert importance.report(docs.limit(0), none).count() == 0
    got = sorted((tuple(r) for r in importance.report(docs, none).collect()), key=str)
    assert got == brute_draw([(r.doc_id, r.text) for r in docs.collect()], [])


def test_draw_ties_hot_ids_and_any_accuracy(spark):
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, 20, 3, i % 4, 100 + i % 2) for i in range(900)] + [(1, 19, 3, 9, 9999)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    results = []
    for accuracy, parts in ((10_000, 1), (5, 7)):
        out = importance.draw(scored.repartition(parts), accuracy=accuracy).collect()
        assert len(out) == 901 and all(r["rank"] is None for r in out if r.n_words < 20)
        ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, 46))
        results.append([(r.doc_id, r.weight, r.score) for r in ranked])
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))[:45]
    assert results[0] == results[1] == [(r[0], r[3], r[4]) for r in order]


# -------------------------------------------------------------- token counts

def texts_to_count():
    r = random.Random(4)
    parts = ["a", "The", " ", "  ", "   ", "\n", "\t", "é", "漢", "<s>", "</s>", "<unk>", "▁", " ▁", "▁ ", "ﬁ", "0", "--------", "x" * 30, "\x00", "　"]
    return ["", " ", "  ", "\n", "▁", "a", "  a b ", "<0x0A>", "word " * 3000, "x" * 20_000, " " * 9000, "\n" * 9000, "né " * 4000,
            *["".join(r.choices(parts, k=r.randint(1, 300))) for _ in range(300)]]


@pytest.mark.parametrize("cut", [1, 3, 40, 4096])
def test_parts_add_up_to_the_whole(cut):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    count = token_counts.PieceCounter(PIECE, cut)
    assert " " not in count.alone and "\n" in count.alone and "a" not in count.alone
    texts = texts_to_count()
    for batch_bytes in (50, 1 << 20):
        got = token_counts.count_texts(count, pa.array(texts), batch_bytes).tolist()
        assert got == [len(library.encode(t)) for t in texts]
    long = [p for p, _ in count.parts("word " * 3000)]
    assert max(map(len, long)) <= cut + 5 and len(long) >= 15_000 // (cut + 5)


def test_token_counts_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    docs = odd_docs(spark, tuple(texts_to_count()))
    got = sorted((tuple(r) for r in token_counts.report(docs, PIECE).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "")), n > 4096) for r in docs.collect()]
    assert got == sorted(want, key=str) and any(r[3] for r in got)
    assert token_counts.report(docs.limit(0), PIECE).count() == 0
    table = documents(spark)
    got = {r.doc_id: r.n_tokens for r in token_counts.report(table, PIECE).collect()}
    assert got == {r.doc_id: len(library.encode(r.text)) for r in table.collect()}


def test_token_counts_of_the_other_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = odd_docs(spark).withColumnRenamed("doc_id", "id").withColumnRenamed("text", "body")
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, path, "id", "body").collect()), key=str)
    want = [(r.id, len((r.body or "").encode()), len(library.encode(r.body or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert got == sorted(want, key=str)


# -------------------------------------------------------------------- Merkle

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes):
    """Root and each node's siblings, level by level."""
    proofs, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a:a + 8]
            for j, mine in enumerate(under[a:a + 8]):
                for i in mine:
                    proofs[i].append((j, run[:j] + run[j + 1:]))
            up.append(sha("".join(run)))
            over.append([i for mine in under[a:a + 8] for i in mine])
        nodes, under = up, over
    return nodes[0], proofs


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        trees[k] = brute_tree([brute_leaf(r) for r in by[k]])
    root, tops = brute_tree([trees[k][0] for k in keys])
    out = []
    for k, top in zip(keys, tops):
        for r, levels in zip(by[k], trees[k][1]):
            path = levels + top
            fields = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                fields[4] = brute.lower(r[4])
            node = brute_leaf(fields)
            for j, others in path:
                node = sha("".join(others[:j] + [node] + others[j:]))
            out.append((r[0], brute_leaf(r), trees[k][0], root, sha("".join(x for _, o in path for x in o)), node, node == root))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def merkle_rows(n, seed=5):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "", "s", "é"]), r.choice(["en", "en", "en", None, "de", "", "Z", "é"]), r.choice([None, 7, -3]),
             r.choice([None, "", "Plain Text", "lower", "Ünï A"])) for i in range(n)]
    return rows + rows[:3] + [(None, None, "en", None, "A"), (None, None, "en", None, "A"), (None, None, None, None, None), (3, "x", "en", 1, "B"),
                              (4, "s", "one", 1, "Alone")]


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_merkle_matches_brute_force(spark, levels):
    rows = merkle_rows(700)
    docs = spark.createDataFrame(rows, FIELDS).withColumn("key", F.lit("clash")).withColumn("__at", F.lit(1))
    want = brute_manifest(rows)
    for parts in (1, 5):
        got = sorted((tuple(r) for r in merkle.report(docs.repartition(parts), levels).collect()), key=str)
        assert got == want
    assert any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_merkle_of_the_table_and_of_none(spark):
    docs = documents(spark)
    got = sorted((tuple(r) for r in merkle.report(docs).collect()), key=str)
    assert got == brute_manifest([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert merkle.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 513])
def test_appender_witnesses_grow_by_level(n):
    nodes = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(n)]
    tree, closed = merkle.Appender(), 0
    for i, node in enumerate(nodes):
        tree.append(node)
        # a leaf's witness is complete as far as its subtrees are
        level = 0
        while (i + 1) % 8 ** (level + 1) == 0:
            level += 1
            top = merkle.fold(nodes[i], tree.witness(i, level))
            assert tree.levels[level][-1] == top == merkle.fold(nodes[i - 7], tree.witness(i - 7, level))
            closed += 1
    root = tree.close(merkle.height(n))
    want, proofs = brute_tree([x.hex() for x in nodes])
    assert root.hex() == want
    for i in range(n):
        w = tree.witness(i, merkle.height(n))
        assert merkle.fold(nodes[i], w) == root
        assert [(p, [d.hex() for d in s]) for p, s in merkle.steps(w)] == proofs[i]


def test_manifest_returns_witnesses(spark):
    rows = merkle_rows(90)
    docs = spark.createDataFrame(rows, FIELDS)
    leaves = docs.select(F.col("lang").alias("key"), "doc_id", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("digest"), F.lit(b"").alias("item"))
    found, root = merkle.manifest(leaves, 1)
    found = found.collect()
    assert len(found) == len(rows) and all(merkle.fold(bytes(r.digest), bytes(r.witness)) == root for r in found)
    places = defaultdict(list)
    for r in found:
        places[r.key].append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_queries_are_registered():
    assert {"op11_importance", "op12_token_counts", "op13_merkle"} <= set(queries.QUERIES)
