import random

import brute
import numpy as np
import pytest
from conftest import SF001, SF01
from tidemail.llm import components, decontam_fm, lang_bloom, simhash_pigeon
from test_rules_lines import odd_docs


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(1)
    for n, k in ((1, 3), (50, 3), (3000, 4), (5000, 200)):
        seq = np.concatenate([r.integers(1, k, n), [0]])
        fm = decontam_fm.FMIndex(seq, k)
        for m in (1, 2, 5):
            at = r.integers(0, max(1, n - m), 20)
            phrases = np.unique(np.concatenate([np.stack([seq[a:a + m] for a in at if a + m <= n] or [np.ones(m, int)]),
                                                r.integers(1, k, (20, m))]), axis=0)
            which, lo, hi = fm.search(phrases)
            found = {w: sorted(fm.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which.tolist(), lo, hi)}
            for i, p in enumerate(phrases):
                want = [x for x in range(n - m + 1) if (seq[x:x + m] == p).all()]
                assert found.get(i, []) == want


@pytest.mark.parametrize("shard", [1, 1 << 30])
def test_decontamination_matches_brute_force(spark, shard):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    items += [(900, None), (901, ""), (902, "the"), (903, "Of the"), (None, "a null id item"), (904, items[0][1]), (904, items[1][1])]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    odd = [(10_000 + i, r.text) for i, r in enumerate(odd_docs(spark, ("A NULL  id-item", items[0][1], items[2][1] + " " + items[2][1][:90])).collect())]
    rows = [tuple(r) for r in docs] + odd
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate(rows, items)
    for block in (1 << 24, 2000):
        got = {r.doc_id: tuple(r)[1:] for r in decontam_fm.report(df, bench, shard_bytes=shard, block_bytes=block).collect()}
        assert got == want


def test_decontamination_edges(spark):
    docs = odd_docs(spark)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam_fm.report(docs, empty).where("n_hit > 0").count() == 0
    assert decontam_fm.report(docs.limit(0), empty).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    kept = decontam_fm.drop_contaminated(docs.withColumn("hit", docs.doc), bench)
    assert kept.columns == [*docs.columns, "hit"]
    assert kept.where("text = 'a b c'").count() == 0 and kept.where("text is null").count() == 1


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    odd = odd_docs(spark).where("doc_id is not null").selectExpr("doc_id + 100000 doc_id", "text")
    rows = [tuple(r) for r in docs.union(odd).collect()]
    got = simhash_pigeon.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    prints = [(d, brute.simhash(t)) for d, t in rows]
    want = brute.near_components(prints)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", want[d]) for d, f in prints}


@pytest.mark.parametrize("distance,bucket", [(4, 8192), (4, 16), (4, 1), (3, 5), (1, 8), (0, 2)])
def test_links_equal_all_pairs(spark, distance, bucket):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(r.randint(1, 6)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    # a crowd with equal first and second segments, which only chunks can cut
    prints |= {(x << 26) | 5 for x in r.sample(range(1 << 20), 120)} | {(7 << 40) | (1 << b) | 5 for b in range(26, 40)}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {x.fp: x.component_id for x in simhash_pigeon._component_of(df, distance).collect()} if bucket == 8192 else None
    links = [(x.a, x.b) for x in simhash_pigeon.links(df.select("fp"), distance, bucket_rows=bucket, block_rows=100).collect()]
    want = brute.near_components([(i, p & (1 << 64) - 1) for i, p in rows], distance)
    if got:
        assert got == {p: want[i] for i, p in rows}
    up = {p: p for _, p in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1) != 0
        up[root(a)] = root(b)
    groups, wanted = {}, {}
    for i, p in rows:
        groups.setdefault(root(p), set()).add(i)
        wanted.setdefault(want[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_keep_first(spark):
    docs = odd_docs(spark)
    kept = simhash_pigeon.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    full = [(r.doc_id, brute.simhash(r.text)) for r in docs.collect() if r.doc_id is not None]
    want = brute.near_components(full)
    assert sorted(x for x in ids if x is not None) == sorted(set(want.values()))
    assert ids.count(None) == 1
    assert simhash_pigeon.keep_first(docs.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {x.node: x.root for x in components.components(df).collect()}
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = lang_bloom.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    docs = odd_docs(spark)
    got = {r.doc_id: r for r in lang_bloom.report(docs.where("doc_id is not null")).collect()}
    assert {r.lang_pred for r in got.values()} == {"und"}
    train = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(20)] + [(i + 50, "le chat et le chien", "fr") for i in range(12)],
                                  "doc_id long, text string, lang string")
    more = spark.createDataFrame([(900, None, "en"), (901, "123 !?", "en"), (902, "", None), (903, "漢字", None), (904, "the dog", "fr"),
                                  (None, "le chien", None)], train.schema)
    out = {r.doc_id: r for r in lang_bloom.report(train.union(more)).collect()}
    assert [out[i].lang_pred for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "en", "en", "fr"]
    assert out[903].score == 0 and out[None].held_out is False
    kept = lang_bloom.keep_identified(train.union(more))
    assert {900, 901, 902, 903}.isdisjoint(r.doc_id for r in kept.collect()) and kept.columns == train.columns
    assert lang_bloom.report(train.limit(0)).count() == 0


@pytest.mark.parametrize("n_langs", [2, 6])
def test_language_is_kept_whatever_the_number_of_languages(spark, n_langs):
    import itertools
    import random
    r = random.Random(5)

    def words(letters):
        return ["".join(x) for x in itertools.product(letters, repeat=4)][:30]
    shared, own = words("aeio"), [words(x) for x in ("bcdf", "ghjk", "lmnp", "qrst", "uvwx", "yzäö")[:n_langs]]
    rows = [(100 * k + i, " ".join(r.choice(x) for _ in range(30) for x in (shared, own[k])), f"l{k}") for k in range(n_langs) for i in range(40)]
    junk = [(1000 + i, " ".join(["".join(r.choices("αβγδεζηθ", k=6)) for _ in range(40)] + shared[:4]), None) for i in range(8)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string")
    assert {r.doc_id for r in lang_bloom.keep_identified(docs).collect()} == {x[0] for x in rows}
