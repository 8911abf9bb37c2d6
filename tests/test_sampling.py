import math

import pytest
from pyspark.sql import functions as F

from tidemail.operators import sampling
from tidemail.sources.tables import table

from conftest import SF001


def test_split_independent_of_partitioning(spark):
    d = table(spark, SF001, "documents").select("doc_id")
    sets = []
    for n in (1, 4, 7):
        s = sampling.split(d.repartition(n), "doc_id", 0.2, 42)
        sets.append(sorted(r[0] for r in s.filter("split = 'test'").collect()))
    assert sets[0] == sets[1] == sets[2]
    total = d.count()
    tr = sampling.split(d, "doc_id").filter("split = 'train'").count()
    assert tr + len(sets[0]) == total
    assert sorted(r[0] for r in sampling.holdout(d, "doc_id").collect()) == sets[0]


def test_split_exact_size(spark):
    d = table(spark, SF001, "documents").select("doc_id")
    n = d.count()
    s = sampling.split_exact(d.repartition(5), "doc_id", 0.2, 42)
    assert s.filter("split = 'test'").count() == math.ceil(0.2 * n)
    assert s.count() == n


def test_row_index_matches_brute_force(spark):
    d = table(spark, SF001, "documents").select("doc_id", "source")
    got = sorted((r["index"], r["doc_id"]) for r in
                 sampling.with_row_index(d.repartition(3), ["source", "doc_id"], "index").collect())
    rows = sorted((r["source"], r["doc_id"]) for r in d.collect())
    assert got == [(i, doc) for i, (_, doc) in enumerate(rows)]


def test_shuffle_is_permutation(spark):
    d = table(spark, SF001, "documents").select("doc_id")
    s = sampling.shuffle(d, "doc_id", 7)
    pos = sorted(r[0] for r in s.select("shuffle_pos").collect())
    assert pos == list(range(d.count()))
    again = {r[0]: r[1] for r in sampling.shuffle(d.repartition(4), "doc_id", 7).collect()}
    assert {r[0]: r[1] for r in s.collect()} == again
    assert s.agg(F.corr("doc_id", "shuffle_pos")).first()[0] < 0.5
    import hashlib
    ids = [r[0] for r in d.collect()]
    brute = sorted(ids, key=lambda i: (hashlib.md5(f"7:shuffle:{i}".encode()).hexdigest(), i))
    assert [doc for doc, _ in sorted(again.items(), key=lambda kv: kv[1])] == brute


def test_shuffle_repeated_keys(spark):
    d = (table(spark, SF001, "documents").select("doc_id")
         .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))))
    s = sampling.shuffle(d, "doc_id", 3)
    pos = sorted(r[0] for r in s.select("shuffle_pos").collect())
    assert pos == list(range(d.count()))


def _brute_test_ids(rows, k):
    """Brute force: the k rows with the smallest (draw, key)."""
    return sorted(rows, key=lambda r: (r[1], r[0]))[:k]


def test_split_exact_matches_brute_force(spark):
    d = table(spark, SF001, "documents").select("doc_id")
    u = sampling.split_draw(F.col("doc_id"), 42)
    rows = [(r[0], r[1]) for r in d.select("doc_id", u.alias("u")).collect()]
    for frac in (0.2, 0.5, 0.013):
        k = math.ceil(frac * len(rows))
        want = sorted(i for i, _ in _brute_test_ids(rows, k))
        for direct in (sampling.RANK_DIRECT, 0):     # 0: all three counting passes
            got = sampling.split_exact(d.repartition(3), "doc_id", frac, 42, rank_direct=direct)
            assert sorted(r[0] for r in got.filter("split = 'test'").collect()) == want
            assert got.count() == len(rows)


def test_split_exact_repeated_keys_and_edges(spark):
    # every key three times with different payloads: ties inside one draw value
    base = table(spark, SF001, "documents").select("doc_id")
    d = base.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n = d.count()
    s = sampling.split_exact(d, "doc_id", 0.3, 42, rank_direct=0)
    test = s.filter("split = 'test'")
    assert test.count() == math.ceil(0.3 * n) and s.count() == n
    u = sampling.split_draw(F.col("doc_id"), 42)
    hi_test = test.agg(F.max(u)).first()[0]
    lo_train = s.filter("split = 'train'").agg(F.min(u)).first()[0]
    assert hi_test <= lo_train
    assert s.filter("split = 'test'").dropDuplicates(["doc_id", "copy"]).count() == test.count()
    assert s.filter("split = 'test'").count() + s.filter("split = 'train'").count() == n
    none = sampling.split_exact(base, "doc_id", 0.0, 42)
    assert none.filter("split = 'test'").count() == 0 and none.count() == base.count()
    every = sampling.split_exact(base, "doc_id", 1.0, 42)
    assert every.filter("split = 'train'").count() == 0


def test_shuffle_splits_a_hot_key(spark):
    # a third of the rows share one key (and a few null keys): with a small
    # heavy-bucket threshold those rows are numbered in row-hash sub-ranges
    import hashlib
    base = table(spark, SF001, "documents").select("doc_id", "source")
    n = base.count()
    hot = base.select(F.lit(7).cast("long").alias("doc_id"), "source",
                      F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).limit(n // 2)
    nulls = base.limit(5).select(F.lit(None).cast("long").alias("doc_id"), "source",
                                 F.lit(9).alias("copy"))
    d = base.withColumn("copy", F.lit(-1)).unionByName(hot).unionByName(nulls)
    total = d.count()
    for threshold in (sampling.HEAVY_BUCKET, 20):
        s = sampling.shuffle(d, "doc_id", 5, heavy_bucket=threshold)
        rows = s.collect()
        assert sorted(r["shuffle_pos"] for r in rows) == list(range(total))
        # order: hash of the key, then the key; copies of a key are contiguous
        def hkey(r):
            k = "" if r["doc_id"] is None else str(r["doc_id"])
            prefix = "5:shuffle" + (":" + k if k else "")
            return (hashlib.md5(prefix.encode()).hexdigest(), r["doc_id"] is not None, r["doc_id"] or 0)
        by_pos = sorted(rows, key=lambda r: r["shuffle_pos"])
        keys = [hkey(r) for r in by_pos]
        assert keys == sorted(keys)


@pytest.mark.parametrize("payload", [False, True])
def test_split_exact_hot_key_on_the_boundary(spark, payload):
    # one key holds a third of the rows and the k-th row falls inside it;
    # without a payload its copies are identical in every column
    base = table(spark, SF001, "documents").select("doc_id")
    n0 = base.count()
    hot = base.select(F.lit(123456).cast("long").alias("doc_id"),
                      (F.col("doc_id") if payload else F.lit(0).cast("long")).alias("p"))
    d = base.withColumn("p", F.lit(-1).cast("long")).unionByName(hot).repartition(4)
    n = n0 * 2
    u = sampling.split_draw(F.col("doc_id"), 42)
    u_hot = d.filter("doc_id = 123456").select(u).first()[0]
    below = d.filter(u < u_hot).count()
    k = below + n0 // 2
    frac = (k - 0.5) / n
    for direct in (sampling.RANK_DIRECT, 3):
        s = sampling.split_exact(d, "doc_id", frac, 42, rank_direct=direct)
        rows = s.withColumn("u", u).collect()
        assert len(rows) == n
        assert sum(r["split"] == "test" for r in rows) == k
        assert all(r["split"] == "test" for r in rows if r["u"] < u_hot)
        assert all(r["split"] == "train" for r in rows if r["u"] > u_hot)
        assert sum(r["split"] == "test" for r in rows if r["u"] == u_hot) == n0 // 2


def test_row_index_spreads_a_repeated_order_key(spark):
    # ordering by `source` alone: every source value repeats many times
    d = table(spark, SF001, "documents").select("doc_id", "source")
    out = sampling.with_row_index(d, ["source"], "index", num_partitions=6)
    rows = out.collect()
    assert sorted(r["index"] for r in rows) == list(range(len(rows)))
    by_index = [r["source"] for r in sorted(rows, key=lambda r: r["index"])]
    assert by_index == sorted(by_index)
    per_part = out.groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in per_part) < len(rows)
