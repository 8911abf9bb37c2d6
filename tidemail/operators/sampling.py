"""Splits, seeded shuffle and the 0-based row index.

* :func:`split`       (M1/M3) map-only: a row is ``test`` iff its hash draw is
  below the fraction.  A pure function of (seed, key), so the same hold-out is
  re-derived from a fresh load on any partitioning.
* :func:`split_exact` (M2) exactly ``ceil(fraction * n)`` test rows: the rows
  with the smallest draws, found by counting passes over the draw's bits; no
  sort of the data.
* :func:`shuffle`     (M4) seeded permutation position: hash buckets as a
  deterministic range partition, no sampling or checkpoint; hot keys are
  numbered in row-hash sub-ranges.
* :func:`with_row_index` (O4) range-partitioned sort + per-partition offsets.
  No unpartitioned window over the data; offsets from the partition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemail.functions.rand import draw_bits, uniform
from tidemail.session import checkpoint_dir, scratch_path


def split_draw(key, seed: int = 42) -> Column:
    return uniform(seed, "split", key)


def split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42,
          col: str = "split") -> DataFrame:
    """Add ``split`` ∈ {train, test}; no shuffle, no driver round trip."""
    u = split_draw(F.col(key), seed)
    return df.withColumn(col, F.when(u < F.lit(float(test_fraction)), F.lit("test")).otherwise(F.lit("train")))


def holdout(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """M3: the test side of :func:`split`, recomputed from the key alone."""
    return df.filter(split_draw(F.col(key), seed) < F.lit(float(test_fraction)))


def with_row_index(df: DataFrame, order: list, name: str = "index",
                   num_partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` (ties broken by the listed columns).

    Plan: ``repartitionByRange`` on the order keys → sort inside partitions →
    reliable checkpoint (so every later pass sees the same ranges, also after an
    executor loss) → one count per partition → offsets by a running sum over
    those counts (one row per partition) → ``offset + position in partition``.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    # the row hash breaks ties last, so equal order keys with different rows
    # (a value holding a third of all rows) still spread over many ranges
    cols = ([F.col(c) if isinstance(c, str) else c for c in order]
            + [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])])
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    mid = "__mid"
    ranged = ranged.withColumn(mid, F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col(mid), 33)
    counts = ranged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    off_df = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # one row per partition: a proven bound for the broadcast
    out = (ranged.join(F.broadcast(off_df), pid == F.col("__pid"), "inner")
           .withColumn(name, F.col("__off") + (F.col(mid) - F.shiftleft(F.col("__pid"), 33)))
           .drop(mid, "__pid", "__off"))
    return out


# Leading hex digits of the shuffle hash that pick a row's bucket: 5 digits,
# at most 2**20 buckets, so the offset table is a proven-small broadcast
# (2**20 rows of two longs, 16 MiB).
_SHUFFLE_BUCKET_HEX = 5
# The buckets split distinct keys evenly, so a bucket above this many rows
# holds many copies of one key (or null keys).  Its rows are numbered in
# sub-ranges of (hash, key, row hash >> 48): up to 2**16 per hot key.
HEAVY_BUCKET = 1 << 24
_ROW_HASH_SHIFT = 48


def shuffle(df: DataFrame, key: str, seed: int = 42, name: str = "shuffle_pos",
            heavy_bucket: int = HEAVY_BUCKET) -> DataFrame:
    """M4: seeded permutation; ``shuffle_pos`` is the row's place in the order
    (md5(seed:shuffle:key), key); rows equal in both are ordered by a hash of
    the whole row, so only fully identical rows are interchangeable.

    No sampling and no checkpoint: the hash's leading digits are a range
    partition of the order that is a pure function of the row, so every
    recomputation (a retried task, a lost executor) sees the same buckets.
    Exact counts per bucket (map-side partials over the key column) give each
    bucket's offset by a running sum over at most 2**20 rows; rows are then
    numbered inside their bucket.  One narrow pass first checks for buckets
    above ``heavy_bucket`` rows (copies of one key); only then are those
    buckets numbered in row-hash sub-ranges, so a key holding a third of all
    rows is spread over many tasks.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("shuffle"), F.col(key).cast("string")))
    d = df.withColumn("__h", h).withColumn(
        "__b", F.conv(F.substring("__h", 1, _SHUFFLE_BUCKET_HEX), 16, 10).cast("bigint"))
    counts = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    d = d.withColumn("__rh", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    drop = ["__h", "__b", "__rh", "__rn", "__off", "__hv", "__sub", "__soff"]

    def numbered(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("__b").orderBy("__h", key, "__rh")
        # every bucket has an offset; "left" keeps the optimizer from adding a
        # not-null filter that would hash every row a second time at the scan
        return (rows.withColumn("__rn", F.row_number().over(w))
                .join(F.broadcast(offsets), "__b", "left")
                .withColumn(name, F.col("__off") + F.col("__rn") - 1))

    heavy = counts.filter(F.col("__c") > F.lit(heavy_bucket)).select("__b", F.lit(True).alias("__hv"))
    if heavy.limit(1).count() == 0:
        return numbered(d).drop(*drop)
    # at most 2**20 bucket ids: a proven bound for the broadcast
    flagged = d.join(F.broadcast(heavy), "__b", "left")
    normal = numbered(flagged.filter(F.col("__hv").isNull()))
    hot = (flagged.filter(F.col("__hv").isNotNull())
           .withColumn("__sub", F.shiftright("__rh", _ROW_HASH_SHIFT)))
    group = ["__b", "__h", key, "__sub"]
    # sub-range offsets inside each heavy bucket: the running count over its
    # sub-ranges (at most heavy-bucket-size + 2**16 rows per bucket)
    sub_counts = hot.groupBy(*group).agg(F.count(F.lit(1)).alias("__c"))
    ws = Window.partitionBy("__b").orderBy("__h", key, "__sub").rowsBetween(Window.unboundedPreceding, -1)
    sub_off = sub_counts.select(*group, F.coalesce(F.sum("__c").over(ws), F.lit(0)).alias("__soff"))
    wr = Window.partitionBy(*group).orderBy("__rh")
    r = hot.withColumn("__rn", F.row_number().over(wr)).alias("r")
    so = sub_off.alias("so")
    cond = [F.col(f"r.{c}").eqNullSafe(F.col(f"so.{c}")) for c in group]
    hot_n = (r.join(so, cond, "left").select("r.*", "so.__soff")
             .join(F.broadcast(offsets), "__b", "left")
             .withColumn(name, F.col("__off") + F.col("__soff") + F.col("__rn") - 1))
    return normal.drop(*drop).unionByName(hot_n.drop(*drop))


# Bits of the 52-bit split draw resolved by each counting pass of
# :func:`split_exact`: 16, then 16, then the last 20.  A pass groups by the
# draw's prefix, so its result has at most 2**16 rows (2**20 for the last,
# which only sees rows of one 2**-32 slice of the draw range).
_PREFIX_SHIFTS = (36, 20, 0)
# A boundary group with at most this many rows is ranked directly (one task,
# a constant bound) instead of being refined by another counting pass.
RANK_DIRECT = 100_000


# Row-hash bits resolved per counting pass inside a hot boundary group.
_ROW_HASH_SHIFTS = (48, 32, 16, 0)


def _boundary(counts: DataFrame, k: Column) -> DataFrame:
    """Rows of ``counts(__b, __c)`` whose running count crosses ``k``."""
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    c = counts.withColumn("__upto", F.sum("__c").over(w))
    return c.filter((F.col("__upto") - F.col("__c") < k) & (k <= F.col("__upto")))


def _narrow(src: DataFrame, value: str, shifts, k: int, rank_direct: int,
            prefix: int | None = None, prev: int | None = None):
    """Counting passes over the bits of the long column ``value``: the group
    ``value >> shift == prefix`` that holds the ``k``-th row (1-based) of
    ``src``.  Returns (rows before the group, prefix, shift, group size); stops
    early once the group has at most ``rank_direct`` rows."""
    before, c = 0, None
    for shift in shifts:
        inside = src if prefix is None else src.filter(F.shiftright(value, prev) == F.lit(prefix))
        cnt = inside.groupBy(F.shiftright(value, shift).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
        row = _boundary(cnt, F.lit(k - before)).select(
            "__b", "__c", (F.col("__upto") - F.col("__c")).alias("__before")).first()
        before, prefix, prev, c = before + int(row["__before"]), int(row["__b"]), shift, int(row["__c"])
        if c <= rank_direct:
            break
    return before, prefix, prev, c


def _label(test: Column, col: str):
    return {col: F.when(test, F.lit("test")).otherwise(F.lit("train"))}


def _split_hot(g: DataFrame, key: str, r: int, col: str, rank_direct: int) -> DataFrame:
    """The first ``r`` rows, in (key, row hash) order, of a boundary group whose
    rows all share one draw value (copies of a key).  No step ranks more than
    ``rank_direct`` rows or one input split in one task."""
    kc = g.groupBy(F.col(key).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    krow = _boundary(kc, F.lit(r)).select("__b", "__c", (F.col("__upto") - F.col("__c")).alias("__before")).first()
    kstar, r = krow["__b"], r - int(krow["__before"])
    kcol = F.col(key)
    same = kcol.eqNullSafe(F.lit(kstar))
    key_before = F.lit(False) if kstar is None else (kcol.isNull() | (kcol < F.lit(kstar)))
    parts = [g.filter(~same).withColumns(_label(key_before, col))]
    sub = g.filter(same)
    if int(krow["__c"]) <= rank_direct:
        w = Window.partitionBy(kcol).orderBy("__rh")
        parts.append(sub.withColumns(_label(F.row_number().over(w) <= F.lit(r), col)))
    else:
        before, pre, shift, c = _narrow(sub, "__rh", _ROW_HASH_SHIFTS, r, rank_direct)
        r -= before
        rb = F.shiftright("__rh", shift)
        parts.append(sub.filter(rb != F.lit(pre)).withColumns(_label(rb < F.lit(pre), col)))
        grp = sub.filter(rb == F.lit(pre))
        if c <= rank_direct:
            w = Window.partitionBy(rb).orderBy("__rh")
            parts.append(grp.withColumns(_label(F.row_number().over(w) <= F.lit(r), col)))
        else:
            # fully identical rows are interchangeable: take r of them, each input
            # partition giving its share in partition order (one small row per
            # partition; each window holds one input split at most)
            # written, so that the count and the ranking see the same partitions
            path = scratch_path(grp.sparkSession, "split-copies")
            grp.withColumn("__pid", F.spark_partition_id()).write.parquet(path)
            gp = grp.sparkSession.read.parquet(path)
            pc = gp.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
            wp = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
            quota = pc.select("__pid", F.least(F.greatest(F.lit(r) - F.coalesce(F.sum("__c").over(wp), F.lit(0)),
                                                          F.lit(0)), F.col("__c")).alias("__q"))
            w = Window.partitionBy("__pid").orderBy("__rh")
            parts.append(gp.join(F.broadcast(quota), "__pid")
                         .withColumns(_label(F.row_number().over(w) <= F.col("__q"), col))
                         .drop("__pid", "__q"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.drop("__rh")


def split_exact(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42,
                col: str = "split", rank_direct: int = RANK_DIRECT) -> DataFrame:
    """M2: exactly ``k = ceil(test_fraction * n)`` rows are ``test`` — those with
    the smallest (draw, key); rows equal in both are ordered by a hash of the
    whole row, so only fully identical rows are interchangeable.

    No sort of the data.  Counting passes read only the key column and find the
    group of draw prefixes that holds the k-th row: each pass groups the rows
    inside the previous pass's group by the next bits of the draw (map-side
    partial counts; at most 2**16 groups, so the running count over them is a
    bounded one-partition window) and keeps the group where the running count
    reaches k.  Refining stops once that group has at most ``rank_direct``
    rows (one pass at small scale, two at 10**12 rows).  The group is then
    labelled per (draw, key) from the key column alone, and a broadcast join of
    that small table labels every row in one pass over the data: rows below
    the group are test, rows above it train.  One row per pass reaches the
    driver.

    A key holding a third of all rows has one draw value; when it sits on the
    boundary the group is refined further by key and row-hash bits, and copies
    that are identical in every column are shared out by input partition.
    """
    d = df.withColumn("__h", draw_bits(seed, "split", F.col(key)))
    draws = d.select("__h")
    top = _PREFIX_SHIFTS[0]
    cnt = draws.groupBy(F.shiftright("__h", top).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    # the first pass also gives n, hence k
    cnt = cnt.withColumn("__k", F.ceil(F.lit(float(test_fraction)) * F.sum("__c").over(Window.partitionBy())))
    row = _boundary(cnt, F.col("__k")).select(
        "__b", "__c", (F.col("__upto") - F.col("__c")).alias("__before"), "__k").first()
    if row is None:                          # k = 0 (or no rows): everything is train
        return d.withColumns(_label(F.lit(False), col)).drop("__h")
    k, before, prefix, prev, c = (int(row["__k"]), int(row["__before"]), int(row["__b"]), top,
                                  int(row["__c"]))
    if c > rank_direct:
        more, prefix, prev, c = _narrow(draws, "__h", _PREFIX_SHIFTS[1:], k - before, rank_direct,
                                        prefix, prev)
        before += more
    r = k - before                           # rows of the boundary group that are test
    b = F.shiftright("__h", prev)
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    if c > rank_direct:                      # prev == 0: one draw value, copies of a key
        rest = d.filter(b != F.lit(prefix)).withColumns(_label(b < F.lit(prefix), col))
        group = _split_hot(d.filter(b == F.lit(prefix)).withColumn("__rh", row_hash), key, r, col, rank_direct)
        return rest.unionByName(group).drop("__h")
    # The boundary group (at most rank_direct rows) is labelled per (draw, key)
    # from the key column alone; one broadcast join then labels every row in a
    # single pass over the data.
    gc = (d.select("__h", F.col(key).alias("__k")).filter(b == F.lit(prefix))
          .groupBy("__h", "__k").agg(F.count(F.lit(1)).alias("__c")))
    wg = Window.orderBy("__h", "__k").rowsBetween(Window.unboundedPreceding, 0)
    gl = gc.withColumn("__t", F.least(F.greatest(F.lit(r) - (F.sum("__c").over(wg) - F.col("__c")), F.lit(0)),
                                      F.col("__c")))
    # only when keys repeat can one (draw, key) group fall on both sides
    cut = gl.filter((F.col("__t") > 0) & (F.col("__t") < F.col("__c"))).select("__h", "__k", "__t").first()
    lab = gl.select(F.col("__h").alias("__lh"), "__k", (F.col("__t") > 0).alias("__test"))
    j = d.join(F.broadcast(lab), (F.col("__h") == F.col("__lh")) & F.col(key).eqNullSafe(F.col("__k")), "left")
    out = j.withColumns(_label(F.when(b == F.lit(prefix), F.col("__test")).otherwise(b < F.lit(prefix)), col))
    out = out.drop("__lh", "__k", "__test")
    if cut is None:
        return out.drop("__h")
    same = (F.col("__h") == F.lit(cut["__h"])) & F.col(key).eqNullSafe(F.lit(cut["__k"]))
    w = Window.partitionBy("__h").orderBy(row_hash)
    split_group = d.filter(same).withColumns(_label(F.row_number().over(w) <= F.lit(int(cut["__t"])), col))
    return out.filter(~same).unionByName(split_group).drop("__h")
