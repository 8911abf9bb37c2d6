"""Vocabulary, encoding, padding (K1–K4, P11) and the batch-map hook.

Encoding keeps every step bounded: token arrays are sliced to ``max_len``
first, and the vocabulary is broadcast only where its counted size allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.functions.text import tokens
from tidemail.operators.sampling import with_row_index
from tidemail.session import scratch_path

# Special token ids.
PAD, UNK = 0, 1
SPECIALS = [("[PAD]", PAD), ("[UNK]", UNK)]

# A vocabulary above this many rows is joined instead of broadcast.
MAX_BROADCAST_VOCAB = 2_000_000


def token_counts(df: DataFrame, text_col: str) -> DataFrame:
    """``(token, n)`` over all texts; partial counts per map task."""
    return (df.select(F.explode(tokens(text_col)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))


def build_vocab(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """K1: the ``size`` most frequent tokens (count desc, token asc) get ids
    ``2 ..``; ids 0 and 1 are ``[PAD]`` and ``[UNK]``.

    The token counts are written once.  Their distribution (one row for each
    different count, few of them since the sum of k different counts is at least
    k^2 / 2) gives the count at the cut; tokens below it go, and the rest is
    ranked in range partitions, so no task sorts all candidates.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "token-counts")
    token_counts(df, text_col).write.parquet(path)
    counts = spark.read.parquet(path)
    above = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cut = (counts.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
           .select("n", F.coalesce(F.sum("c").over(above), F.lit(0)).alias("before"))
           .filter(F.col("before") < size).agg(F.min("n")).first()[0])
    top = counts.filter(F.col("n") >= (cut or 0)) if cut else counts.limit(0)
    words = with_row_index(top, [F.col("n").desc(), "token"], "rank").filter(F.col("rank") < size)
    specials = spark.createDataFrame([(t, i, None) for t, i in SPECIALS], "token string, token_id int, n bigint")
    return specials.unionByName(words.select("token", (F.col("rank") + 2).cast("int").alias("token_id"), "n"))


def encode(df: DataFrame, vocab: DataFrame, key: str, text_col: str, max_len: int, out: str = "ids",
           max_broadcast: int = MAX_BROADCAST_VOCAB) -> DataFrame:
    """K2: ids of the first ``max_len`` tokens of each text; unknown → ``[UNK]``.
    Texts without tokens get an empty array.  The text column is replaced by
    ``out``; all other columns stay.

    A vocabulary of at most ``max_broadcast`` rows (counted, not assumed) is
    sent to the tasks and looked up in Arrow batches, without a shuffle.  For a
    larger one the rows are written with a number each, their tokens are joined,
    and the ids are regrouped by that number.  Both give the same rows: ``key`` may be
    null or repeat."""
    rest = [c for c in df.columns if c != text_col]
    toks = df.select(*rest, F.slice(tokens(text_col), 1, max_len).alias("__toks"))
    v = vocab.filter(F.col("token_id") > UNK).select("token", "token_id")
    known = v.limit(max_broadcast + 1).toArrow()
    if known.num_rows <= max_broadcast:
        schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
        return toks.mapInArrow(_lookup(df.sparkSession.sparkContext.broadcast(known), out), schema)
    path = scratch_path(df.sparkSession, "token-rows")
    toks.withColumn("__row", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    ex = rows.select("__row", F.posexplode("__toks").alias("pos", "token"))
    item = F.struct("pos", F.coalesce("token_id", F.lit(UNK)).alias("id"))
    ids = (ex.join(v, "token", "left").groupBy("__row").agg(F.array_sort(F.collect_list(item)).alias("__s"))
           .select("__row", F.transform("__s", lambda x: x["id"]).alias(out)))
    # a row without tokens has no ids to join
    return rows.drop("__toks").join(ids, "__row", "left").select(*rest, F.coalesce(out, F.array().cast("array<int>")).alias(out))


def _lookup(known_bc, out: str):
    def run(batches):
        words, ids = (c.combine_chunks() for c in known_bc.value.columns)
        for b in batches:
            toks = b.column(b.num_columns - 1)
            size = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
            got = pc.fill_null(ids.take(pc.index_in(toks.flatten(), value_set=words)), UNK)
            off = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(off, got)],
                                             names=[*b.schema.names[:-1], out])
    return run


def pad(df: DataFrame, ids_col: str, max_len: int) -> DataFrame:
    """K3: truncate/pad to ``max_len`` with ``[PAD]`` and add the 1/0 attention mask."""
    ids = F.col(ids_col)
    return df.withColumns({
        "input_ids": F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), max_len)), 1, max_len),
        "attention_mask": F.transform(F.sequence(F.lit(1), F.lit(max_len)),
                                      lambda i: F.when(i <= F.size(ids), 1).otherwise(0)),
    })


def model_inputs(df: DataFrame) -> DataFrame:
    """Keep only ``input_ids, attention_mask, label``."""
    return df.select("input_ids", "attention_mask", "label")


def map_batches(df: DataFrame, fn, schema) -> DataFrame:
    """Apply ``fn(pandas.DataFrame) -> pandas.DataFrame`` to Arrow batches
    of every partition (``mapInPandas``); no data passes through the driver."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)
