"""Helpers shared by the operators: shared storage, column names, Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, in bytes.
BLOCK_BYTES = 6 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.  Where it is
    unset, a local session (tests) gets a folder of its own; any other master
    is an error, since executors would not see a driver's folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemail-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, its
    lineage cut, and safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def row_crc_mod(col: str, mod: int) -> Column:
    """crc32 of the column as text, modulo ``mod`` (null: -1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod)), F.lit(-1))


def sampled(docs: DataFrame, n: int, rows: int) -> DataFrame:
    """About ``rows`` of the ``n`` rows (all, if there are no more), chosen by a
    hash of doc_id and text, so that rows without a doc_id, or of one, are
    thinned like others.  Copies of one row fall together; a hard limit of twice as
    many rows holds then."""
    if n <= rows:
        return docs
    return docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(rows / n * (1 << 30))).limit(2 * rows)


# ---------------------------------------------------------------- Arrow text

def blocks(batches: Iterable[pa.RecordBatch], column: str = "text",
           max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``max_bytes`` of text (one
    long text is a run of its own)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + max_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def text_of(batch: pa.RecordBatch, column: str = "text") -> pa.StringArray:
    """A text column, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def translate(a: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    """Every byte replaced by ``table[byte]``; ``table`` must map ASCII to
    ASCII and leave other bytes as they are."""
    off = np.frombuffer(a.buffers()[1], np.int32)[a.offset:a.offset + len(a) + 1]
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(np.ascontiguousarray(off - off[0])),
                                       pa.py_buffer(table[data]))


def split_words(a: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All words of all texts (runs without ASCII white space), and the
    offsets of each text's words."""
    lists = pc.ascii_split_whitespace(a)
    off = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        off = np.concatenate([[0], np.cumsum(full)])[off]
        flat = flat.filter(pa.array(full))
    return flat, off


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Indices into the distinct values, and those values."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def lists_of(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
