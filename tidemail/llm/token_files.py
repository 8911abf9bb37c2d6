"""Token files: documents' ids, compressed one by one with a shared dictionary.

A zstandard dictionary is trained on the serialised id arrays of a bounded
sample of documents.  Every document is then compressed alone with it, so a
short document can be read by itself and still shares what is common.

A file (one block of documents in ascending doc_id order) is, little endian:

    magic 8 bytes, SHA-256 of the dictionary 32 bytes, bytes an id u32, number of documents n u32,
    doc_id i64[n] and null flags u8[n], number of ids u32[n], offsets u64[n + 1], frames

Files are stored as rows of a table (with their part, number and range of ids) in the shared
folder, since tasks can reach a shared store through Spark only; the dictionary
is a row of a second table.  ``read_documents`` checks a file's dictionary hash
and unpacks documents through the offset index; ``read_one`` those of one doc_id.

Ids come from the tokenizers library.  A worker encodes each distinct piece of
text once (see pieces.py); texts that hold an added token's string go to the
library whole.

Defined results: null text is empty (its only id is the end id); rows with
equal doc_id are ordered by a hash of their text; a null doc_id comes first;
repeated rows are stored each; an empty table has no files and no rows; with
too few sample documents for training, the samples themselves are the
dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemail.llm.common import blocks, lists_of, sampled, shared_dir, text_of
from tidemail.llm.pieces import IdCache, encode_texts

MAGIC = b"TIDTOK01"
_HEAD = struct.Struct("<8s32sII")
#: Rows of files: ``inside`` counts the ids of the files before it in its part.
_FILES = "part int, seq long, inside long, n_tokens long, first_id long, last_id long, with_null boolean, file binary"


class LibraryEncoder:
    """The tokenizers library over blocks of texts, distinct pieces once."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.id_bytes = 2 if len(self.ends_word) <= 1 << 16 else 4
        self.cache = IdCache(self.encode_pieces)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of letters are one word each, whatever stands beside them:
        they go to the library many at once, and the ids that end a word part
        them again."""
        bare = [p.strip(" \t\n\r\x0b\x0c") for p in pieces]
        alone = np.array([b.isalpha() for b in bare], bool)
        counts = np.zeros(len(pieces), np.int64)
        found: list[np.ndarray] = [np.zeros(0, np.int32)] * 2
        words = np.flatnonzero(alone)
        joined = [np.array(x, np.int32) for x in self._ids([" ".join(bare[i] for i in words[a:a + 2000].tolist()) for a in range(0, len(words), 2000)])]
        flat = np.concatenate([np.zeros(0, np.int32), *joined])
        ends = np.flatnonzero(self.ends_word[flat]) + 1
        if len(ends) == len(words):
            counts[words] = np.diff(np.concatenate([[0], ends]))
            found[0] = flat
        else:                                   # a normaliser that splits letters
            alone[:] = False
        rest = np.flatnonzero(~alone)
        each = self._ids([pieces[i] for i in rest.tolist()])
        counts[rest] = [len(x) for x in each]
        found[1] = np.array([i for x in each for i in x], np.int32)
        out = np.zeros(int(counts.sum()), np.int32)
        owner = np.repeat(alone, counts)
        out[owner], out[~owner] = found[0] if alone.any() else found[1][:0], found[1]
        return out, counts

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return encode_texts(texts, True, self.cache, whole, lambda t: np.array(self._ids([t])[0], np.int32))


_HELD: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One encoder a worker, kept between its tasks."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = LibraryEncoder(path)
    return _HELD[path]


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


# ---------------------------------------------------------------- the files

def pack_file(doc_ids: list, arrays: list[bytes], id_bytes: int, dictionary: bytes) -> bytes:
    packer = zstandard.ZstdCompressor(level=3, dict_data=_dict(dictionary), write_content_size=True)
    frames = [packer.compress(a) for a in arrays]
    n = len(frames)
    return b"".join([
        _HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), id_bytes, n),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(a) // id_bytes for a in arrays], "<u4").tobytes(),
        np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes(), *frames])


def _dict(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


class TokenFile:
    """Reads one file; only the documents asked for are unpacked."""

    def __init__(self, file: bytes, dictionary: bytes):
        magic, digest, self.id_bytes, n = _HEAD.unpack_from(file)
        if magic != MAGIC:
            raise ValueError("not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the file was written with another dictionary")
        at = _HEAD.size
        ids, null = np.frombuffer(file, "<i8", n, at), np.frombuffer(file, np.uint8, n, at + 8 * n)
        self.doc_ids = [None if x else d for d, x in zip(ids.tolist(), null.tolist())]
        self.n_tokens = np.frombuffer(file, "<u4", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(file, "<u8", n + 1, at + 13 * n).astype(np.int64)
        self.frames, self.base = file, at + 13 * n + 8 * (n + 1)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dict(dictionary))

    def read(self, k: int) -> np.ndarray:
        a, b = self.base + self.offsets[k], self.base + self.offsets[k + 1]
        return np.frombuffer(self.unpacker.decompress(self.frames[a:b]), f"<u{self.id_bytes}")


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample_rows: int = 2_000, size: int = 64 << 10,
                     max_chars: int = 50_000) -> bytes:
    """A dictionary from the ids of about ``sample_rows`` rows of at most
    ``max_chars`` characters, chosen by a hash of doc_id and text.  Longer texts are
    compressed with it all the same."""
    rows = sampled(docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= max_chars), docs.count(), sample_rows)

    def run(batches):
        e = encoder(path)
        for b in blocks(batches):
            ids, counts = _with_end(*e.encode(text_of(b)), end_id)
            data = ids.astype(f"<u{e.id_bytes}").tobytes()
            ends = np.cumsum(counts) * e.id_bytes
            yield pa.RecordBatch.from_arrays([pa.array([data[x - c * e.id_bytes:x] for x, c in zip(ends.tolist(), counts.tolist())], pa.binary())], names=["ids"])
    samples = sorted(bytes(r.ids) for r in rows.select("text").mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_files(docs: DataFrame, path: str, end_id: int = 1, block_bytes: int = 4 << 20, folder: str | None = None) -> str:
    """Writes the token files of all rows and returns their folder."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, path, end_id)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, dictionary binary") \
        .write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        e, part, seq, inside = encoder(path), TaskContext.get().partitionId(), 0, 0
        for b in blocks(batches, "text", block_bytes):
            ids, counts = _with_end(*e.encode(text_of(b)), end_id)
            data = ids.astype(f"<u{e.id_bytes}").tobytes()
            ends = (np.cumsum(counts) * e.id_bytes).tolist()
            arrays = [data[x - c * e.id_bytes:x] for x, c in zip(ends, counts.tolist())]
            ids_of = b.column("doc_id").to_pylist()
            file = pack_file(ids_of, arrays, e.id_bytes, shared.value)
            known = [i for i in ids_of if i is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in (
                (part, pa.int32()), (seq, pa.int64()), (inside, pa.int64()), (int(counts.sum()), pa.int64()), (known[0] if known else None, pa.int64()),
                (known[-1] if known else None, pa.int64()), (len(known) < len(ids_of), pa.bool_()), (file, pa.binary()))],
                names=[f.split()[0] for f in _FILES.split(", ")])
            seq, inside = seq + 1, inside + int(counts.sum())
    # rows of one doc_id, or of none, spread by their text, and copies of a row by their place in the table
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    (rows.repartitionByRange(n, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "text")
     .mapInArrow(run, _FILES).write.parquet(f"{folder}/files"))
    return folder


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first().dictionary)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The files with base: the number of ids in all files before."""
    table = spark.read.schema(_FILES).parquet(f"{folder}/files")
    # one row for each range partition, so the files themselves are not shuffled
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return table.join(F.broadcast(parts), "part").withColumn("base", F.col("before") + F.col("inside")).drop("before")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document."""
    shared = spark.sparkContext.broadcast(_dictionary(spark, folder))

    def run(batches):
        for b in batches:
            for file, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                f = TokenFile(file, shared.value)
                ids = [f.read(k).astype("<u4") for k in range(len(f.doc_ids))]
                cols = [pa.array(f.doc_ids, pa.int64()), pa.array(base + np.cumsum(f.n_tokens) - f.n_tokens, pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    cols.append(lists_of(np.concatenate(ids).astype(np.int32), f.n_tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files(spark, folder).select("file", "base").mapInArrow(run, schema)


def read_one(spark: SparkSession, folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the rows with this doc_id (one array a row), in the files' order.
    Only files whose range holds it are read, and only its documents unpacked."""
    table = spark.read.schema(_FILES).parquet(f"{folder}/files")
    here = F.col("with_null") if doc_id is None else (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    shared = spark.sparkContext.broadcast(_dictionary(spark, folder))

    def run(batches):
        for b in batches:
            for part, seq, file in zip(*(c.to_pylist() for c in b.columns)):
                f = TokenFile(file, shared.value)
                for k in [k for k, d in enumerate(f.doc_ids) if d == doc_id]:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([k], pa.int32()),
                                                      pa.array([f.read(k).astype("<u4").tobytes()], pa.binary())], names=["part", "seq", "k", "ids"])
    found = table.where(here).select("part", "seq", "file").mapInArrow(run, "part int, seq long, k int, ids binary")
    return [np.frombuffer(bytes(r.ids), "<u4") for r in found.orderBy("part", "seq", "k").collect()]


def report(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    return read_documents(docs.sparkSession, write_files(docs, path, end_id))
