"""Text classifier over pooled piece embeddings, trained in mini-batches (L1, L2).

The settings are those of the reference's fine-tuning: epochs, batch size,
learning rate, weight decay.  A text is the sum of its pieces' vectors over the root
of their number; a linear layer gives the classes.  Training is data-parallel with parameter averaging:

* examples (piece ids and label) are written once, each with a shard that its
  key and text decide;
* in an epoch every shard's task starts from the parameters of the epoch before,
  goes through its examples in an order drawn from seed, epoch and key, and returns
  its parameters in blocks;
* Spark averages the blocks, weighted by examples.

Neither shards nor orders depend on the partitioning of the input, so neither
does the model.  An epoch is an ordinary job: a lost task is run again by itself.
The driver holds one set of parameters (pieces x dimensions), never examples.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.functions.rand import draw_bits, hash_hex
from tidemail.operators.pieces import Pieces, encode_pieces, list_runs
from tidemail.session import scratch_path

#: Values of a block of parameters.
BLOCK = 1 << 14


@dataclass(frozen=True)
class EmbedParams:
    """A shard holds about ``shard_rows`` examples, since averaging many models of
    few batches each learns little; ``most_shards`` bounds the tasks of an epoch,
    beyond it shards grow."""
    dim: int = 32
    epochs: int = 3
    batch: int = 16
    rate: float = 0.02
    weight_decay: float = 0.01
    max_len: int = 256
    shard_rows: int = 4096
    most_shards: int = 1024
    seed: int = 42


@dataclass
class EmbeddingModel:
    pieces: Pieces
    labels: list[int]
    vectors: np.ndarray          # ids x dim; ids 0 and 1 are padding and unknown
    weights: np.ndarray          # dim x classes
    bias: np.ndarray
    max_len: int

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.vectors, self.weights, self.bias)])

    def fill(self, values: np.ndarray) -> None:
        at = 0
        for name in ("vectors", "weights", "bias"):
            a = getattr(self, name)
            setattr(self, name, values[at:at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size

    def probabilities(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Class probabilities of texts with ``n`` ids each."""
        return _softmax(_pooled(self.vectors, ids, n) @ self.weights + self.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pooled(vectors: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of each text's vectors over the root of their number (zero for a text
    without ids): a few telling pieces of a long text still count."""
    out = np.zeros((len(n), vectors.shape[1]), np.float32)
    has = n > 0
    if has.any():
        out[has] = np.add.reduceat(vectors[ids], (np.cumsum(n) - n)[has], axis=0) / np.sqrt(n[has, None])
    return out


class Adam:
    """Steps with decoupled weight decay; rows of the vectors are touched only
    by the batches that hold them."""

    def __init__(self, shape: tuple, rate: float, decay: float):
        self.m, self.v = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        self.rate, self.decay, self.t = rate, decay, 0

    def step(self, a: np.ndarray, g: np.ndarray, rows=slice(None)) -> None:
        self.t += 1
        self.m[rows] = m = 0.9 * self.m[rows] + 0.1 * g
        self.v[rows] = v = 0.999 * self.v[rows] + 0.001 * g * g
        m, v = m / (1 - 0.9 ** self.t), v / (1 - 0.999 ** self.t)
        a[rows] -= self.rate * (m / (np.sqrt(v) + 1e-8) + self.decay * a[rows])


class Trainer:
    def __init__(self, model: EmbeddingModel, params: EmbedParams):
        self.model = model
        self.steps = [Adam(a.shape, params.rate, params.weight_decay) for a in (model.vectors, model.weights, model.bias)]

    def batch(self, ids: np.ndarray, n: np.ndarray, y: np.ndarray) -> None:
        """One step on texts (``n`` ids each) of the classes ``y``."""
        model = self.model
        h = _pooled(model.vectors, ids, n)
        g = _softmax(h @ model.weights + model.bias)
        g[np.arange(len(y)), y] -= 1
        g /= len(y)
        back = g @ model.weights.T
        if len(ids):
            order = np.argsort(ids, kind="stable")
            held = ids[order]
            first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
            each = np.repeat(back / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
            self.steps[0].step(model.vectors, np.add.reduceat(each[order], first, axis=0), held[first])
        self.steps[1].step(model.weights, h.T @ g)
        self.steps[2].step(model.bias, g.sum(axis=0))


def _batches(batches, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, ids a text, class) of ``size`` texts at a time, whatever the Arrow
    batches."""
    ids, n, y = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        lists = b.column("ids")
        n = np.concatenate([n, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
        ids = np.concatenate([ids, lists.flatten().to_numpy(zero_copy_only=False)])
        y = np.concatenate([y, b.column("y").to_numpy(zero_copy_only=False)])
        while len(n) >= size:
            cut = int(n[:size].sum())
            yield ids[:cut], n[:size], y[:size]
            ids, n, y = ids[cut:], n[size:], y[size:]
    if len(n):
        yield ids, n, y


def _epoch(sent, params: EmbedParams):
    def run(batches):
        model = sent.value
        model = EmbeddingModel(None, model.labels, model.vectors.copy(), model.weights.copy(), model.bias.copy(), model.max_len)
        trainer, seen = Trainer(model, params), 0
        for ids, n, y in _batches(batches, params.batch):
            trainer.batch(ids, n, y)
            seen += len(n)
        if seen:
            from pyspark import TaskContext
            flat = model.flat()
            at = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in at], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(at), pa.int32()),
                                              pa.array([seen] * len(at), pa.int64()), pa.array([flat[a:a + BLOCK].tobytes() for a in at], pa.binary())],
                                             names=["block", "shard", "n", "held"])
    return run


def _mean_block(table: pa.Table) -> pa.Table:
    """One block of all shards, averaged by examples in the order of the shards."""
    table = table.sort_by("shard")
    n = table.column("n").to_numpy().astype(np.float64)
    total = sum(w * np.frombuffer(h, np.float32) for w, h in zip(n, table.column("held").to_pylist()))
    return pa.table({"block": table.column("block")[:1], "held": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})


def train_embedding(df: DataFrame, key: str, pieces: Pieces, params: EmbedParams | None = None, text_col: str = "text",
                    label_col: str = "label") -> EmbeddingModel:
    """L1: fit on the labelled rows (others are ignored); labels are whole numbers."""
    p = params or EmbedParams()
    spark = df.sparkSession
    given = df.filter(F.col(label_col).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(label_col).cast("int").alias("label"),
                                                            F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in given.groupBy("label").count().collect()}
    if not counts:
        raise ValueError("no labelled rows to train on")
    labels = sorted(counts)
    shards = min(p.most_shards, -(-sum(counts.values()) // p.shard_rows))
    # rows of one key (or none) are dealt out by their text, so no key makes a shard of its own
    shard = F.pmod(draw_bits(p.seed, "shard", F.concat_ws(":", "key", F.md5("text"))), F.lit(shards)).cast("int")
    classes = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    path = scratch_path(spark, "examples")
    (encode_pieces(given.select("key", shard.alias("shard"), classes.alias("y"), "text"), pieces, "text", p.max_len)
     .write.parquet(path))
    examples = spark.read.parquet(path)
    r = np.random.default_rng(p.seed)
    model = EmbeddingModel(pieces, labels, r.normal(0, 0.1, (2 + max(pieces.ids.values(), default=0), p.dim)).astype(np.float32),
                           np.zeros((p.dim, len(labels)), np.float32), np.zeros(len(labels), np.float32), p.max_len)
    model.weights[:] = r.normal(0, 0.1, model.weights.shape)
    for epoch in range(p.epochs):
        sent = spark.sparkContext.broadcast(EmbeddingModel(None, labels, model.vectors, model.weights, model.bias, p.max_len))
        order = hash_hex(p.seed, f"epoch{epoch}", F.col("key"))
        dealt = examples.repartitionById(shards, F.col("shard")).sortWithinPartitions(order, "key", "y", "ids").select("ids", "y")
        parts = dealt.mapInArrow(_epoch(sent, p), "block int, shard int, n bigint, held binary")
        blocks = parts.groupBy("block").applyInArrow(_mean_block, "block int, held binary").collect()      # the parameters, once
        model.fill(np.concatenate([np.frombuffer(b.held, np.float32) for b in sorted(blocks, key=lambda b: b.block)]))
        sent.destroy()
    return model


def score_embedding(model: EmbeddingModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    """L2 + O3: adds ``label_name`` and ``score``, the probability of the
    predicted class.  Map-only; null text is scored as empty."""
    keep = df.columns
    coded = encode_pieces(df.withColumn("__text", F.col(text_col)), model.pieces, "__text", model.max_len, "__ids")
    sent = df.sparkSession.sparkContext.broadcast(EmbeddingModel(None, model.labels, model.vectors, model.weights, model.bias, model.max_len))

    def run(batches):
        # each id of a run is a vector
        for b in list_runs(batches):
            lists = b.column(b.num_columns - 1)
            p = sent.value.probabilities(lists.flatten().to_numpy(zero_copy_only=False),
                                         pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f"LABEL_{sent.value.labels[i]}" for i in best.tolist()], pa.string()),
                                              pa.array(p[np.arange(len(p)), best].astype(np.float64))],
                                             names=[*b.schema.names[:-1], "label_name", "score"])

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("label_name", T.StringType()), T.StructField("score", T.DoubleType())])
    return coded.mapInArrow(run, schema)


def save_embedding(model: EmbeddingModel, spark: SparkSession, path: str) -> None:
    """Parameters and vocabulary as one Parquet row."""
    held = io.BytesIO()
    np.savez_compressed(held, vectors=model.vectors, weights=model.weights, bias=model.bias)
    p = model.pieces
    row = (bytearray(held.getvalue()), list(p.ids), list(p.ids.values()), p.end_mark, p.inner_mark, p.byte_level, model.labels, model.max_len)
    spark.createDataFrame([row], "held binary, piece array<string>, id array<int>, end_mark string, inner_mark string, byte_level boolean, "
                                 "labels array<int>, max_len int").coalesce(1).write.mode("overwrite").parquet(path)


def load_embedding(spark: SparkSession, path: str) -> EmbeddingModel:
    r = spark.read.parquet(path).first()
    held = np.load(io.BytesIO(bytes(r.held)))
    return EmbeddingModel(Pieces(dict(zip(r.piece, r.id)), r.end_mark, r.inner_mark, r.byte_level), list(r.labels), held["vectors"], held["weights"],
                          held["bias"], r.max_len)
