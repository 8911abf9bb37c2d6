"""Merkle manifest of a data set, with a witness for every row.

A row's leaf is a digest of its fields.  Leaves of one key (a language) form a
tree in which every ``ARITY`` consecutive nodes have one parent, up to the key's
subroot; the subroots form such a tree again, up to the root.  A witness holds,
level by level, a node's siblings; leaf and witness give the root back.

Trees are built by streaming append.  ``Appender`` takes nodes in order and keeps
one open run a level.  When the run's last sibling comes, the run is kept as
the next level of the witnesses of all nodes under it, and its digest is
appended one level up: every leaf's partial witness grows by one level each time
the subtree it stands in is completed.

Appends are distributed in aligned blocks of ``ARITY ** LEVELS`` nodes of one
key.  A node's position is its place in a range partition plus the counts of the
partitions before it; a hot key is cut into blocks like any other.  A block's task
writes one row: its root, and its levels, which are the witnesses of all its
leaves so far.  Block roots are nodes of the next round, appended in the same way,
until each key has one block; its root is the subroot, and the subroots are
appended as one more tree.  On the way back each block is joined to the
witness of its own root, and its rows' witnesses are completed from it.

Digests are 32 bytes in tables; H joins them as lowercase hex text.  Nothing grows
on the driver: it learns the largest number of blocks of a key.

Defined results: null fields are ``-``; leaves ascend by doc_id, null first, equal
ids by their leaf digests (rows equal in all fields are interchangeable); the null
key comes first, others in order of their UTF-8 bytes; an empty table gives no
rows; extra columns never enter, other columns of ``fields`` may be chosen; a null
doc_id is never tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemail.llm.common import written

ARITY = 8
#: Levels a block has, so 4,096 nodes.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# -------------------------------------------------------------------- digests

def leaf(fields: list[Column]) -> Column:
    """sha256 of each field as ``<bytes>:<value>``, or ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def join(digests: list[bytes]) -> bytes:
    """H: the digest of digests, as hex text one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(n: int) -> int:
    """Levels between ``n`` nodes and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Appender:
    """Nodes appended in order.  ``levels[i]`` are the completed nodes of level
    i, ``open[i]`` the run still waiting for siblings."""

    def __init__(self):
        self.levels: list[list[bytes]] = [[]]
        self.open: list[list[bytes]] = [[]]

    def append(self, node: bytes, level: int = 0):
        if level == len(self.open):
            self.open.append([])
            self.levels.append([])
        self.levels[level].append(node)
        run = self.open[level]
        run.append(node)
        if len(run) == ARITY:                 # the last sibling: witnesses below grow by this run
            self.open[level] = []
            self.append(join(run), level + 1)

    def close(self, levels: int) -> bytes:
        """The root ``levels`` up, after open runs are closed with the siblings
        they have."""
        for level in range(levels):
            if level < len(self.open) and self.open[level]:
                run, self.open[level] = self.open[level], []
                self.append(join(run), level + 1)
        return self.levels[levels][0]

    def witness(self, i: int, levels: int) -> bytes:
        """Node i's siblings below the root: for each level its place in the
        run, the number of siblings, and these."""
        out = []
        for level in range(levels):
            at = i // ARITY ** level
            first = at - at % ARITY
            run = self.levels[level][first:first + ARITY]
            out.append(bytes([at - first, len(run) - 1]) + b"".join(run[:at - first] + run[at - first + 1:]))
        return b"".join(out)


def steps(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """A witness's levels: the place among, and the digests of, the siblings."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        yield place, [witness[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(node: bytes, witness: bytes) -> bytes:
    """The root that a node and its witness give."""
    for place, siblings in steps(witness):
        node = join(siblings[:place] + [node] + siblings[place:])
    return node


def proof(witness: bytes) -> str:
    """Hex digest of all siblings of a witness."""
    return hashlib.sha256(b"".join(d for _, s in steps(witness) for d in s).hex().encode()).hexdigest()


# ----------------------------------------------------------------- positions

def positions(nodes: DataFrame, key: str, order: list, out: str = "pos", total: str = "of") -> DataFrame:
    """``nodes`` written, with each one's place among those of its key and their
    number.  ``order`` are the columns or expressions that order a key's nodes;
    rows that agree in them must be interchangeable: they spread over the ranges by
    their place in the input, so no group of equal rows lands in one task."""
    tie = F.monotonically_increasing_id()
    # a null key is its own key: it comes first, and equality with null is true
    by = [F.col(key).asc_nulls_first(), *order, "__tie"]
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.withColumn("__tie", tie).repartitionByRange(n, *by).sortWithinPartitions(*by)
    table = written(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    runs = table.groupBy(part.alias("__part"), F.col(key).alias("__key")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__part", "__key", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
                       F.sum("__n").over(Window.partitionBy("__key")).alias(total))
    return (table.withColumn("__part2", part).join(runs, (F.col("__part2") == F.col("__part")) & F.col(key).eqNullSafe(F.col("__key")))
            .withColumn(out, F.col("__before") + F.col("__at") - F.col("__first"))
            .drop("__at", "__part", "__part2", "__key", "__first", "__before"))


# --------------------------------------------------------------------- blocks

def _append_blocks(levels: int):
    """One row a block: what its nodes appended give."""
    size = ARITY ** levels

    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches):
        for (key, block), nodes in groupby(rows(batches), key=lambda r: (r[0], r[1])):
            tree, items = Appender(), []
            for _, _, _, total, digest, item in nodes:
                tree.append(digest)
                items.append(item)
            up = height(total) if total <= size else levels
            root = tree.close(up)
            packed = b"".join(b"".join(nodes) for nodes in tree.levels[:max(up, 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], pa.string()), pa.array([block], pa.int64()), pa.array([-(-total // size)], pa.int64()), pa.array([up], pa.int32()),
                 pa.array([root], pa.binary()), pa.array([packed], pa.binary()), pa.array([items], pa.list_(pa.binary()))],
                names=["key", "block", "blocks", "up", "root", "nodes", "items"])
    return run


def _unpacked(n: int, up: int, packed: bytes) -> Appender:
    """The completed levels of a block of ``n`` nodes."""
    tree, at = Appender(), 0
    tree.levels = []
    for _ in range(max(up, 1)):
        tree.levels.append([packed[i:i + 32] for i in range(at, at + 32 * n, 32)])
        at, n = at + 32 * n, -(-n // ARITY)
    return tree


def append_blocks(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(key, pos, of, digest, item) appended in aligned blocks, one row each;
    ``item`` is what the caller keeps for each node."""
    size = ARITY ** levels
    rows = nodes.select("key", F.expr(f"pos div {size}").alias("block"), "pos", "of", "digest", "item")
    placed = rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    return written(placed.mapInArrow(_append_blocks(levels), "key string, block long, blocks long, up int, root binary, nodes binary, items array<binary>"),
                   "blocks")


def trees(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of blocks until every key has one, whose root is its subroot."""
    rounds = [append_blocks(nodes, levels)]
    while (rounds[-1].agg(F.max("blocks")).first()[0] or 1) > 1:
        last = rounds[-1].where("blocks > 1")
        rounds.append(append_blocks(last.select("key", F.col("block").alias("pos"), F.col("blocks").alias("of"), F.col("root").alias("digest"),
                                                F.lit(None).cast("binary").alias("item")), levels))
    return rounds


def subroots(rounds: list[DataFrame]) -> DataFrame:
    out = [r.where("blocks = 1").select("key", F.col("root").alias("digest")) for r in rounds]
    first = out[0]
    for r in out[1:]:
        first = first.unionByName(r)
    return first


def _complete(levels: int, finish, names: list[str]):
    """Per block: ``finish`` of each node, with its witness completed by that of
    the block's root."""
    size = ARITY ** levels

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):                      # a block's nodes at a time
                key, block, up, packed, items, above, subroot = (c[0] for c in map(pa.Array.to_pylist, b.slice(row, 1).columns))
                tree = _unpacked(len(items), up, packed)
                for first in range(0, len(items), 512):
                    some = range(first, min(first + 512, len(items)))
                    yield pa.RecordBatch.from_arrays(
                        finish([(key, block * size + i, tree.levels[0][i], items[i], tree.witness(i, up) + above, subroot) for i in some]), names=names)
    return run


_WITNESS = "key string, pos long, digest binary, item binary, witness binary, subroot binary"


def _as_witness(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]


def witnesses(rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS, finish=_as_witness, schema: str = _WITNESS) -> DataFrame:
    """All nodes of the first round, as ``finish`` makes them of (key, pos,
    digest, item, witness, subroot).  ``above``: (key, witness, subroot)."""
    def complete(blocks: DataFrame, upper: DataFrame, finish, schema: str) -> DataFrame:
        upper = upper.select(F.col("key").alias("__key"), F.col("block").alias("__block"), "witness", "subroot")
        met = blocks.join(upper, F.col("key").eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__block")))
        names = [f.split()[0] for f in schema.split(", ")]
        return met.select("key", "block", "up", "nodes", "items", "witness", "subroot").mapInArrow(_complete(levels, finish, names), schema)

    top = above.select("key", F.lit(0).cast("long").alias("block"), "witness", "subroot")
    upper = top
    for i in range(len(rounds) - 1, 0, -1):
        nodes = complete(rounds[i], upper, _as_witness, _WITNESS)
        # a key that ended in the round before takes its subroot's witness there
        ended = rounds[i - 1].where("blocks = 1").select(F.col("key").alias("__k"))
        upper = written(nodes.select("key", F.col("pos").alias("block"), "witness", "subroot")
                        .unionByName(top.join(ended, F.col("key").eqNullSafe(F.col("__k"))).drop("__k")), "witnesses")
    return complete(rounds[0], upper, finish, schema)


def manifest(leaves: DataFrame, levels: int = LEVELS, finish=None, schema: str = _WITNESS) -> tuple[DataFrame, bytes | None]:
    """``leaves``: (key string, doc_id long, digest binary, item binary).  Per leaf
    key, pos, digest, item, witness and subroot, or what ``finish(root)`` makes of
    these; and the root (None for no leaves)."""
    spark = leaves.sparkSession
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("item")]
    placed = positions(leaves, "key", order).select("key", "pos", "of", "digest", "item")
    rounds = trees(placed, levels)
    subs = written(subroots(rounds), "subroots")
    # the subroots are nodes of one key, ordered by their own, which are their items
    named = subs.select(F.lit("").alias("all"), "digest", F.encode("key", "utf-8").alias("item"))
    tops = positions(named, "all", [F.col("item").asc_nulls_first()])
    top_rounds = trees(tops.select(F.col("all").alias("key"), "pos", "of", "digest", "item"), levels)
    root = subroots(top_rounds).first()
    root = bytes(root["digest"]) if root else None
    own = spark.createDataFrame([("", bytearray(), None)], "key string, witness binary, subroot binary")      # the root's own witness is empty
    above = witnesses(top_rounds, own, levels).select(F.decode("item", "utf-8").alias("key"), "witness", F.col("digest").alias("subroot"))
    return witnesses(rounds, written(above, "above"), levels, finish(root) if finish else _as_witness, schema), root


def _verified(root: bytes | None):
    """Item: the leaf that is folded, then doc_id in decimal."""
    def finish(rows):
        out = []
        for _, _, digest, item, witness, subroot in rows:
            folded = fold(item[:32], witness)
            out.append((int(item[32:]) if len(item) > 32 else None, digest.hex(), subroot.hex(), root.hex(), proof(witness), folded.hex(), folded == root))
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())
        return [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
    return finish


def tampered(text: Column) -> Column:
    """Upper-case ASCII letters in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and the root that its leaf
    gives after tampering."""
    name = F.col("doc_id").cast("string")
    hit = F.coalesce(F.crc32(name.cast("binary")) % 3 == 0, F.lit(False))
    fields = [F.col(c) for c in FIELDS]
    own = leaf(fields)
    other = leaf([tampered(c) if f == "text" else c for f, c in zip(FIELDS, fields)])
    # a third has its text hashed twice; the item holds the digest that is folded
    rows = docs.select(F.col("lang").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("digest"), name.alias("name"),
                       F.when(hit, other).alias("other"))
    rows = rows.select("key", "doc_id", "digest", F.concat(F.coalesce("other", "digest"), F.encode(F.coalesce("name", F.lit("")), "utf-8")).alias("item"))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return manifest(rows, levels, _verified, schema)[0]
