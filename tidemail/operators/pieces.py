"""Sub-word pieces: vocabulary (K1) and longest-match encoding (K2).

The pieces come from a public vocabulary file, as the reference's own tokenizer
comes ready made; its path is a parameter.  :func:`corpus_pieces` cuts it to the
pieces that a corpus uses most, which takes distributed counts of words, then
of their pieces; nothing is merged or learned.

A word is encoded from left to right: always the longest piece that fits at the
place.  Pieces are kept in a trie that tasks walk once for each distinct word of
an Arrow batch.  The trie is sent to the tasks; its size is checked, and one
above :data:`MAX_PIECES` is an error, not another way with other results.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.functions.text import tokens
from tidemail.operators.tokens import SPECIALS, UNK, token_counts

#: Most pieces of a vocabulary (about 100 bytes each in a task).
MAX_PIECES = 2_000_000
#: Distinct words a task keeps with their ids.
CACHE_WORDS = 200_000
#: List items of an Arrow batch handled at once inside a task.
RUN_ITEMS = 1 << 17


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable
    Latin-1 for itself, others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


@dataclass
class Pieces:
    """Pieces with their ids.  ``end_mark`` ends the pieces that end a word,
    ``inner_mark`` begins those that do not begin one (either may be empty);
    ``byte_level`` vocabularies spell UTF-8 bytes as :func:`byte_letters`."""
    ids: dict[str, int]
    end_mark: str = ""
    inner_mark: str = ""
    byte_level: bool = False
    counts: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        if len(self.ids) > MAX_PIECES:
            raise ValueError(f"a vocabulary of {len(self.ids)} pieces is over the bound of {MAX_PIECES}")

    def spell(self, word: str) -> str:
        return "".join(map(_LETTERS.__getitem__, word.encode())) if self.byte_level else word

    def table(self, spark: SparkSession) -> DataFrame:
        """``(piece, piece_id, n)`` with the special ids first."""
        rows = [(p, i, None) for p, i in SPECIALS] + [(p, i, self.counts.get(p)) for p, i in self.ids.items()]
        return spark.createDataFrame(rows, "piece string, piece_id int, n bigint")

    @cached_property
    def trie(self) -> tuple[dict, dict, dict]:
        """Steps ``(node, letter) -> node`` from the roots 0 (at a word's
        beginning) and 1 (inside), and the ids accepted inside and at its end."""
        step, inside, at_end, n = {}, {}, {}, 2
        for piece, i in self.ids.items():
            inner = bool(self.inner_mark) and piece.startswith(self.inner_mark)
            text = piece[len(self.inner_mark):] if inner else piece
            ends = bool(self.end_mark) and text.endswith(self.end_mark)
            text = text[:-len(self.end_mark)] if ends else text
            for root in ((int(inner),) if self.inner_mark else (0, 1)):
                node = root
                for letter in text:
                    to = step.get((node, letter))
                    if to is None:
                        to = step[node, letter] = n
                        n += 1
                    node = to
                if node > 1:
                    if ends or not self.end_mark:
                        at_end[node] = i
                    if not ends:
                        inside[node] = i
        return step, inside, at_end

    def match(self, word: str) -> list[int]:
        """Ids of the longest pieces from left to right; a word with a place where
        none fits is one ``[UNK]``."""
        step, inside, at_end = self.trie
        word = self.spell(word)
        out, at = [], 0
        while at < len(word):
            node, best, to = int(at > 0), None, at
            for i in range(at, len(word)):
                node = step.get((node, word[i]))
                if node is None:
                    break
                found = (at_end if i + 1 == len(word) else inside).get(node)
                if found is not None:
                    best, to = found, i + 1
            if best is None:
                return [UNK]
            out.append(best)
            at = to
        return out


_LETTERS = byte_letters()


def load_pieces(path: str) -> Pieces:
    """A vocabulary file: ``.txt`` with a piece a line and ``##`` inside words, or
    the JSON of a BPE or word-piece tokenizer."""
    if path.endswith(".txt"):
        with open(path, encoding="utf-8") as f:
            return Pieces({line.rstrip("\n"): i for i, line in enumerate(f)}, inner_mark="##")
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model = held["model"]
    return Pieces(dict(model["vocab"]), end_mark=model.get("end_of_word_suffix") or "", inner_mark=model.get("continuing_subword_prefix") or "",
                  byte_level="ByteLevel" in json.dumps(held.get("pre_tokenizer")))


def list_runs(batches, items: int = RUN_ITEMS):
    """The batches cut into runs of rows of about ``items`` items of their last
    column, a list (a row of more is a run of its own)."""
    for b in batches:
        size = pc.fill_null(pc.list_value_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < b.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + items, "right")))
            yield b.slice(start, end - start)
            start = end


def _matched(words: pa.Array, pieces: Pieces, cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after the other, and how many each has."""
    found = []
    for w in words.to_pylist():
        ids = cache.get(w)
        if ids is None:
            ids = pieces.match(w)
            if len(cache) < CACHE_WORDS:
                cache[w] = ids
        found.append(ids)
    return np.array([i for ids in found for i in ids], np.int32), np.array([len(ids) for ids in found], np.int64)


def piece_counts(df: DataFrame, text_col: str, pieces: Pieces) -> DataFrame:
    """``(piece_id, n)``: how often the words of all texts use each piece.  Words
    are counted first, so each distinct word is matched once."""
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for b in batches:
            ids, n = _matched(b.column(0), sent.value, {})
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.repeat(b.column(1).to_numpy(), n))], names=["piece_id", "n"])

    return (token_counts(df, text_col).mapInArrow(run, "piece_id int, n bigint")
            .groupBy("piece_id").agg(F.sum("n").alias("n")))


def corpus_pieces(df: DataFrame, text_col: str, pieces: Pieces, size: int) -> Pieces:
    """K1: a vocabulary of at most ``size`` pieces.  Pieces of one letter stay
    whatever their count, so that a byte-level vocabulary needs no ``[UNK]``; the
    others stay by count, then by their id.  Ids begin after the special ones, with
    the one-letter pieces first."""
    # at most one row a piece of the file
    used = {r["piece_id"]: r["n"] for r in piece_counts(df, text_col, pieces).collect()}

    def single(p: str) -> bool:
        p = p.removeprefix(pieces.inner_mark) if pieces.inner_mark else p
        return len(p.removesuffix(pieces.end_mark) if pieces.end_mark else p) == 1

    first = [p for p in pieces.ids if single(p)]
    rest = sorted((p for p, i in pieces.ids.items() if i in used and not single(p)), key=lambda p: (-used[pieces.ids[p]], pieces.ids[p]))
    kept = sorted(first, key=pieces.ids.get) + rest[:max(0, size - len(first))]
    return Pieces({p: len(SPECIALS) + k for k, p in enumerate(kept)}, pieces.end_mark, pieces.inner_mark, pieces.byte_level,
                  {p: used.get(pieces.ids[p], 0) for p in kept})


def encode_pieces(df: DataFrame, pieces: Pieces, text_col: str, max_len: int, out: str = "ids") -> DataFrame:
    """K2: ids of the first ``max_len`` pieces of each text, by longest match.
    Texts without words (null among them) get an empty array.  ``text_col`` is
    replaced by ``out``; all other columns and all rows stay, whatever their
    keys.  Nothing is shuffled; a word has one piece at least, so words beyond the
    first ``max_len`` are not looked at."""
    rest = [c for c in df.columns if c != text_col]
    given = df.select(*rest, F.slice(tokens(text_col), 1, max_len).alias(out))
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        cache: dict = {}
        for b in list_runs(batches):
            lists = b.column(b.num_columns - 1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
            index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ids, n = _matched(words.dictionary, sent.value, cache)
            start, n_of = np.cumsum(n) - n, n[index]
            ends = np.cumsum(n_of)
            flat = ids[np.arange(int(n_of.sum())) + np.repeat(start[index] - (ends - n_of), n_of)]
            row_end = np.concatenate([[0], ends])[np.cumsum(size)]
            row_n = np.diff(row_end, prepend=0)
            inside = np.arange(len(flat)) - np.repeat(row_end - row_n, row_n) < max_len
            off = pa.array(np.concatenate([[0], np.cumsum(np.minimum(row_n, max_len))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(off, pa.array(flat[inside], pa.int32()))],
                                             names=b.schema.names)

    schema = T.StructType([*df.select(*rest).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return given.mapInArrow(run, schema)
