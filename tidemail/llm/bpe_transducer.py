"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus' frequent words are compiled with their ids into a minimal acyclic
automaton: words are added in sorted order and equal suffix states are shared.
Every transition carries the number of words that come before it below its
state; the sum along a word's path is the word's number, and the number leads to
its ids.  The automaton is a set of plain arrays in one file that every worker
maps into memory.  A block's distinct words walk it together, one byte a step.

Words it does not hold are merged exactly, all of a block together: in every
round each word makes its leftmost merge of lowest rank.

Splitting follows the vocabulary's own pattern; a text is cut into pieces at
places where the pattern always ends a word, and each distinct piece is split
once.  Cutting before a space is exact unless the space stands between two
white-space characters, or after one at the text's end; such texts, and texts
with an added token's string, are split whole.

Defined results: null text is empty; empty text has no ids, and the digests of
nothing; ties between merges go to the leftmost; repeated rows are encoded
each; an empty table gives an empty lexicon and no rows; extra columns never
enter (``encode_docs`` adds its columns to the input's).
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import tempfile
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.llm.common import blocks, fresh, lists_of, text_of
from tidemail.llm.pieces import IdCache, encode_texts, gather

#: Fixed values of byte-level BPE: the splitting pattern of its vocabularies ...
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(PATTERN)
#: ... and white space as that pattern has it, in Arrow's notation.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_of_char()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = token.encode() if token in self.added else bytes(of[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = np.array([vocab[c] for c, _ in sorted(of.items(), key=lambda kv: kv[1])], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pairs = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair; len(made) where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], len(self.made))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word, and the number of each; words of about equal
        length are merged together as rows of a table."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(size, kind="stable")
        i = 0
        while i < len(order):
            if size[order[i]] == 0:
                i += 1
                continue
            widest = max(8, int(size[order[i]] * 5 // 4))
            j = min(int(np.searchsorted(size[order], widest, "right")), i + max(1, (1 << 21) // widest))
            group = order[i:j]
            parts.append((group, self._merge_table([words[k] for k in group.tolist()], size[group])))
            i = j
        for group, (flat, n) in parts:
            counts[group] = n
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), np.int32)
        for group, (flat, n) in parts:
            out[np.arange(len(flat)) + np.repeat(ends[group] - n - np.concatenate([[0], np.cumsum(n)[:-1]]), n)] = flat
        return out, counts

    def _merge_table(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        table = np.full((len(words), width + 1), -1, np.int64)
        cell = np.arange(width + 1)[None, :] < size[:, None]
        table[cell] = flat
        none = len(self.made)
        rank = np.full((len(words), width), none, np.int64)
        rank[:, :] = self.rank(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(rank.shape)
        live = np.arange(len(words))
        done_ids, done_n = [None] * 0, size.copy()
        final = table
        work, ranks, n = table, rank, size.copy()
        while len(live):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(live)), at]
            stop = best == none
            if stop.any():
                final[live[stop]] = work[stop] if work is not final else final[live[stop]]
                done_n[live[stop]] = n[stop]
                live, work, ranks, n, at, best = live[~stop], work[~stop], ranks[~stop], n[~stop], at[~stop], best[~stop]
                if not len(live):
                    break
            elif work is final:
                work, ranks = work.copy(), ranks.copy()
            rows = np.arange(len(live))
            cols = np.arange(width + 1)[None, :]
            take = cols + (cols > at[:, None])
            work = np.concatenate([work, np.full((len(live), 1), -1, np.int64)], 1)
            work[rows, at] = self.made[best]
            work = np.take_along_axis(work, take, 1)
            ranks = np.concatenate([ranks, np.full((len(live), 2), none, np.int64)], 1)
            ranks = np.take_along_axis(ranks, take[:, :width], 1)
            ranks[rows, at] = self.rank(work[rows, at], work[rows, at + 1])
            has_left = at > 0
            before = at[has_left] - 1
            ranks[rows[has_left], before] = self.rank(work[rows[has_left], before], work[rows[has_left], before + 1])
            n -= 1
        cell = np.arange(width + 1)[None, :] < done_n[:, None]
        return final[cell], done_n


# --------------------------------------------------------------- the lexicon

def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words as arrays: edges
    sorted by state * 256 + byte, their targets and word counts skipped, and
    final states.  State 0 is the start."""
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple, bool, int]] = []     # per state: edges, final, words below

    def freeze(node) -> int:
        key = (tuple(node[0]), node[1])
        if key not in register:
            register[key] = len(edges)
            edges.append((key[0], key[1], node[1] + sum(edges[t][2] for _, t in key[0])))
        return register[key]
    path, last = [[[], False]], b""
    for word in words:
        same = len(os.path.commonprefix([word, last]))
        while len(path) - 1 > same:
            node = path.pop()
            path[-1][0].append((last[len(path) - 1], freeze(node)))
        path.extend([[], False] for _ in word[same:])
        path[-1][1], last = True, word
    while len(path) > 1:
        node = path.pop()
        path[-1][0].append((last[len(path) - 1], freeze(node)))
    start = freeze(path[0])
    number = np.arange(len(edges))
    number[start], number[0] = 0, start           # the start becomes state 0
    keys, targets, skips, final = [], [], [], np.zeros(len(edges), np.uint8)
    for s, (out, is_final, _) in enumerate(edges):
        final[number[s]] = is_final
        skip = int(is_final)
        for byte, t in out:
            keys.append(int(number[s]) * 256 + byte)
            targets.append(int(number[t]))
            skips.append(skip)
            skip += edges[t][2]
    keys = np.array(keys, np.int64)
    order = np.argsort(keys)
    return {"keys": keys[order], "targets": np.array(targets, np.int64)[order], "skips": np.array(skips, np.int64)[order],
            "final": final}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: a line that names them, then their bytes."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    head += b" " * (-(len(head) + 1) % 8) + b"\n"
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())


class Lexicon:
    """The packed automaton, mapped into memory."""

    def __init__(self, packed: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(packed)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = held.find(b"\n") + 1
        self.part = {}
        for name, kind, n in json.loads(held[:at]):
            self.part[name] = np.frombuffer(held, kind, n, at)
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words that the lexicon does not hold."""
        keys, targets, skips, final = (self.part[k] for k in ("keys", "targets", "skips", "final"))
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        if not len(keys):
            return out
        data = np.frombuffer(b"".join(words) or b"\0", np.uint8).astype(np.int64)
        start = np.cumsum(size) - size
        live = np.flatnonzero(size > 0)
        state, number, step = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state * 256 + data[start[live] + step]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            ok = keys[at] == key
            live, at, number = live[ok], at[ok], number[ok]
            state, number, step = targets[at], number + skips[at], step + 1
            end = size[live] == step
            hit = end & (final[state] == 1)
            out[live[hit]] = number[hit]
            live, state, number = live[~end], state[~end], number[~end]
        return out


def _word_counter(batches):
    """Words and counts of each block."""
    for b in blocks(batches):
        chunks = pc.value_counts(pc.split_pattern(text_of(b), " ").flatten())
        counts: dict[str, int] = {}
        for chunk, n in zip(chunks.field("values").to_numpy(zero_copy_only=False), chunks.field("counts").to_numpy().tolist()):
            for w in _SPLIT.findall(" " + chunk):
                counts[w] = counts.get(w, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "n"])


def frequent_words(docs: DataFrame, size: int) -> list[bytes]:
    """The ``size`` most frequent words of all rows that occur twice or more,
    counted with map-side partials.  The lexicon only decides speed, never ids."""
    counts = docs.select("text").mapInArrow(_word_counter, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(size).select("word")
    return sorted(r.word.encode() for r in top.collect())


def compile_lexicon(vocab: Vocabulary, words: list[bytes]) -> bytes:
    ids, counts = vocab.merge(words)
    return pack(build_automaton(words) | {"ids": ids.astype(np.int32), "ends": np.concatenate([[0], np.cumsum(counts)])})


class Encoder:
    """Exact encoding of a block of texts."""

    def __init__(self, vocab: Vocabulary, packed: bytes):
        self.vocab, self.lexicon = vocab, Lexicon(packed)
        self.cache = IdCache(self.encode_pieces)
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocab.added, key=len, reverse=True))) or r"(?!)")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        part = self.lexicon.part
        number = self.lexicon.numbers(words)
        unseen = np.flatnonzero(number < 0)
        ids, counts = self.vocab.merge([words[i] for i in unseen.tolist()])
        ends = part["ends"]
        all_ids = np.concatenate([part["ids"], ids])
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        seen = number >= 0
        start[seen], count[seen] = ends[number[seen]], ends[number[seen] + 1] - ends[number[seen]]
        start[unseen], count[unseen] = len(part["ids"]) + np.cumsum(counts) - counts, counts
        return gather(np.arange(len(words)), start, count, all_ids)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # a run of letters, with or without a space before it, is a word
        split = [[p] if p.isalpha() or p[:1] == " " and p[1:].isalpha() else _SPLIT.findall(p) for p in pieces]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        place = dict(zip(words, range(len(words))))
        ids, n = self.encode_words([w.encode() for w in words])
        per_piece = np.fromiter(map(len, split), np.int64, len(split))
        index = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, int(per_piece.sum()))
        flat, each = gather(index, np.cumsum(n) - n, n, ids)
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(per_piece)])]
        return flat, np.diff(ends)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's."""
        whole = pc.match_substring_regex(texts, f"{_SPACE} ({_SPACE}|$)").to_numpy(zero_copy_only=False)
        for token in self.vocab.added:
            whole = whole | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return encode_texts(texts, False, self.cache, whole, self._encode_whole)

    def _encode_whole(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in self.added.finditer(text):
            out += [self._split_encode(text[at:m.start()]), np.array([self.vocab.added[m.group()]], np.int32)]
            at = m.end()
        return np.concatenate([*out, self._split_encode(text[at:])]).astype(np.int32)

    def _split_encode(self, text: str) -> np.ndarray:
        return self.encode_pieces([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        table = self.vocab.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_HELD: dict[str, Encoder] = {}


def _encoder(bc) -> Encoder:
    """One encoder a worker, kept between its tasks."""
    path, packed = bc.value
    key = hashlib.sha256(packed).hexdigest() + path
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(Vocabulary(path), packed)
    return _HELD[key]


def _encode_task(bc, column: str, names: list[str], digest: bool):
    def run(batches):
        encoder = _encoder(bc)
        for b in blocks(batches, column, 4 << 20):
            ids, counts = encoder.encode(text_of(b, column))
            if digest:
                ends = np.cumsum(counts)
                mine = [ids[e - n:e] for e, n in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in mine], pa.string()),
                        pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in mine], pa.string())]
                b = b.drop_columns([column])
            else:
                cols = [lists_of(ids, counts, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])
    return run


def _lexicon(docs: DataFrame, path: str, lexicon_words: int):
    packed = compile_lexicon(Vocabulary(path), frequent_words(docs, lexicon_words))
    return docs.sparkSession.sparkContext.broadcast((path, packed))


def encode_docs(docs: DataFrame, path: str, out: str = "ids", lexicon_words: int = 30_000) -> DataFrame:
    """``docs`` with a new column: the text's ids as array<int>."""
    bc = _lexicon(docs, path, lexicon_words)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encode_task(bc, "text", [out], False), schema)


def decode_docs(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a new column: the text its ids stand for."""
    bc = encoded.sparkSession.sparkContext.broadcast((path, compile_lexicon(Vocabulary(path), [])))

    def run(batches):
        encoder = _encoder(bc)
        for b in batches:
            lists = b.column(ids)
            texts = [None if x is None else encoder.decode(np.array(x, np.int64)) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))


def report(docs: DataFrame, path: str, lexicon_words: int = 30_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    docs = docs.select("doc_id", "text")
    bc = _lexicon(docs, path, lexicon_words)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    schema = T.StructType([docs.schema["doc_id"], T.StructField(names[0], T.LongType()),
                           *(T.StructField(n, T.StringType()) for n in names[1:])])
    return docs.mapInArrow(_encode_task(bc, "text", names, True), schema)


def round_trip(docs: DataFrame, path: str, lexicon_words: int = 30_000) -> DataFrame:
    """``docs`` with every text encoded and decoded again; null stays null."""
    ids, text = fresh(docs, "ids", "decoded")
    out = decode_docs(encode_docs(docs, path, ids, lexicon_words), path, ids, text)
    return out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(text))).select(*docs.columns)
