"""Texts cut into pieces that tokenise alone as they do in the text.

Prose repeats its words, so a task encodes each distinct piece once and joins
the ids of the pieces by position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
ALPHA = ((_BYTES | 32) >= 0x61) & ((_BYTES | 32) <= 0x7A) & (_BYTES < 128)
DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
WHITE = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
SOLID = (_BYTES > 32) & (_BYTES < 127)
#: ASCII punctuation but the apostrophe, which can begin a contraction.
PUNCT = SOLID & ~ALPHA & ~DIGIT & (_BYTES != 0x27)


def cut(texts: pa.StringArray, at_white: bool) -> tuple[pa.StringArray, np.ndarray]:
    """Pieces of all texts and the offsets of each text's pieces.

    Every text is cut between an ASCII letter and punctuation after it, which
    no word pattern joins.  ``at_white`` cuts before all ASCII white space (for
    vocabularies that drop it); otherwise before each space, and around a
    newline between two solid ASCII characters."""
    off = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    before = np.concatenate([[32], data[:-1]]).astype(np.uint8) if len(data) else data
    starts = PUNCT[data] & ALPHA[before]
    if at_white:
        starts |= WHITE[data]
    else:
        after = np.concatenate([data[1:], [32]]).astype(np.uint8) if len(data) else data
        alone = (data == 10) & SOLID[before] & SOLID[after]
        starts |= (data == 32) | alone
        starts[1:] |= alone[:-1]
    starts[off[:-1][off[:-1] < len(data)]] = True
    starts = np.flatnonzero(starts)
    ends = pa.py_buffer(np.concatenate([starts, [len(data)]]).astype(np.int32))
    return pa.StringArray.from_buffers(len(starts), ends, pa.py_buffer(data)), np.searchsorted(starts, off)


class IdCache:
    """Ids of pieces, kept by a worker between blocks.  It takes in pieces until
    it holds ``limit``, so its memory is bounded; others are encoded each time."""

    def __init__(self, encode, limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self.place: dict = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look_up(self, pieces: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and lengths of the pieces' ids, and the ids they point into."""
        at = np.array([self.place.get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(at < 0)
        held = len(self.place)
        ids, ends = self.ids, self.ends
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            more, counts = self.encode(fresh)
            at[new] = held + np.arange(len(new))
            ends = np.concatenate([ends, ends[-1] + np.cumsum(counts)])
            ids = np.concatenate([ids, more])
            if held + len(fresh) <= self.limit:
                self.place.update(zip(fresh, range(held, held + len(fresh))))
                self.ids, self.ends = ids, ends
        return ends[at], ends[at + 1] - ends[at], ids


def gather(index: np.ndarray, start: np.ndarray, count: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces ``index`` in order, and the number of each."""
    n = count[index]
    total = int(n.sum())
    at = np.arange(total) + np.repeat(start[index] - (np.cumsum(n) - n), n)
    return ids[at], n


def encode_texts(texts: pa.StringArray, at_white: bool, cache: IdCache, whole: np.ndarray, encode_whole) -> tuple[np.ndarray, np.ndarray]:
    """All ids and each text's number; texts marked ``whole`` are not cut."""
    pieces, off = cut(texts, at_white)
    coded = pieces.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    flat, n = gather(index, *cache.look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
    counts = np.diff(np.concatenate([[0], np.cumsum(n)])[off])
    if whole.any():
        ends = np.cumsum(counts)
        runs, at = [], 0
        for i in np.flatnonzero(whole).tolist():
            mine = encode_whole(texts[i].as_py())
            runs += [flat[at:ends[i] - counts[i]], mine]
            at, counts[i] = ends[i], len(mine)
        flat = np.concatenate([*runs, flat[at:]])
    return flat, counts
