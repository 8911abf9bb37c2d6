"""Chat formatting with offset-aligned loss masks.

A whole conversation is rendered once::

    <|im_start|>role<|im_sep|>text<|im_end|>\\n   for every turn

and encoded once, with offsets.  The spans of the turns to learn from are kept
sorted; a token's place among them is found by binary search, and the
intersection of the two spans is what the loss mask covers.  The three control
strings are tokens of their own, so no token crosses a span's edge and the mask
falls on whole tokens.

Control strings inside texts and roles are escaped reversibly: a ``<`` before
any number of backslashes and a ``|`` gets one backslash more.  No escaped text
holds ``<|``, and ``unescape`` takes the backslash out again.

Defined results: null text is an empty text, a null role an empty role; turns
are ordered by turn, ties by role and text, null turns first; repeated rows are
turns each; rows with null conv_id are one conversation; an empty table gives
no conversations; extra columns never enter.

A conversation is rendered in one task, as its output is one text; rows reach
the task sorted and are read as a stream, one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, np.ndarray]:
    """The conversation's text and the sorted spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role)}{SEP}"
        body = escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    out = []
    for part in text.split(START)[1:]:
        role, body = part.split(SEP, 1)
        out.append((unescape(role), unescape(body.rsplit(END, 1)[0])))
    return out


def mask_tokens(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's intersection with the spans (start, end; empty where there
    is none).  Both are sorted and spans do not overlap: a token can only meet
    the last span that starts before its end."""
    if not len(spans) or not len(offsets):
        zero = np.zeros(len(offsets), np.int64)
        return zero, zero
    k = np.maximum(np.searchsorted(spans[:, 0], offsets[:, 1], "left") - 1, 0)
    start = np.maximum(offsets[:, 0], spans[k, 0])
    end = np.minimum(offsets[:, 1], spans[k, 1])
    return start, np.maximum(start, end)


class Formatter:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (START, SEP, END)])

    def encode(self, text: str, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the mask of tokens to learn, and the masked character spans
        merged (a character's bytes may lie in several tokens)."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
        start, end = mask_tokens(offsets, spans)
        learn = end > start
        first, upto = start[learn], np.maximum.accumulate(end[learn])
        new = np.flatnonzero(np.concatenate([[True], first[1:] > upto[:-1]])) if len(first) else np.zeros(0, np.int64)
        last = np.concatenate([new[1:], [len(first)]])[:len(new)] - 1
        return np.array(e.ids, np.int32), learn, np.stack([first[new], upto[last]], 1)


@lru_cache(maxsize=4)
def formatter(path: str) -> Formatter:
    """The formatter of a vocabulary file, one a worker."""
    return Formatter(path)


def _stream(batches):
    """(conv_id, role, text) rows of sorted batches."""
    for b in batches:
        yield from zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())


def _formatter(path: str, learn: str, rows: int = 500):
    def run(batches):
        f = formatter(path)
        out: list[tuple] = []

        def batch():
            cols = list(zip(*out))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["conv_id", "formatted", "ids", "learn", "starts", "ends"])
        size = 0
        for conv, turns in groupby(_stream(batches), key=lambda r: r[0]):
            text, spans = render([(role or "", body or "") for _, role, body in turns], learn)
            ids, mask, covered = f.encode(text, spans)
            out.append((conv, text, ids, mask, covered[:, 0], covered[:, 1]))
            size += len(text)
            if len(out) >= rows or size > 1 << 20:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()
    return run


def format_conversations(conversations: DataFrame, path: str, learn: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, its rendered text, ids, the token mask, and
    the masked spans in characters (code points)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(_formatter(path, learn),
                        "conv_id long, formatted string, ids array<int>, learn array<boolean>, starts array<long>, ends array<long>"))


def _digests(batches):
    for b in batches:
        rows = []
        n_tokens = pc.list_value_length(b.column("ids")).to_pylist()
        # lists as a running sum at their ends
        ends = np.cumsum(n_tokens)
        learns = np.concatenate([[0], np.cumsum(b.column("learn").flatten().to_numpy(zero_copy_only=False))])
        n_learn = (learns[ends] - learns[ends - n_tokens]).tolist()
        for conv, formatted, starts, stops, n, k in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "starts", "ends")), n_tokens, n_learn):
            turns = parse(formatted)
            learnt = [unescape(formatted[x:y]) for x, y in zip(starts, stops)]
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(learnt)
            rows.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss),
                         hashlib.sha256(loss.encode()).hexdigest(), len(formatted), n, k))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_learn"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def report(conversations: DataFrame, path: str) -> DataFrame:
    """The digests of every conversation, read back from its output."""
    return format_conversations(conversations, path).mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
                  "n_tokens long, n_learn long")
