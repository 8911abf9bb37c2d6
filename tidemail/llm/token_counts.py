"""Token counts: whole texts encoded in Arrow batches, lengths only.

A task re-cuts its rows into batches of about equal bytes, so that neither many
short texts nor one long text decide its memory, and keeps the number of ids of
each, never the ids.  A text over ``CUT_CHARS`` is split at safe boundaries; its
parts are encoded like texts of their own, and their counts add up exactly.

A boundary is safe where no piece of the vocabulary joins the two characters
beside it, since every symbol a merge makes is a piece.  For a sentencepiece
model the boundaries are read from its own pieces:

* before a space after another character, if no piece has a word mark after
  another character.  The part's leading space is then left out, because the
  encoder puts a word mark before each text itself;
* before an ASCII character that no piece holds (a newline, say).  The encoder's
  own mark cannot merge with it, so it counts one too many and is taken off.

A model that normalises texts is not cut.  Vocabularies of the other library
(``.json``) encode whole texts.

Defined results: null and empty texts have 0 bytes and what the library gives
for an empty text (0 tokens); a text without a safe boundary is encoded whole;
rows are counted one by one, so repeated rows and null doc_ids stay; an empty
table gives no rows; extra columns never enter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemail.llm.common import blocks, text_of

#: Bytes encoded at once, and the characters from which on a text is split.
BATCH_BYTES = 1 << 20
CUT_CHARS = 4096
MARK = "▁"


class PieceCounter:
    """Counts of a sentencepiece model."""

    def __init__(self, path: str, cut_chars: int = CUT_CHARS):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cut_chars = cut_chars
        self.boundary = self._boundary()

    def _boundary(self) -> re.Pattern | None:
        m = self.model
        if m.normalize("  a \n b ") != f"{MARK * 3}a{MARK}\n{MARK}b{MARK}":
            return None
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        rules = []
        if not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            rules.append(f"(?<=[^ {MARK}])(?= )")
        held = set().union(*pieces)
        self.alone = {chr(c) for c in range(128) if chr(c) not in held and chr(c) != " "}
        if self.alone:
            rules.append(f"(?=[{re.escape(''.join(sorted(self.alone)))}])")
        return re.compile("|".join(rules)) if rules else None

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """The text's parts as the encoder takes them, with what each one's
        count has too many."""
        start, over = 0, 0
        while self.boundary is not None and len(text) - start > self.cut_chars:
            at = self.boundary.search(text, start + self.cut_chars)
            if at is None:
                break
            alone = text[at.start()] in self.alone
            if not alone and at.start() + 1 == len(text):     # nothing would be left, and the encoder marks no empty text
                break
            yield text[start:at.start()], over
            start, over = at.start() + (not alone), int(alone)
        yield text[start:], over

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


class LibraryCounter:
    """Counts of a vocabulary of the tokenizers library; texts stay whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        yield text, 0

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=4)
def counter(path: str):
    """The counter of a vocabulary file, one a worker."""
    return PieceCounter(path) if path.endswith(".model") else LibraryCounter(path)


def count_texts(count, texts: pa.StringArray, batch_bytes: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each text, encoded in batches of about ``batch_bytes``."""
    out = np.zeros(len(texts), np.int64)
    batch, of, held = [], [], 0

    def flush():
        np.add.at(out, of, count.counts(batch))
        batch.clear()
        of.clear()

    for row, text in enumerate(texts):
        for part, over in count.parts(text.as_py()):
            batch.append(part)
            of.append(row)
            out[row] -= over
            held += len(part)
            if held >= batch_bytes:
                flush()
                held = 0
    if batch:
        flush()
    return out


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per row: ``key``, n_bytes (UTF-8) and n_tokens of its whole text.  No
    shuffle; the text never leaves its task."""
    def run(batches):
        count = counter(path)
        for b in blocks(batches, "__text", 4 * batch_bytes):
            texts = text_of(b, "__text")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(count_texts(count, texts, batch_bytes))],
                names=["__key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    return rows.mapInArrow(run, f"__key {kind}, n_bytes long, n_tokens long").withColumnRenamed("__key", key)


def report(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    return count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
