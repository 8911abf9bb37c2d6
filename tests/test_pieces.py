import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tidemail.functions.text import tokens
from tidemail.operators import pieces as pw

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = pw.byte_letters()


def by_hand(word, pieces):
    """Longest match, tried from the longest piece down."""
    letters = "".join(LETTERS[b] for b in word.encode()) if pieces.byte_level else word
    out, at = [], 0
    while at < len(letters):
        for end in range(len(letters), at, -1):
            p = (pieces.inner_mark if at else "") + letters[at:end] + (pieces.end_mark if end == len(letters) else "")
            if p in pieces.ids:
                break
        else:
            return [1]
        out.append(pieces.ids[p])
        at = end
    return out


SMALL = {"un": 5, "aff": 6, "##aff": 7, "##able": 8, "##a": 9, "able": 10, "a": 11, "##b": 12, "##le": 13, "é": 14}


@pytest.mark.parametrize("pieces", [pw.Pieces(SMALL, inner_mark="##"),
                                    pw.Pieces({"a": 2, "b": 3, "a</w>": 4, "b</w>": 5, "ab": 6, "ba</w>": 7, "abab": 8, "aba": 9}, end_mark="</w>"),
                                    pw.Pieces({"a": 2, "ab": 3, "abb": 4, "bab": 5}),
                                    pw.load_pieces(PATH)])
def test_match_equals_by_hand(pieces):
    r = random.Random(1)
    words = ["unaffable", "un", "affaffable", "x", "aé", "é", "漢字", ""] + ["".join(r.choices("abé", k=r.randint(1, 12))) for _ in range(400)]
    words += ["".join(r.choice(["tion", "the", "q", "zz", "ß"]) for _ in range(r.randint(1, 6))) for _ in range(400)]
    for w in words:
        assert pieces.match(w) == by_hand(w, pieces), w


def test_wordpiece_file(spark, tmp_path):
    path = tmp_path / "vocab.txt"
    path.write_text("\n".join(["[PAD]", "[UNK]", "un", "##aff", "##able"]) + "\n")
    pieces = pw.load_pieces(str(path))
    assert pieces.match("unaffable") == [2, 3, 4] and pieces.match("able") == [1]


def test_bound():
    with pytest.raises(ValueError, match="bound"):
        pw.Pieces({str(i): i for i in range(pw.MAX_PIECES + 1)})


def test_corpus_pieces_and_no_unknown_words(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    full = pw.load_pieces(PATH)
    vocab = pw.corpus_pieces(docs, "text", full, 30522)
    words = Counter(w for r in docs.select(tokens("text").alias("t")).collect() for w in r.t)
    used = Counter()
    for w, n in words.items():
        for i in by_hand(w, full):
            used[i] += n
    name = {i: p for p, i in full.ids.items()}
    singles = [p for p in full.ids if len(p.removesuffix("</w>")) == 1]
    many = sorted((i for i in used if name[i] not in singles), key=lambda i: (-used[i], i))[:30522 - len(singles)]
    assert list(vocab.ids) == singles + [name[i] for i in many] and list(vocab.ids.values()) == list(range(2, 2 + len(vocab.ids)))
    assert vocab.counts == {p: used[full.ids[p]] for p in vocab.ids}
    assert len(singles) == 512 and all(1 not in vocab.match(w) for w in words)
    small = pw.corpus_pieces(docs, "text", full, 600)
    assert len(small.ids) == 600 and list(small.ids)[512:] == [name[i] for i in many[:88]] and all(1 not in small.match(w) for w in words)
    assert small.table(spark).count() == 602


def test_encode_keeps_rows_and_columns(spark):
    pieces = pw.load_pieces(PATH)
    texts = ["The unaffable cat", None, "", "...", "x" * 300, "é à 漢字 1234", "word " * 4000, "A a"]
    rows = [(None if i % 3 == 0 else 7, t, i) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "id long, text string, ids_of int")
    want = {r.n: r.t or [] for r in df.select(F.col("ids_of").alias("n"), tokens("text").alias("t")).collect()}
    known = {w: by_hand(w, pieces) for t in want.values() for w in t}
    for max_len in (1, 5, 256):
        for parts in (1, 5):
            got = pw.encode_pieces(df.repartition(parts), pieces, "text", max_len)
            assert got.columns == ["id", "ids_of", "ids"]
            got = {r.ids_of: (r.id, r.ids) for r in got.collect()}
            assert len(got) == len(rows)
            for i, (key, text, n) in enumerate(rows):
                ids = [x for w in want[n] for x in known[w]][:max_len]
                assert got[n] == (key, ids), text
    assert pw.encode_pieces(df.limit(0), pieces, "text", 4).count() == 0


def test_lists_are_handled_in_bounded_runs():
    lists = [[1] * n if n is not None else None for n in (3, 0, 5, 2, 9, None, 1, 4, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array(lists, pa.list_(pa.int32()))], names=["k", "ids"])
    runs = list(pw.list_runs([batch, batch.slice(0, 0), batch.slice(2, 3)], 6))
    sizes = [[len(x or []) for x in r.column(1).to_pylist()] for r in runs]
    assert sizes == [[3, 0], [5], [2], [9], [0, 1, 4, 1], [1], [5], [2], [9]]
    assert [r for x in runs for r in x.to_pylist()] == batch.to_pylist() + batch.slice(2, 3).to_pylist()
