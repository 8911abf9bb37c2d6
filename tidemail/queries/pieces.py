"""Sub-word queries (K1–K3, P11) with the pieces of a public vocabulary file."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemail.functions import text as tx
from tidemail.operators import pieces as pw
from tidemail.operators import tokens as tk
from tidemail.queries import sqlfrag as s
from tidemail.queries.tokens import MAX_LEN, VOCAB
from tidemail.registry import register
from tidemail.sources.tables import EMAILS_SQL, emails, table

#: An uncased vocabulary whose pieces mark the end of words.
PATH = public_tokenizers.path("word_bpe_49k.json")
_LETTERS = "[" + ", ".join(s.q(c) for c in pw.byte_letters()) + "]"


def _matched(words: str, voc: str, out: str) -> str:
    """SQL: ``out`` (token, seq, piece): the longest pieces of each word (token) of
    ``words``, from left to right."""
    return f"""
{out}_w AS (SELECT token, array_to_string(list_transform(regexp_extract_all(hex(encode(token)), '..'),
                   lambda h: list_extract({_LETTERS}, CAST('0x' || h AS INTEGER) + 1)), '') AS w FROM {words}),
{out} AS (SELECT token, w, 1 AS i, 0 AS seq, CAST(NULL AS VARCHAR) AS piece FROM {out}_w
  UNION ALL
  SELECT token, any_value(w), i + max_by(k, k), seq + 1, max_by(p.piece, k)
  FROM (SELECT token, w, i, seq, unnest(range(1, least(length(w) - i + 1, 64) + 1)) AS k FROM {out} WHERE i <= length(w)) c
  JOIN {voc} p ON p.piece = substr(w, i, k) || CASE WHEN i + k > length(w) THEN '</w>' ELSE '' END
  GROUP BY token, i, seq)"""


_VOCAB_SQL = f"""
file AS (SELECT CAST(json_extract(content, '$.model.vocab') AS MAP(VARCHAR, INTEGER)) AS v FROM read_text({s.q(PATH)})),
all_pieces AS (SELECT unnest(map_keys(v)) AS piece, unnest(map_values(v)) AS file_id FROM file),
tok AS (SELECT unnest({s.tokens('text')}) AS token FROM documents),
vc AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
{_matched('vc', 'all_pieces', 'm1')},
used AS (SELECT piece, CAST(sum(n) AS BIGINT) AS n FROM m1 JOIN vc USING (token) WHERE piece IS NOT NULL GROUP BY piece),
cand AS (SELECT piece, file_id, coalesce(n, 0) AS n, length(replace(piece, '</w>', '')) = 1 AS single FROM all_pieces LEFT JOIN used USING (piece)),
voc AS (SELECT piece, n, CAST(row_number() OVER (ORDER BY single DESC, CASE WHEN single THEN 0 ELSE -n END, file_id) + 1 AS INTEGER) AS piece_id
        FROM cand WHERE single OR n > 0 QUALIFY piece_id <= {VOCAB} + 1)
"""


def _vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", parallel=True)
    return docs, pw.corpus_pieces(docs, "text", pw.load_pieces(PATH), VOCAB)


@register("piece_vocab", f"""
WITH RECURSIVE {_VOCAB_SQL}
SELECT '[PAD]' AS piece, 0 AS piece_id, NULL::BIGINT AS n
UNION ALL SELECT '[UNK]', 1, NULL
UNION ALL SELECT piece, piece_id, n FROM voc
""")
def piece_vocab(spark, sf_dir):
    """K1: the pieces that the corpus uses most, ``VOCAB`` of them."""
    return _vocabulary(spark, sf_dir)[1].table(spark)


def _encoded(key: str) -> str:
    """SQL: ``enc`` (key, ids) of the texts ``d`` (key, toks)."""
    return f"""
ex AS (SELECT {key}, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM d),
words AS (SELECT DISTINCT token FROM ex),
{_matched('words', 'voc', 'm2')},
enc AS (SELECT {key}, list_slice(list(piece_id ORDER BY pos, seq), 1, {MAX_LEN}) AS ids
        FROM ex JOIN m2 USING (token) JOIN voc USING (piece) GROUP BY {key})"""


@register("piece_encode", f"""
WITH RECURSIVE {_VOCAB_SQL},
d AS (SELECT doc_id, {s.tokens('text')} AS toks FROM documents),
{_encoded('doc_id')}
SELECT d.doc_id, CAST(coalesce(len(enc.ids), 0) AS BIGINT) AS n_ids,
       array_to_string(list_resize(coalesce(enc.ids, []::INTEGER[]), {MAX_LEN}, 0), ' ') AS input_ids,
       array_to_string(list_transform(generate_series(1, {MAX_LEN}),
                       lambda i: CASE WHEN i <= coalesce(len(enc.ids), 0) THEN 1 ELSE 0 END), ' ') AS attention_mask
FROM d LEFT JOIN enc ON enc.doc_id = d.doc_id
""")
def piece_encode(spark, sf_dir):
    """K2 + K3: ids of the first ``MAX_LEN`` pieces, padded, with mask."""
    docs, vocab = _vocabulary(spark, sf_dir)
    enc = tk.pad(pw.encode_pieces(docs.select("doc_id", "text"), vocab, "text", MAX_LEN), "ids", MAX_LEN)
    return enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("attention_mask", " ").alias("attention_mask"))


@register("piece_inputs", f"""
WITH RECURSIVE {_VOCAB_SQL},
d AS (SELECT mail_id, label, {s.tokens(s.training_text('subject', 'body'))} AS toks FROM {EMAILS_SQL} e),
{_encoded('mail_id')}
SELECT array_to_string(list_resize(coalesce(enc.ids, []::INTEGER[]), {MAX_LEN}, 0), ' ') AS input_ids,
       CAST(coalesce(len(enc.ids), 0) AS BIGINT) AS n_attended, d.label
FROM d LEFT JOIN enc ON enc.mail_id = d.mail_id
""")
def piece_inputs(spark, sf_dir):
    """The mails' training texts as sub-word ``input_ids, attention_mask, label``."""
    mails = emails(spark, sf_dir, parallel=True).select("mail_id", tx.training_text("subject", "body").alias("text"), "label")
    vocab = _vocabulary(spark, sf_dir)[1]
    given = tk.model_inputs(tk.pad(pw.encode_pieces(mails, vocab, "text", MAX_LEN), "ids", MAX_LEN))
    return given.select(F.array_join("input_ids", " ").alias("input_ids"),
                        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"), "label")
