"""Token queries (K1–K4, X1) over ``documents``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemail.functions import text as tx
from tidemail.operators import tokens as tk
from tidemail.queries import sqlfrag as s
from tidemail.registry import register
from tidemail.sources.tables import EMAILS_SQL, emails, table

# The reference's vocabulary size (uncased word pieces) and its
# training sequence length.
VOCAB = 30522
MAX_LEN = 256

_VOCAB_SQL = f"""
tok AS (SELECT unnest({s.tokens('text')}) AS token FROM documents),
vc AS (SELECT token, count(*) AS n FROM tok GROUP BY token),
w AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token ASC) + 1 AS INTEGER) AS token_id, n
      FROM vc QUALIFY token_id <= {VOCAB + 1})
"""


@register("vocab_top", f"""
WITH {_VOCAB_SQL}
SELECT '[PAD]' AS token, 0 AS token_id, NULL::BIGINT AS n
UNION ALL SELECT '[UNK]', 1, NULL
UNION ALL SELECT token, token_id, n FROM w
""")
def vocab_top(spark, sf_dir):
    """K1: corpus vocabulary, top ``VOCAB`` tokens by count desc, token asc."""
    return tk.build_vocab(table(spark, sf_dir, "documents"), "text", VOCAB)


@register("token_encode", f"""
WITH {_VOCAB_SQL},
d AS (SELECT doc_id, list_slice({s.tokens('text')}, 1, {MAX_LEN}) AS toks FROM documents),
ex AS (SELECT doc_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM d),
enc AS (SELECT ex.doc_id, list(coalesce(w.token_id, 1) ORDER BY ex.pos) AS ids
        FROM ex LEFT JOIN w ON w.token = ex.token GROUP BY ex.doc_id)
SELECT d.doc_id,
       CAST(coalesce(len(enc.ids), 0) AS BIGINT) AS n_ids,
       array_to_string(list_resize(coalesce(enc.ids, []::INTEGER[]), {MAX_LEN}, 0), ' ') AS input_ids,
       array_to_string(list_transform(generate_series(1, {MAX_LEN}),
                       lambda i: CASE WHEN i <= coalesce(len(enc.ids), 0) THEN 1 ELSE 0 END), ' ') AS attention_mask
FROM d LEFT JOIN enc ON enc.doc_id = d.doc_id
""")
def token_encode(spark, sf_dir):
    """K2 + K3 (+P11 columns): ids of the first ``MAX_LEN`` tokens, padded, with mask."""
    docs = table(spark, sf_dir, "documents", parallel=True)
    vocab = tk.build_vocab(docs, "text", VOCAB)
    enc = tk.pad(tk.encode(docs.select("doc_id", "text"), vocab, "doc_id", "text", MAX_LEN), "ids", MAX_LEN)
    return enc.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"),
                      F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("attention_mask", " ").alias("attention_mask"))


@register("model_inputs", f"""
WITH {_VOCAB_SQL},
d AS (SELECT mail_id, label, list_slice({s.tokens(s.training_text('subject', 'body'))}, 1, {MAX_LEN}) AS toks FROM {EMAILS_SQL} e),
ex AS (SELECT mail_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM d),
enc AS (SELECT ex.mail_id, list(coalesce(w.token_id, 1) ORDER BY ex.pos) AS ids
        FROM ex LEFT JOIN w ON w.token = ex.token GROUP BY ex.mail_id)
SELECT array_to_string(list_resize(coalesce(enc.ids, []::INTEGER[]), {MAX_LEN}, 0), ' ') AS input_ids,
       CAST(coalesce(len(enc.ids), 0) AS BIGINT) AS n_attended, d.label
FROM d LEFT JOIN enc ON enc.mail_id = d.mail_id
""")
def model_inputs(spark, sf_dir):
    """The mails' training texts as ``input_ids, attention_mask, label``."""
    mails = emails(spark, sf_dir, parallel=True)
    mails = mails.select("mail_id", tx.training_text("subject", "body").alias("text"), "label")
    vocab = tk.build_vocab(table(spark, sf_dir, "documents", parallel=True), "text", VOCAB)
    given = tk.model_inputs(tk.pad(tk.encode(mails, vocab, "mail_id", "text", MAX_LEN), "ids", MAX_LEN))
    return given.select(F.array_join("input_ids", " ").alias("input_ids"),
                        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"), "label")


def _lengths(pdf: pd.DataFrame) -> pd.DataFrame:
    t = pdf["text"].fillna("")
    return pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": t.str.len().astype("int64"),
                         "n_lines": (t.str.count("\n") + 1).astype("int64")})


@register("batch_lengths", """
SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
       CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS BIGINT) AS n_lines
FROM documents
""")
def batch_lengths(spark, sf_dir):
    """A user pandas function over Arrow batches of every partition."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tk.map_batches(docs, _lengths, "doc_id long, n_chars long, n_lines long")
