"""DuckDB twins of the column functions, used only to write oracle SQL."""

from __future__ import annotations

from tidemail.functions.text import JS_WS, PY_WS
from tidemail.sources.tables import EMAILS_SQL, TEST_DOMAIN  # noqa: F401


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + JS_WS + '+|' + JS_WS + '+' + chr(92) + 'z')}, '', 'g')"


def collapse_newlines(x: str) -> str:
    return f"regexp_replace({x}, {q(chr(92) + 'n{2,}')}, chr(10), 'g')"


def collapse_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(JS_WS + '{2,}')}, ' ', 'g')"


def clean_body(x: str) -> str:
    return js_trim(collapse_ws(collapse_newlines(x)))


def training_text(s: str, b: str) -> str:
    return f"(coalesce({s}, '') || ' ' || coalesce({b}, ''))"


def sender_domain(s: str) -> str:
    return (f"CASE WHEN coalesce(strpos({s}, '<') > 0 AND strpos({s}, '@') > 0, false) "
            f"THEN string_split(string_split(string_split({s}, '<')[2], '>')[1], '@')[2] "
            f"ELSE 'Not found' END")


def is_trusted(s: str, domain: str = TEST_DOMAIN) -> str:
    return f"coalesce(({sender_domain(s)}) = {q(domain)}, false)"


def uniform(seed, name: str, key: str) -> str:
    return (f"(('0x' || substr(md5('{seed}:{name}:' || CAST({key} AS VARCHAR)), 1, 13))"
            f"::BIGINT / 4503599627370496.0)")


def words(x: str) -> str:
    t = f"regexp_replace({x}, {q('^' + PY_WS + '+|' + PY_WS + '+' + chr(92) + 'z')}, '', 'g')"
    return f"(CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({t}, {q(PY_WS + '+')}) END)"


TOKEN_RE = r"[\p{L}\p{N}]+"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(TOKEN_RE)})"


def report_sql(rel: str, y: str, p: str) -> str:
    """Classification report of relation ``rel``: common table expressions (the
    caller writes WITH) and the final select."""
    return f"""lab AS (SELECT {y} AS c FROM {rel} UNION SELECT {p} FROM {rel}),
pc AS (
  SELECT lab.c,
         (SELECT count(*) FROM {rel} WHERE {y} = lab.c) AS support,
         (SELECT count(*) FROM {rel} WHERE {p} = lab.c) AS predicted,
         (SELECT count(*) FROM {rel} WHERE {y} = lab.c AND {p} = lab.c) AS tp
  FROM lab),
cls AS (
  SELECT CAST(c AS VARCHAR) AS label,
         coalesce(tp::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
         coalesce(tp::DOUBLE / nullif(support, 0), 0.0) AS recall,
         support, tp FROM pc),
cls2 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score FROM cls),
tot AS (SELECT sum(support) AS total, sum(tp)::DOUBLE / sum(support) AS acc,
               avg(precision) AS mp, avg(recall) AS mr, avg(f1_score) AS mf,
               sum(precision * support) / sum(support) AS wp,
               sum(recall * support) / sum(support) AS wr,
               sum(f1_score * support) / sum(support) AS wf FROM cls2)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, support::BIGINT AS support FROM cls2
UNION ALL SELECT 'accuracy', NULL, NULL, round(acc, 6), total::BIGINT FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), total::BIGINT FROM tot
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), total::BIGINT FROM tot
"""
