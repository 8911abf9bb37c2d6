"""Text columns: mail text assembly, JS-style cleaning, words, snippets.

All functions return native Column expressions (whole-stage codegen, no
Python per row).  Regular expressions are written so that Java regex and RE2
(DuckDB) read them the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The JavaScript ``\s`` / ``trim`` whitespace class.
JS_WS = (r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")

# Characters Python's ``str.split()`` treats as whitespace.
PY_WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# Strings pandas ``read_csv`` turns into missing values by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- P2/P3/P5
def training_text(subject, body) -> Column:
    """``fillna('') + ' ' + fillna('')`` — the space stays when a part is missing."""
    return F.concat(F.coalesce(_c(subject), F.lit("")), F.lit(" "),
                    F.coalesce(_c(body), F.lit("")))


def body_text(body) -> Column:
    return F.coalesce(_c(body), F.lit(""))


def scoring_text(subject, body) -> Column:
    """``f"{subject} {body}"`` on already validated (non-null) fields."""
    return F.concat(_c(subject), F.lit(" "), _c(body))


# ---------------------------------------------------------------- F1-F4
def or_default(c, text: str) -> Column:
    """Fallback when the value is null or empty (checked before trimming)."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(text))


# The same class as a plain character set, for set-wise trimming.
JS_WS_CHARS = ("\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")


def js_trim(c) -> Column:
    """JS ``trim``: strip the whitespace class at both ends (set-wise, no regex)."""
    return F.trim(_c(c), F.lit(JS_WS_CHARS))


def collapse_newlines(c) -> Column:
    col = _c(c)
    # the regex pass only runs on values that hold a blank line
    return F.when(F.instr(col, "\n\n") > 0, F.regexp_replace(col, r"\n{2,}", "\n")).otherwise(col)


def collapse_ws(c) -> Column:
    return F.regexp_replace(_c(c), rf"{JS_WS}{{2,}}", " ")


def clean_body(c) -> Column:
    """Newline runs → one newline, whitespace runs → one space, then trim."""
    return js_trim(collapse_ws(collapse_newlines(c)))


def na_to_null(c, tokens: list[str] | None = None) -> Column:
    """The default missing-value strings of pandas become null."""
    col = _c(c)
    return F.when(~col.isin(tokens or NA_TOKENS), col)


# ---------------------------------------------------------------- F14/F17
# The same class as a plain character set, for set-wise trimming.
PY_WS_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u0085\u00a0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def words(c) -> Column:
    """``str.split()``: runs of whitespace, no empty words at either end."""
    t = F.trim(_c(c), F.lit(PY_WS_CHARS))
    return F.array_remove(F.split(t, PY_WS + "+"), "")


def word_at(c, i: int) -> Column:
    """Word ``i`` (0-based; negative counts from the end); null when absent."""
    w = words(c)
    if i >= 0:
        return F.get(w, i)
    return F.try_element_at(w, F.lit(i))


def staff_email(c, domain: str) -> Column:
    """Second word + '.' + last word + '@' + domain, lower case; null when short."""
    return F.lower(F.concat(word_at(c, 1), F.lit("."), word_at(c, -1), F.lit("@" + domain)))


# ---------------------------------------------------------------- F18
def snippet(c, n: int = 500) -> Column:
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def escape_html(c) -> Column:
    col = F.replace(_c(c), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


# ---------------------------------------------------------------- tokens
TOKEN_RE = r"[\p{L}\p{N}]+"


def tokens(c) -> Column:
    """Lower-case word tokens (letters and digits); the tokenizer of K1/K2/A9."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_RE), 0)


def token_count(c) -> Column:
    return F.size(tokens(c))
