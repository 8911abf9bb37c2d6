"""URL gates (P7, P8): plain column predicates, pushed into the scan's filter; a
table of patterns is joined by the literal end of their hosts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gate_by_url(df: DataFrame, url_col: str, needle: str,
                message: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(kept, refused)``; kept iff the URL contains ``needle``
    (case-sensitive).  Refused rows carry a fixed ``message``; a null URL is
    refused."""
    hit = F.coalesce(F.col(url_col).contains(needle), F.lit(False))
    msg = message or f"URL outside {needle}"
    return df.filter(hit), df.filter(~hit).withColumn("message", F.lit(msg))


def pattern_regex(pattern: str) -> str:
    """``scheme://host/path`` wildcard pattern → anchored regex.  ``*`` is any
    run in the path, and any run without a slash in scheme and host."""
    scheme, sep, rest = pattern.partition("://")
    host, slash, path = rest.partition("/") if sep else (scheme, "", "")

    def part(x: str, run: str) -> str:
        return run.join(re.escape(y) for y in x.split("*"))
    if not sep:
        return "^" + part(pattern, ".*") + "$"
    return "^" + part(scheme, "[^/:]*") + re.escape(sep) + part(host, "[^/?#@]*") + slash + part(path, ".*") + "$"


def match_patterns(url, patterns: list[str]) -> Column:
    """True iff the URL matches one of the allow-list patterns."""
    col = _c(url)
    cond = None
    for p in patterns:
        c = col.rlike(pattern_regex(p))
        cond = c if cond is None else (cond | c)
    return F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(False)


#: Most patterns whose host does not end in a literal label.
MAX_OPEN = 1000


def host_key(pattern: str) -> str:
    """The literal labels at the end of a pattern's host: what every URL that
    matches must end its host with ("" for none)."""
    _, sep, rest = pattern.partition("://")
    labels = rest.partition("/")[0].split(".") if sep else ["*"]
    wild = max((i for i, x in enumerate(labels) if "*" in x), default=-1)
    return ".".join(labels[wild + 1:])


def match_pattern_table(df: DataFrame, url_col: str, patterns: DataFrame, pattern_col: str = "pattern", out: str = "allowed") -> DataFrame:
    """P8 for allow-lists of any size: ``df`` with ``out``, true iff the URL matches
    a pattern of the table, as :func:`match_patterns` would say.

    Patterns are keyed by the literal end of their host, and each different URL by
    every end of its own, so an equi-join finds the few patterns that can match;
    their regular expressions decide.  Patterns without such an end (``https://m.*/``)
    can match any host; they are a chain, and more than ``MAX_OPEN`` of them an error."""
    def keyed(batches):
        for pdf in batches:
            held = pdf["pattern"].dropna()
            yield pdf.iloc[:0].assign(key="", regex="").reindex(columns=["key", "regex", "pattern"]) if held.empty else \
                held.to_frame().assign(key=held.map(host_key), regex=held.map(pattern_regex))[["key", "regex", "pattern"]]

    known = patterns.select(F.col(pattern_col).alias("pattern")).distinct().mapInPandas(keyed, "key string, regex string, pattern string")
    chain = [r.pattern for r in known.where("key = ''").limit(MAX_OPEN + 1).collect()]
    if len(chain) > MAX_OPEN:
        raise ValueError(f"more than {MAX_OPEN} patterns have a host without a literal end")
    urls = df.select(F.col(url_col).alias("__url")).where(F.col("__url").isNotNull()).distinct()
    labels = F.split(F.regexp_extract("__url", "^[^:/]*://([^/]*)", 1), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = (urls.withColumn("__key", F.explode(ends)).join(known.where("key <> ''"), F.col("__key") == F.col("key"))
            .where(F.rlike(F.col("__url"), F.col("regex"))).select("__url").distinct().withColumn("__hit", F.lit(True)))
    return (df.join(hits, F.col(url_col) == F.col("__url"), "left")
            .select(*df.columns, (F.coalesce("__hit", F.lit(False)) | match_patterns(url_col, chain)).alias(out)))
