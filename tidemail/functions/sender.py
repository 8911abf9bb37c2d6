"""Sender rules: the domain between the angle brackets and the trust flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_FOUND = "Not found"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has_brackets(s: Column) -> Column:
    return F.coalesce(s.contains("<") & s.contains("@"), F.lit(False))


def _inside(s: Column) -> Column:
    # text after the first '<' up to the next '<', then before the first '>'
    return F.get(F.split(F.get(F.split(s, "<"), 1), ">"), 0)


def sender_domain(c) -> Column:
    """Piece between the first and second '@' of the first ``<...>`` part.

    ``Not found`` when the sender lacks '<' or '@' (also for null and empty);
    null when the bracket part holds no '@' (the scorer would fail there).
    """
    s = _c(c)
    return F.when(_has_brackets(s), F.get(F.split(_inside(s), "@"), 1)).otherwise(F.lit(NOT_FOUND))


def is_trusted(c, domain: str, strict: bool = False) -> Column:
    """Exact, case-sensitive domain match.

    ``strict=True`` reads the *last* '@' piece, so ``<a@good@evil.com>`` is
    not trusted (the default keeps the original first-piece rule).
    """
    s = _c(c)
    if strict:
        piece = F.when(_has_brackets(s), F.element_at(F.split(_inside(s), "@"), -1))
        piece = F.when(F.size(F.split(_inside(s), "@")) >= 2, piece)
    else:
        piece = sender_domain(s)
    return F.coalesce(piece == F.lit(domain), F.lit(False))
