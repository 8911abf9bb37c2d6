"""HTML text extraction (F12) and CSS-style selection.

* :func:`html_to_text` — Arrow-batched pandas UDF on the standard library's
  ``html.parser``: text of all data nodes, script/style/comments/doctype
  skipped, entities decoded.
* :func:`html_to_text_native` — the same on the JVM with regular expressions:
  tags stripped, numeric references and the named entities of HTML 4 decoded
  in one pass (references must end in ``;``, other names stay as they are).
* :func:`select_text` — texts of the elements matching a simple selector
  (``tag``, ``.cls``, ``tag.cls``, ``#id``, joined by ``>`` or space), in
  document order; an array per document.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP = {"script", "style"}
# Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}

# The named entities of the test pages, for the SQL twins (``&amp;`` last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
            ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")]

BLOCKS_RE = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<!DOCTYPE[^>]*>"
# A quoted attribute value may hold ``>``.  Nothing is tried twice, so an
# unclosed tag costs no backtracking.
TAG_RE = r"""(?s)<(?:[^>=]++|=(?:\s*(?:"[^"]*"|'[^']*'))?+)++>"""
REFERENCE = "&(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[a-zA-Z][a-zA-Z0-9]*);"
#: Code points 128 to 159 of numeric references, which mean windows-1252.
_C1 = {chr(b): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


class _TextParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in SKIP and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def text_of(html: str | None) -> str | None:
    if html is None:
        return None
    p = _TextParser()
    p.feed(html)
    p.close()
    return "".join(p.parts)


@F.pandas_udf(T.StringType())
def _html_text_udf(s: pd.Series) -> pd.Series:
    return s.map(text_of)


def html_to_text(c) -> Column:
    """F12 via the HTML parser (Arrow batches, one parser per value)."""
    return _html_text_udf(_c(c))


def html_to_text_native(c) -> Column:
    """F12 on the JVM: drop script/style/comments/doctype, strip tags, decode."""
    return decode_references(F.regexp_replace(F.regexp_replace(_c(c), BLOCKS_RE, ""), TAG_RE, ""))


def decode_references(c) -> Column:
    """Character references as characters.  The text is split before each
    reference, and every piece has its own one decoded, so what comes out is
    not decoded again."""
    names = F.create_map(*[F.lit(x) for n, p in [*name2codepoint.items(), ("apos", 0x27)] for x in (n, chr(p))])

    def char(number: Column) -> Column:
        bad = (number < 1) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        point = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
        return F.translate(point, "".join(_C1), "".join(_C1.values()))

    def piece(x: Column) -> Column:
        ref = F.regexp_extract(x, "^" + REFERENCE, 1)
        rest = F.substr(x, F.length(ref) + 3)
        number = F.when(F.lower(F.substring(ref, 1, 2)) == "#x", F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2)))
        found = F.when(F.startswith(ref, F.lit("#")), char(number.try_cast("bigint"))).otherwise(F.try_element_at(names, ref))
        return F.when(ref == "", x).otherwise(F.coalesce(F.concat(found, rest), x))
    pieces = F.split(c, f"(?={REFERENCE})")
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, piece), "")).otherwise(c)


# ------------------------------------------------------------------ selection
_SIMPLE = re.compile(r"^([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")


def parse_selector(sel: str) -> list[tuple[str, dict]]:
    """``'div.title > p'`` → ``[('', {'tag': 'div', 'cls': {'title'}}), ('>', {'tag': 'p'})]``."""
    toks = re.findall(r">|[^\s>]+", sel.strip())
    out, comb = [], ""
    for t in toks:
        if t == ">":
            comb = ">"
            continue
        m = _SIMPLE.match(t)
        if not m:
            raise ValueError(f"unsupported selector part: {t}")
        tag, rest = m.group(1), m.group(2) or ""
        spec = {"tag": tag.lower() if tag else None,
                "cls": set(re.findall(r"\.([\w-]+)", rest)),
                "id": (re.findall(r"#([\w-]+)", rest) or [None])[0]}
        out.append((comb if out else "", spec))
        comb = " "
    return out


def _match_one(spec, el) -> bool:
    tag, attrs = el
    if spec["tag"] and spec["tag"] != tag:
        return False
    if spec["cls"] and not spec["cls"] <= set((attrs.get("class") or "").split()):
        return False
    if spec["id"] and attrs.get("id") != spec["id"]:
        return False
    return True


def _matches(chain, stack) -> bool:
    """Does the last element of ``stack`` match the selector ``chain``?"""
    def rec(ci, si):
        comb, spec = chain[ci]
        if not _match_one(spec, stack[si]):
            return False
        if ci == 0:
            return True
        if comb == ">":
            return si > 0 and rec(ci - 1, si - 1)
        return any(rec(ci - 1, j) for j in range(si - 1, -1, -1))
    return rec(len(chain) - 1, len(stack) - 1)


class _SelectParser(HTMLParser):
    """One pass over a document for any number of selectors."""

    def __init__(self, chains):
        super().__init__(convert_charrefs=True)
        self.chains = chains
        self.stack: list[tuple[str, dict]] = []
        self.open: list[list[list[str]]] = []  # per stack level: collectors started there
        self.found: list[list[list[str]]] = [[] for _ in chains]
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        if tag in VOID:
            return
        self.stack.append((tag, dict(attrs)))
        started = []
        for i, chain in enumerate(self.chains):
            if _matches(chain, self.stack):
                col: list[str] = []
                self.found[i].append(col)
                started.append(col)
        self.open.append(started)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in SKIP and self.skip:
            self.skip -= 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.skip:
            return
        for level in self.open:
            for col in level:
                col.append(data)


def select_texts_many(html: str | None, selectors: list[str]) -> list[list[str]] | None:
    """Texts of the elements matching each selector, in document order."""
    if html is None:
        return None
    p = _SelectParser([parse_selector(x) for x in selectors])
    p.feed(html)
    p.close()
    return [["".join(col) for col in found] for found in p.found]


def select_texts(html: str | None, selector: str) -> list[str] | None:
    out = select_texts_many(html, [selector])
    return None if out is None else out[0]


def select_text(c, selector: str) -> Column:
    """``array<string>`` of the texts of elements matching ``selector``."""
    return select_text_many(c, [selector])[0]


def select_text_many(c, selectors: list[str]) -> Column:
    """F13 for several selectors with one parse per document:
    ``array<array<string>>``, one inner array per selector."""
    for x in selectors:
        parse_selector(x)  # fail early on the driver
    sels = list(selectors)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def _sel(s: pd.Series) -> pd.Series:
        return s.map(lambda h: select_texts_many(h, sels))
    return _sel(_c(c))
