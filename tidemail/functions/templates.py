"""Small template language compiled to one Spark Column.

Supported, as used by generation plans:

* ``{{ col }}``, ``{{ s.field }}`` (struct field), ``{{ col.split()[i] }}``
  (``i`` may be negative), filters ``| lower``, ``| upper``, ``| trim``,
  ``| int``, ``| string``
* ``{% if <cond> %} … {% elif <cond> %} … {% else %} … {% endif %}`` where
  ``<cond>`` is ``expr op literal`` (``< <= > >= == !=``), or ``expr``, joined
  by ``and`` / ``or``

The template is compiled once on the driver into ``concat``/``when``
expressions; rows are never rendered in Python.  A reference to a missing
value (null, or a word index past the end) makes the whole result null, so
the generator can route the row to its reject output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemail.functions.text import PY_WS, word_at, words

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_REF = re.compile(r"^\s*([A-Za-z_]\w*)((?:\.[A-Za-z_]\w*)*)(\.split\(\))?(?:\[(-?\d+)\])?\s*$")
_CMP = re.compile(r"^(.*?)\s*(<=|>=|==|!=|<|>)\s*(.*?)$")


class TemplateError(ValueError):
    pass


@dataclass
class Template:
    source: str
    refs: set[str] = field(default_factory=set)

    def __post_init__(self):
        self._nodes = _parse(self.source)
        _collect_refs(self._nodes, self.refs)

    def column(self, fields: dict[tuple[str, str], str] | None = None) -> Column:
        """``fields`` names the columns that hold fields of structs."""
        return _render(self._nodes, fields or {})


def _parse(src: str):
    pos, root = 0, []
    stack = [("root", root, None)]  # (kind, current list, if-node)
    for m in _TAG.finditer(src):
        if m.start() > pos:
            stack[-1][1].append(("text", src[pos:m.start()]))
        pos = m.end()
        if m.group(1) is not None:
            stack[-1][1].append(("expr", m.group(1).strip()))
            continue
        stmt = m.group(2).strip()
        if stmt.startswith("if "):
            node = ["if", [(stmt[3:].strip(), [])], None]
            stack[-1][1].append(node)
            stack.append(("if", node[1][0][1], node))
        elif stmt.startswith("elif "):
            _, _, node = stack.pop()
            if node is None:
                raise TemplateError("elif outside if")
            node[1].append((stmt[5:].strip(), []))
            stack.append(("if", node[1][-1][1], node))
        elif stmt == "else":
            _, _, node = stack.pop()
            if node is None:
                raise TemplateError("else outside if")
            node[2] = []
            stack.append(("if", node[2], node))
        elif stmt == "endif":
            kind, _, _ = stack.pop()
            if kind != "if":
                raise TemplateError("endif without if")
        else:
            raise TemplateError(f"unsupported statement: {stmt}")
    if len(stack) != 1:
        raise TemplateError("unclosed if")
    if pos < len(src):
        root.append(("text", src[pos:]))
    return root


def _split_filters(expr: str):
    parts = [p.strip() for p in expr.split("|")]
    return parts[0], parts[1:]


def _ref_name(expr: str):
    m = _REF.match(expr)
    return m.group(1) if m else None


def _collect_refs(nodes, acc: set):
    for n in nodes:
        if n[0] == "expr":
            base, _ = _split_filters(n[1])
            name = _ref_name(base)
            if name:
                acc.add(name)
        elif n[0] == "if":
            for cond, body in n[1]:
                for atom in re.split(r"\s+(?:and|or)\s+", cond):
                    m = _CMP.match(atom)
                    left = m.group(1) if m else atom
                    name = _ref_name(_split_filters(left)[0].removeprefix("not ").strip())
                    if name:
                        acc.add(name)
                _collect_refs(body, acc)
            if n[2] is not None:
                _collect_refs(n[2], acc)


def _value(expr: str, fields: dict) -> Column:
    base, filters = _split_filters(expr)
    lit = _literal(base)
    if lit is not None:
        col = F.lit(lit)
    else:
        m = _REF.match(base)
        if not m:
            raise TemplateError(f"unsupported expression: {base}")
        name, attrs, split, idx = m.groups()
        path = [a for a in (attrs or "").split(".") if a]
        held = fields.get((name, path[0])) if path else None
        col = F.col(held or name)
        for a in path[1 if held else 0:]:
            col = col.getField(a)
        if split and idx is not None:
            col = word_at(col, int(idx))
        elif split:
            col = words(col)
        elif idx is not None:
            i = int(idx)
            col = F.get(col, i) if i >= 0 else F.element_at(col, i)
    for f in filters:
        if f == "lower":
            col = F.lower(col)
        elif f == "upper":
            col = F.upper(col)
        elif f == "trim":
            col = F.regexp_replace(col.cast("string"), rf"^{PY_WS}+|{PY_WS}+\z", "")
        elif f == "int":
            col = col.cast("string").try_cast("int")
        elif f == "string":
            col = col.cast("string")
        else:
            raise TemplateError(f"unsupported filter: {f}")
    return col


def _literal(s: str):
    s = s.strip()
    if re.fullmatch(r"-?\d+", s):
        return int(s)
    if re.fullmatch(r"-?\d+\.\d*", s):
        return float(s)
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1]
    if s in ("True", "False"):
        return s == "True"
    return None


def _cond(cond: str, fields: dict) -> Column:
    ors = re.split(r"\s+or\s+", cond)
    out = None
    for o in ors:
        conj = None
        for atom in re.split(r"\s+and\s+", o):
            atom = atom.strip()
            neg = atom.startswith("not ")
            atom = atom[4:] if neg else atom
            m = _CMP.match(atom)
            if m:
                a, op, b = _value(m.group(1), fields), m.group(2), _value(m.group(3), fields)
                c = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
            else:
                c = _value(atom, fields).cast("boolean")
            c = ~c if neg else c
            conj = c if conj is None else (conj & c)
        out = conj if out is None else (out | conj)
    return out


def _as_text(col: Column) -> Column:
    return col.cast("string")


def _render(nodes, fields: dict) -> Column:
    parts = []
    for n in nodes:
        if n[0] == "text":
            parts.append(F.lit(n[1]))
        elif n[0] == "expr":
            parts.append(_as_text(_value(n[1], fields)))
        else:
            branches, orelse = n[1], n[2]
            default = _render(orelse, fields) if orelse is not None else F.lit("")
            expr = None
            for cond, body in branches:
                c = _cond(cond, fields)
                # an undecidable condition (null operand) fails the row: null result
                expr = F.when(c.isNull(), F.lit(None).cast("string")) if expr is None else expr.when(
                    c.isNull(), F.lit(None).cast("string"))
                expr = expr.when(c, _render(body, fields))
            parts.append(expr.otherwise(default))
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def render(template: str) -> Column:
    """Compile ``template`` into a Column."""
    return Template(template).column()


def references(template: str) -> set[str]:
    return Template(template).refs
