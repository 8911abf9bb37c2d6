"""A declared schema as a check of JSON values.

``from_json`` takes what it can: it turns 5 into "5", a missing field into null,
and an object without any declared field into a struct of nulls.  Here the schema
becomes a recursive check of the parsed VARIANT: every declared field must be
there, of the declared type and inside its rule, at every depth; fields that
are not declared are ignored.  All of it is one native expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """What a field's value must be besides its type.  ``low`` and ``high`` bound
    numbers, and the lengths of strings and arrays; a field that is not
    ``required`` may be missing or null."""
    required: bool = True
    low: float | None = None
    high: float | None = None
    choices: tuple | None = None


class SchemaError(ValueError):
    pass


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def struct_type(schema: str | T.StructType) -> T.StructType:
    """The schema of a structured value, from its DDL."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not isinstance(kind, T.StructType) or not kind.fields:
        raise SchemaError("a structured value needs at least one field")
    return kind


def validate(kind: T.DataType, rules: dict[str, Rule], at: str = "") -> None:
    """Raise unless every type can be checked and every rule has its field."""
    known = _paths(kind, at)
    for path in rules:
        if path not in known:
            raise SchemaError(f"no field {path}")


def _paths(kind: T.DataType, at: str) -> set[str]:
    if isinstance(kind, T.StructType):
        out = set()
        for f in kind.fields:
            if any(c in f.name for c in "'\"\\[].`"):
                raise SchemaError(f"field name {f.name!r}")
            path = f"{at}.{f.name}" if at else f.name
            out |= {path} | _paths(f.dataType, path)
        return out
    if isinstance(kind, T.ArrayType):
        return {at + "[]"} | _paths(kind.elementType, at + "[]")
    if not isinstance(kind, (T.StringType, T.BooleanType, *_WHOLE, *_REAL)):
        raise SchemaError(f"{at}: {kind.simpleString()} cannot be checked")
    return set()


def _type_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _get(v: Column, ddl: str) -> Column:
    return F.try_variant_get(v, "$", ddl)


def _typed(v: Column, kind: T.DataType) -> Column:
    """Is the value of the type?  A whole number fits its width; a real one may
    be written as a whole number."""
    name = _type_of(v)
    if isinstance(kind, T.StringType):
        return name == "STRING"
    if isinstance(kind, T.BooleanType):
        return name == "BOOLEAN"
    if isinstance(kind, _WHOLE):
        return (name == "BIGINT") & _get(v, kind.simpleString()).isNotNull()
    if isinstance(kind, _REAL):
        return ((name == "BIGINT") | (name == "DOUBLE") | name.startswith("DECIMAL")) & _get(v, kind.simpleString()).isNotNull()
    return name.startswith("OBJECT" if isinstance(kind, T.StructType) else "ARRAY")


def _ruled(v: Column, kind: T.DataType, rule: Rule) -> list[tuple[Column, str]]:
    """(condition, complaint) pairs of a value of the right type."""
    out = []
    if isinstance(kind, T.StringType):
        size, unit = F.length(_get(v, "string")), "length "
    elif isinstance(kind, T.ArrayType):
        size, unit = F.size(_get(v, "array<variant>")), "length "
    else:
        size, unit = _get(v, kind.simpleString()), ""
    if rule.low is not None:
        out.append((size < rule.low, f"{unit}under {rule.low}"))
    if rule.high is not None:
        out.append((size > rule.high, f"{unit}over {rule.high}"))
    if rule.choices is not None:
        out.append((~_get(v, kind.simpleString()).isin(*rule.choices), "not a choice"))
    return out


def problem(v: Column, kind: T.DataType, rules: dict[str, Rule] | None = None, at: str = "") -> Column:
    """The first complaint about a VARIANT value as ``path: complaint``, in the
    order of the fields, depth first; null for a value that fits."""
    rules = rules or {}
    rule = rules.get(at, Rule())
    here = at or "value"
    label = F.lit(f"{here}: ")
    absent = _type_of(v) == "VOID"
    found = F.when(absent, F.concat(label, F.lit("missing")) if rule.required else F.lit(None).cast("string"))
    found = found.when(~_typed(v, kind), F.concat(label, F.lit(f"not {kind.simpleString() if not isinstance(kind, T.StructType) else 'an object'}")))
    for bad, complaint in _ruled(v, kind, rule) if rule != Rule(required=rule.required) else []:
        found = found.when(F.coalesce(bad, F.lit(False)), F.concat(label, F.lit(complaint)))
    if isinstance(kind, T.StructType):
        inner = [problem(F.try_variant_get(v, f"$['{f.name}']", "variant"), f.dataType, rules, f"{at}.{f.name}" if at else f.name) for f in kind.fields]
        return found.otherwise(F.coalesce(*inner))
    if isinstance(kind, T.ArrayType):
        each = F.transform(_get(v, "array<variant>"), lambda e: problem(e, kind.elementType, rules, at + "[]"))
        return found.otherwise(F.get(F.array_compact(each), F.lit(0)))
    return found


def complaint(v: Column, text: Column, schema: str | T.StructType, rules: dict[str, Rule] | None = None) -> Column:
    """The first complaint about a JSON text whose parsed VARIANT is ``v``; null
    where it fits."""
    return (F.when(text.isNull(), F.lit("missing")).when(v.isNull(), F.lit("invalid json"))
            .otherwise(problem(v, struct_type(schema), rules)))


def value(v: Column, schema: str | T.StructType) -> Column:
    """The struct of a VARIANT without complaint."""
    return F.try_variant_get(v, "$", struct_type(schema).simpleString())
