"""Declarative synthetic-table generator.

A :class:`Plan` is an ordered set of named column specs.  ``create`` turns it
into one DataFrame: row ids come from ``spark.range(n)`` or from the key of an
existing table (``create_from``), and every column is a native expression of
earlier columns and a deterministic draw ``u(seed, column, row_id)``.  The
result therefore does not depend on partitioning or retries and has a SQL twin.

Text columns (G7/G8) whose content comes from an external generator run in
``mapInPandas`` with one client per task and a bounded number of parallel
calls; a failed or timed-out call yields null and the row goes to the reject
output instead of the table (G11).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.functions import json_schema as js
from tidemail.functions.rand import uniform
from tidemail.functions.templates import Template
from tidemail.operators.rows import keep_rows  # noqa: F401  (re-exported)
from tidemail.plans.journal import Journal, call_digest


class PlanError(ValueError):
    pass


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ------------------------------------------------------------------ samplers
@dataclass
class Category:
    """G1/G2 (G9 with ``when``): values drawn uniformly or by weight.

    ``when`` maps a Spark SQL condition over earlier columns to an alternative
    ``Category`` used for rows where the condition holds (first match wins).
    """
    values: list
    weights: list[float] | None = None
    when: dict[str, "Category"] = field(default_factory=dict)
    kind: str = "category"

    def refs(self) -> set[str]:
        out = set()
        for cond, alt in self.when.items():
            out |= _sql_refs(cond)
            out |= alt.refs()
        return out

    def validate(self, name: str):
        if not self.values:
            raise PlanError(f"{name}: no values")
        if self.weights is not None:
            if len(self.weights) != len(self.values):
                raise PlanError(f"{name}: {len(self.weights)} weights for {len(self.values)} values")
            if any(w < 0 for w in self.weights) or sum(self.weights) <= 0:
                raise PlanError(f"{name}: weights must be non-negative with a positive sum")
        for alt in self.when.values():
            alt.validate(name)

    def all_values(self) -> set[str]:
        """Every value the column can take, as text."""
        return set(map(str, self.values)).union(*(alt.all_values() for alt in self.when.values()))

    def thresholds(self) -> list[float]:
        w = self.weights or [1.0] * len(self.values)
        tot, acc, out = float(sum(w)), 0.0, []
        for x in w[:-1]:
            acc += x
            out.append(acc / tot)
        return out

    def _plain(self, u: Column) -> Column:
        if self.weights is None:
            return F.element_at(_lit_array(self.values), (F.floor(u * len(self.values)) + 1).cast("int"))
        expr = None
        for t, v in zip(self.thresholds(), self.values):
            expr = F.when(u < F.lit(t), F.lit(v)) if expr is None else expr.when(u < F.lit(t), F.lit(v))
        last = F.lit(self.values[-1])
        return last if expr is None else expr.otherwise(last)

    def column(self, u: Column, ctx) -> Column:
        out = self._plain(u)
        for cond, alt in reversed(list(self.when.items())):
            out = F.when(F.expr(cond), alt.column(u, ctx)).otherwise(out)
        return out


@dataclass
class Subcategory:
    """Values drawn uniformly from the list of the parent's value."""
    parent: str
    values: dict
    kind: str = "subcategory"

    def refs(self):
        return {self.parent}

    def validate(self, name: str):
        if not self.values or any(not v for v in self.values.values()):
            raise PlanError(f"{name}: every parent value needs a non-empty list")

    def column(self, u: Column, ctx) -> Column:
        m = F.create_map(*[x for k, v in self.values.items() for x in (F.lit(k), _lit_array(v))])
        arr = F.element_at(m, F.col(self.parent).cast("string"))
        return F.element_at(arr, (F.floor(u * F.size(arr)) + 1).cast("int"))


#: Most rows of a table of values (its cumulative weights are one window).
MAX_VALUES = 5_000_000


def _bounded(table: DataFrame, name: str) -> int:
    n = table.count()
    if not 0 < n <= MAX_VALUES:
        raise PlanError(f"{name}: a table of {n} values; it must have 1 to {MAX_VALUES}")
    return n


@dataclass
class CategoryTable:
    """G1/G2 with the values in a table: drawn uniformly or by ``weight``.

    The draws are those of :class:`Category` with the values in ascending order, but
    the plan does not grow with them.  Each value holds an interval of [0, 1); a
    guide of as many equal cells as there are values names the values of each
    cell, so a row meets the few of its cell in an equi-join and keeps the one that
    holds its draw.  Draws are uniform over the cells, so no cell is hot; adaptive
    execution broadcasts the guide where it is measured to be small."""
    table: DataFrame
    value: str
    weight: str | None = None
    kind: str = "category"

    def refs(self):
        return set()

    def validate(self, name: str):
        for c in (self.value, self.weight):
            if c is not None and c not in self.table.columns:
                raise PlanError(f"{name}: no column {c} in its table")

    def attach(self, df: DataFrame, name: str, u: Column) -> DataFrame:
        weight = F.lit(1) if self.weight is None else F.col(self.weight)
        # a value listed twice has the sum of its weights; without weight it is not drawn
        values = (self.table.select(F.col(self.value).alias("__value"), weight.alias("__w"))
                  .groupBy("__value").agg(F.sum("__w").alias("__w")).filter((F.col("__w") > 0) & F.col("__value").isNotNull()))
        n = _bounded(values, name)
        order = Window.orderBy("__value")
        upto = F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
        total = F.sum("__w").over(Window.partitionBy()).cast("double")
        held = (values.withColumns({"__upto": upto, "__total": total})
                .select("__value", (F.coalesce(F.lag("__upto").over(order), F.lit(0.0)) / F.col("__total")).alias("__low"),
                        (F.col("__upto") / F.col("__total")).alias("__high")))
        cell = lambda x: F.floor(x * F.lit(float(n))).cast("bigint")  # noqa: E731 — rises with x, so a draw's cell is among its value's
        guide = held.withColumn("__cell", F.explode(F.sequence(cell(F.col("__low")), F.least(cell(F.col("__high")), F.lit(n - 1).cast("bigint")))))
        drawn = df.withColumn("__u", u).withColumn("__at", cell(F.col("__u")))
        met = drawn.join(guide, (F.col("__at") == F.col("__cell")) & (F.col("__u") >= F.col("__low")) & (F.col("__u") < F.col("__high")), "left")
        return met.select(*df.columns, F.col("__value").alias(name))


@dataclass
class SubcategoryTable:
    """G3 with the lists in a table: a value drawn uniformly from the rows whose
    ``parent_column`` is the parent's value; null, so a rejected row, where there are
    none.  Values are numbered in ascending order within their parent."""
    parent: str
    table: DataFrame
    parent_column: str
    value: str
    kind: str = "subcategory"

    def refs(self):
        return {self.parent}

    def validate(self, name: str):
        for c in (self.parent_column, self.value):
            if c not in self.table.columns:
                raise PlanError(f"{name}: no column {c} in its table")

    def attach(self, df: DataFrame, name: str, u: Column) -> DataFrame:
        values = self.table.select(F.col(self.parent_column).alias("__parent"), F.col(self.value).alias("__value"))
        _bounded(values, name)
        numbered = values.withColumn("__i", F.row_number().over(Window.partitionBy("__parent").orderBy("__value")) - 1)
        sizes = values.groupBy("__parent").agg(F.count(F.lit(1)).alias("__size"))
        drawn = df.withColumn("__u", u).join(sizes, F.col(self.parent) == F.col("__parent"), "left").drop("__parent")
        drawn = drawn.withColumn("__at", F.floor(F.col("__u") * F.col("__size")).cast("int"))
        met = drawn.join(numbered, (F.col(self.parent) == F.col("__parent")) & (F.col("__at") == F.col("__i")), "left")
        return met.select(*df.columns, F.col("__value").alias(name))


@dataclass
class Uniform:
    """Number in [low, high]; ``convert_to='int'`` rounds to an integer."""
    low: float
    high: float
    convert_to: str | None = None
    kind: str = "uniform"

    def refs(self):
        return set()

    def validate(self, name: str):
        if self.high < self.low:
            raise PlanError(f"{name}: high < low")

    def column(self, u: Column, ctx) -> Column:
        x = F.lit(float(self.low)) + u * F.lit(float(self.high - self.low))
        if self.convert_to == "int":
            return F.round(x).cast("bigint")
        return x


# Small built-in pools for synthetic persons (visibly fake).
FIRST_NAMES = ["Avery", "Blake", "Casey", "Devon", "Emery", "Finley", "Harper", "Jordan",
               "Kendall", "Logan", "Morgan", "Parker", "Quinn", "Riley", "Rowan", "Sawyer",
               "Skyler", "Taylor", "Reese", "Jamie"]
MIDDLE_NAMES = ["Lee", "Ray", "Jo", "Ann", "Kai", "Sky", "Max", "Sam"]
LAST_NAMES = ["Alder", "Birch", "Cedar", "Dunmore", "Elmwood", "Fairfax", "Glenn", "Hollis",
              "Ivers", "Jarvis", "Kingsley", "Lowell", "Merritt", "Norwood", "Oakley", "Prescott",
              "Quimby", "Radley", "Stroud", "Thorne"]
CITIES = [("Springfield", "IL", "Sangamon"), ("Riverton", "WY", "Fremont"), ("Fairview", "OR", "Multnomah"),
          ("Greenville", "SC", "Greenville"), ("Madison", "WI", "Dane"), ("Franklin", "TN", "Williamson"),
          ("Clinton", "IA", "Clinton"), ("Salem", "MA", "Essex")]
STREETS = ["Maple Ave", "Oak St", "Pine Rd", "Cedar Ln", "Elm Dr", "Lake Blvd", "Hill Ct", "Park Way"]
OCCUPATIONS = ["student", "teaching assistant", "lab technician", "library aide", "research intern",
               "barista", "tutor", "cashier"]
EDUCATION = ["high school", "some college", "associate", "bachelors", "masters", "doctorate"]
FIELDS = ["biology", "business", "computer science", "education", "engineering", "arts", "none"]
MARITAL = ["never married", "married", "divorced", "widowed"]
ETHNIC = ["group a", "group b", "group c", "group d", "group e"]
SEXES = ["Female", "Male"]


@dataclass
class Person:
    """Struct of 24 person fields; ``age`` uniform in ``age_range``
    (inclusive), ``birth_date`` consistent with the age at ``as_of``."""
    locale: str = "en_US"
    age_range: tuple[int, int] = (18, 70)
    as_of: str = "2025-01-01"
    kind: str = "person"

    def refs(self):
        return set()

    def validate(self, name: str):
        if self.age_range[1] < self.age_range[0]:
            raise PlanError(f"{name}: empty age range")

    def column(self, u: Column, ctx) -> Column:
        return F.struct(*[c.alias(n) for n, c in self.fields(ctx).items()])

    def fields(self, ctx) -> dict[str, Column]:
        """The person's fields by name."""
        name, seed, key = ctx["name"], ctx["seed"], ctx["key"]

        def draw(f):
            return uniform(seed, f"{name}.{f}", key)

        def pick(f, pool):
            return F.element_at(_lit_array(pool), (F.floor(draw(f) * len(pool)) + 1).cast("int"))

        lo, hi = self.age_range
        age = (F.lit(lo) + F.floor(draw("age") * (hi - lo + 1))).cast("bigint")
        birth = F.date_sub(F.add_months(F.lit(self.as_of).cast("date"), (-12 * age).cast("int")),
                           (F.floor(draw("birthday") * 364) + 1).cast("int"))
        city = F.floor(draw("city") * len(CITIES)).cast("int") + 1
        first, last = pick("first_name", FIRST_NAMES), pick("last_name", LAST_NAMES)
        h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(name + ".uuid"), key.cast("string")))

        def digits(f, n):
            return F.lpad(F.floor(draw(f) * (10 ** n)).cast("bigint").cast("string"), n, "0")

        return {
            "age": age,
            "bachelors_field": pick("bachelors_field", FIELDS),
            "birth_date": F.date_format(birth, "yyyy-MM-dd"),
            "city": F.element_at(_lit_array([c[0] for c in CITIES]), city),
            "country": F.lit("USA"),
            "county": F.element_at(_lit_array([c[2] for c in CITIES]), city),
            "education_level": pick("education_level", EDUCATION),
            "email_address": F.lower(F.concat(first, F.lit("."), last, F.lit("@example.com"))),
            "ethnic_background": pick("ethnic_background", ETHNIC),
            "first_name": first,
            "last_name": last,
            "locale": F.lit(self.locale),
            "marital_status": pick("marital_status", MARITAL),
            "middle_name": pick("middle_name", MIDDLE_NAMES),
            "occupation": pick("occupation", OCCUPATIONS),
            "phone_number": F.concat(F.lit("555-01"), digits("phone", 2)),
            "sex": pick("sex", SEXES),
            "ssn": F.concat(F.lit("000-"), digits("ssn_a", 2), F.lit("-"), digits("ssn_b", 4)),
            "state": F.element_at(_lit_array([c[1] for c in CITIES]), city),
            "street_name": pick("street_name", STREETS),
            "street_number": (F.floor(draw("street_number") * 9000) + 100).cast("bigint"),
            "unit": F.when(draw("unit") < 0.3, F.concat(F.lit("Apt "), digits("unit_no", 2))),
            "uuid": F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                                F.substring(h, 17, 4), F.substring(h, 21, 12)),
            "zipcode": digits("zipcode", 5),
        }


@dataclass
class Expr:
    """Template over earlier columns; ``dtype`` casts the text (null if it
    does not parse)."""
    template: str
    dtype: str | None = None
    kind: str = "expression"

    def refs(self):
        return Template(self.template).refs

    def validate(self, name: str):
        Template(self.template)

    def column(self, u: Column, ctx) -> Column:
        c = Template(self.template).column(ctx.get("fields"))
        return c.try_cast(self.dtype) if self.dtype else c


@dataclass(frozen=True)
class Inference:
    """What a generator is told about how to write a text column."""
    system_prompt: str | None = None
    temperature: float = 0.9
    top_p: float = 1.0
    max_tokens: int | None = None


#: Called once per task with the column's Inference; gives the text of one prompt.
Generator = Callable[[Inference], Callable[[str], str | None]]
#: Mistakes in a generator's code: they fail the task and reject no row.
_BUGS = (TypeError, NameError, AttributeError, ImportError, AssertionError, SyntaxError)


@dataclass
class Text:
    """Text column from a prompt template.

    * ``response`` (a template) — offline, native: the text is rendered in the
      JVM like an expression column.
    * ``generator`` — a factory called once per task with the column's
      :class:`Inference`; it returns ``fn(prompt) -> text``.  Up to
      ``max_parallel`` calls run at once, each for at most ``timeout`` seconds
      from its own start; a failed or late call gives null (the row is
      rejected), a mistake in the generator's code fails the task.
    """
    prompt: str
    system_prompt: str | None = None
    response: str | None = None
    generator: Generator | None = None
    max_parallel: int = 4
    timeout: float = 45.0
    temperature: float = 0.9
    top_p: float = 1.0
    max_tokens: int | None = None
    kind: str = "llm-text"

    def refs(self):
        r = Template(self.prompt).refs
        if self.response:
            r |= Template(self.response).refs
        return r

    def validate(self, name: str):
        Template(self.prompt)
        if self.response is None and self.generator is None:
            raise PlanError(f"{name}: a text column needs a response or a generator")
        if self.response:
            Template(self.response)

    def prompt_column(self) -> Column:
        return Template(self.prompt).column()

    def column(self, u: Column, ctx) -> Column:
        if self.generator is not None:
            return F.lit(None).cast("string")  # filled by the mapInPandas stage
        return Template(self.response).column(ctx.get("fields"))


@dataclass
class Structured(Text):
    """Like :class:`Text` but the output is JSON of the declared ``schema`` (DDL).
    Every field must be there and of its type, at every depth; ``rules`` bound
    fields further or make them optional, by path (``price``, ``sub.n``,
    ``tags[]``).  Other text gives null and the row is rejected with the first
    complaint."""
    schema: str = ""
    rules: dict[str, js.Rule] = field(default_factory=dict)
    kind: str = "llm-structured"

    def validate(self, name: str):
        super().validate(name)
        try:
            js.validate(js.struct_type(self.schema), self.rules)
        except js.SchemaError as ex:
            raise PlanError(f"{name}: {ex}") from ex


# ------------------------------------------------------------------ plan
@dataclass
class ColumnSpec:
    name: str
    sampler: object
    drop: bool = False


def _sql_refs(cond: str) -> set[str]:
    """Identifiers of a SQL condition (quoted literals and function names skipped)."""
    import re
    bare = re.sub(r"'(?:[^']|'')*'", "''", cond)
    words = set(re.findall(r"(?<![\w.])([A-Za-z_]\w*)(?![\w(])", bare))
    return {w for w in words if w.upper() not in {"AND", "OR", "NOT", "IN", "IS", "NULL", "TRUE",
                                                  "FALSE", "LIKE", "BETWEEN"}}


def _why(name: str) -> str:
    return f"__why_{name}"


class Plan:
    """Ordered column specs → DataFrame."""

    def __init__(self, specs: list[ColumnSpec] | None = None):
        self.specs: list[ColumnSpec] = list(specs or [])

    def add(self, name: str, sampler, drop: bool = False) -> "Plan":
        if any(s.name == name for s in self.specs):
            raise PlanError(f"duplicate column {name}")
        self.specs.append(ColumnSpec(name, sampler, drop))
        return self

    # G10
    def validate(self, external: set[str] | None = None) -> list[ColumnSpec]:
        """Check references, cycles, weights and parent coverage; return the
        specs in dependency order."""
        names = {s.name for s in self.specs}
        ext = set(external or set())
        by_name = {s.name: s for s in self.specs}
        for s in self.specs:
            s.sampler.validate(s.name)
            unknown = {r for r in s.sampler.refs() if r not in names and r not in ext}
            if unknown:
                raise PlanError(f"{s.name}: unknown column(s) {sorted(unknown)}")
            if isinstance(s.sampler, Subcategory):
                parent = by_name.get(s.sampler.parent)
                if parent is not None and isinstance(parent.sampler, Category):
                    missing = parent.sampler.all_values() - set(map(str, s.sampler.values))
                    if missing:
                        raise PlanError(f"{s.name}: no values for parent value(s) {sorted(missing)}")
        order, state = [], {}

        def visit(n, path):
            if state.get(n) == 2:
                return
            if state.get(n) == 1:
                raise PlanError(f"cycle: {' -> '.join(path + [n])}")
            state[n] = 1
            for r in sorted(by_name[n].sampler.refs()):
                if r in by_name:
                    visit(r, path + [n])
            state[n] = 2
            order.append(by_name[n])

        for s in self.specs:
            visit(s.name, [])
        return order

    def kinds(self) -> dict[str, tuple[str, str | None]]:
        out = {}
        for s in self.specs:
            k = s.sampler.kind
            if k in ("category", "subcategory", "uniform", "person"):
                out[s.name] = ("sampler", k)
            elif k == "expression":
                out[s.name] = ("expression", None)
            else:
                out[s.name] = (k, None)
        return out

    def side_effect_columns(self) -> list[str]:
        return [s.name for s in self.specs if s.drop]

    # G11
    def build(self, base: DataFrame, key: str, seed: int = 42, journal: Journal | None = None) -> DataFrame:
        """All columns (helpers included) on top of ``base``; no rows dropped.
        With a ``journal``, calls of external generators that it knows are not
        made again.
        A structured column has its complaint beside it (``__why_<name>``).

        Columns are added one dependency level at a time — all specs whose
        inputs exist already go into a single projection — so the plan has a
        handful of Project nodes instead of one per column."""
        order = self.validate(set(base.columns))
        names = {s.name for s in self.specs}
        level: dict[str, int] = {}
        for s in order:
            deps = [level[r] for r in s.sampler.refs() if r in names]
            level[s.name] = 1 + max(deps) if deps else 0
        df = base
        keycol = F.col(key)
        # a person's fields are columns of their own to templates, so that Spark prunes
        # those that nobody reads; rows that go through Python have the struct alone
        direct, fields = not any(isinstance(s.sampler, Text) and s.sampler.generator is not None for s in order), {}
        for lv in sorted(set(level.values())):
            batch = {}
            for s in (x for x in order if level[x.name] == lv):
                smp = s.sampler
                if isinstance(smp, Text) and smp.generator is not None:
                    df = df.withColumn(f"__prompt_{s.name}", smp.prompt_column())
                    df = _generate_text(df, s.name, smp, key, journal)
                    continue
                if isinstance(smp, (CategoryTable, SubcategoryTable)):
                    df = smp.attach(df, s.name, uniform(seed, s.name, keycol))
                    continue
                ctx = {"name": s.name, "seed": seed, "key": keycol, "fields": fields}
                if direct and isinstance(smp, Person):
                    made = {(s.name, f): (f"__{s.name}_{f}", c) for f, c in smp.fields(ctx).items()}
                    df = df.withColumns({n: c for n, c in made.values()})
                    batch[s.name] = F.struct(*[F.col(n).alias(f) for (_, f), (n, _) in made.items()])
                    fields.update({k: n for k, (n, _) in made.items()})
                    continue
                batch[s.name] = smp.column(uniform(seed, s.name, keycol), ctx)
            if batch:
                df = df.withColumns(batch)
            structured = [x for x in order if level[x.name] == lv and isinstance(x.sampler, Structured)]
            if structured:
                # parsed once, then judged, then taken: each a projection of its own
                df = df.withColumns({f"__v_{x.name}": F.try_parse_json(F.col(x.name)) for x in structured})
                df = df.withColumns({_why(x.name): js.complaint(F.col(f"__v_{x.name}"), F.col(x.name), x.sampler.schema, x.sampler.rules) for x in structured})
                df = df.withColumns({x.name: F.when(F.col(_why(x.name)).isNull(), js.value(F.col(f"__v_{x.name}"), x.sampler.schema)) for x in structured})
                df = df.drop(*[f"__v_{x.name}" for x in structured])
        return df.drop(*fields.values())

    def create_from(self, base: DataFrame, key: str, seed: int = 42,
                    keep: list[str] | None = None, journal: Journal | None = None) -> tuple[DataFrame, DataFrame]:
        """One generated record per row of ``base`` (row id = ``key``).

        Returns ``(table, rejected)``: rows with a null generated column are
        rejected (a failed template, generator call or structured value), helper
        columns dropped.  ``rejected`` has ``failed_columns`` and, where columns are
        structured, ``reasons`` (``column: complaint``).
        """
        full = self.build(base, key, seed, journal)
        if any(isinstance(s.sampler, Text) and s.sampler.generator is not None for s in self.specs):
            # calls are costly and need not repeat themselves: both outputs read the rows written once
            from tidemail.session import scratch_path
            path = scratch_path(base.sparkSession, "generated") + "/rows"
            full.write.parquet(path)
            full = base.sparkSession.read.schema(full.schema).parquet(path)
        # a person is never null; asking whether it is would keep all its fields from being pruned
        gen = [s.name for s in self.specs if full.schema[s.name].nullable]
        ok = F.lit(True)
        for c in gen:
            ok = ok & F.col(c).isNotNull()
        full = full.withColumn("__ok", ok)
        kept = [key] + list(keep or []) + [s.name for s in self.specs if not s.drop]
        table = keep_rows(full, F.col("__ok"), kept)
        failed = [F.when(F.col(c).isNull(), F.lit(c)) for c in gen]
        out = [F.col(key), F.array_compact(F.array(*failed).cast("array<string>")).alias("failed_columns")]
        judged = [s.name for s in self.specs if isinstance(s.sampler, Structured)]
        if judged:
            # (concat with a null complaint is null)
            out.append(F.array_compact(F.array(*[F.concat(F.lit(f"{c}: "), F.col(_why(c))) for c in judged])).alias("reasons"))
        rejected = keep_rows(full, ~F.col("__ok"), out)
        return table, rejected

    def create(self, spark: SparkSession, n: int, seed: int = 42,
               num_partitions: int | None = None, journal: Journal | None = None) -> tuple[DataFrame, DataFrame]:
        """``n`` records with ids ``0..n-1`` from ``spark.range``."""
        base = spark.range(0, n, 1, num_partitions).withColumnRenamed("id", "row_id")
        return self.create_from(base, "row_id", seed, journal=journal)

    def preview(self, spark: SparkSession, n: int = 10, seed: int = 42) -> DataFrame:
        """O2: the first ``n`` records, generated directly (not a limit of a full job)."""
        return self.create(spark, n, seed, num_partitions=1)[0]

    def preview_from(self, base: DataFrame, key: str, n: int = 10, seed: int = 42) -> DataFrame:
        """O2: the records of the first ``n`` rows of ``base`` by key, as
        :meth:`create_from` makes them; only those are generated."""
        return self.create_from(base.orderBy(key).limit(n), key, seed)[0]


def _generate_text(df: DataFrame, name: str, smp: Text, key: str, journal: Journal | None) -> DataFrame:
    """Fill column ``name`` by calling the external generator per batch."""
    factory, parallel, timeout = smp.generator, max(1, smp.max_parallel), smp.timeout
    how = Inference(smp.system_prompt, smp.temperature, smp.top_p, smp.max_tokens)
    pcol, call, known = f"__prompt_{name}", f"__call_{name}", f"__known_{name}"
    if journal is None:
        schema = T.StructType(df.schema.fields + [T.StructField(name, T.StringType())])

        def run(batches):
            fn = factory(how)  # one client per task
            for pdf in batches:
                pdf[name] = call_all(fn, pdf[pcol].tolist(), parallel, timeout)
                yield pdf

        return df.mapInPandas(run, schema).drop(pcol)

    schema = T.StructType(df.schema.fields + [T.StructField(name, T.StringType())])
    asked = df.withColumn(call, call_digest(name, how, F.col(key), F.col(pcol)))
    held = journal.answers(df.sparkSession, name)
    if held is None:
        asked = asked.withColumn(known, F.lit(None).cast("string"))
    else:
        asked = asked.join(held.select(F.col("call").alias("__c"), F.col("answer").alias(known)), F.col(call) == F.col("__c"), "left").drop("__c")

    def recorded(batches):
        from pyspark import TaskContext
        fn, mine = None, journal.task(name, TaskContext.get().partitionId())
        for pdf in batches:
            out = [None if k is None or k != k else k for k in pdf[known].tolist()]
            calls, prompts = pdf[call].tolist(), pdf[pcol].tolist()
            todo = []
            for i, c in enumerate(calls):
                if out[i] is None and c is not None:
                    if c in mine.held:
                        out[i] = mine.held[c]
                    else:
                        todo.append(i)
            fn = fn or (factory(how) if todo else None)
            for at in range(0, len(todo), journal.every):
                some = todo[at:at + journal.every]
                for i, text in zip(some, call_all(fn, [prompts[i] for i in some], parallel, timeout)):
                    out[i] = text
                mine.write({calls[i]: out[i] for i in some if out[i] is not None})
            pdf[name] = out
            yield pdf.drop(columns=[call, known])

    return asked.mapInPandas(recorded, schema).drop(pcol)


def call_all(fn, prompts: list[str | None], parallel: int, timeout: float) -> list[str | None]:
    """``fn`` of every prompt; null where the prompt is null or its call fails
    or runs longer than ``timeout``.  A call is started only when one of the
    ``parallel`` places is free, and its clock starts with it; a late call
    gives up its place and is left behind, so it can hold up nothing."""
    import queue
    import threading
    import time
    out: list[str | None] = [None] * len(prompts)
    todo = [i for i, p in enumerate(prompts) if p is not None][::-1]
    ended: queue.SimpleQueue = queue.SimpleQueue()
    running: dict[int, float] = {}

    def call(i: int):
        try:
            ended.put((i, fn(prompts[i]), None))
        except BaseException as ex:  # noqa: BLE001 — judged by the caller
            ended.put((i, None, ex))
    while todo or running:
        while todo and len(running) < parallel:
            i = todo.pop()
            running[i] = time.monotonic() + timeout
            threading.Thread(target=call, args=(i,), daemon=True).start()
        try:
            i, text, error = ended.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
        except queue.Empty:
            now = time.monotonic()
            running = {i: t for i, t in running.items() if t > now}
            continue
        if isinstance(error, _BUGS):
            raise error
        if running.pop(i, None) is not None and error is None:
            out[i] = text
    return out
