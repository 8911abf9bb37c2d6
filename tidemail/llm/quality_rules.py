"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` computes every measurement once; ``ledger`` evaluates every rule
once and stores its failure as one bit beside the measurements.  A policy is a
versioned set of rules, that is, a mask: ``apply_policy`` and ``ablations``
read only the ledger and never the texts again.

Words are runs of characters other than ASCII white space.  A text's repeated
3-word windows are found by sorting the hashes of its windows inside the row,
so no group is gathered and nothing is shuffled.

Defined results: null or empty text has zero words and fails ``min_words``;
ties cannot occur (rows are judged alone); repeated rows are judged each;
empty tables give empty ledgers; extra columns never enter.  Windows are
compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemail.llm.common import let

WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements, in whole numbers, so
    that every engine decides alike."""
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


#: Bit i of the ledger belongs to RULES[i]; new rules go to the end.
RULES = (
    Rule("min_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbol_share", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "n_words > 0 and word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
)
BASE = Policy("base-1", ("min_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(r.name for r in RULES))


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(r) for r in set(policy.rules))


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    The windows' hashes are sorted as plain longs to find the repeated ones;
    only then are positions looked up: in the list of repeated hashes where it
    is short, else by sorting (hash, position) pairs."""
    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3)))),
                           F.lit(0).cast("long"), lambda a, b: a + b)

    def by_sort(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, i: (x.h == F.get(p, i - 1).h) | (x.h == F.get(p, i + 1).h)), lambda x: x.i)))

    def positions(hashes: Column, twice: Column) -> Column:
        short = F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
        return F.when(F.size(twice) <= 32, short).otherwise(by_sort(hashes))

    def from_hashes(hashes: Column) -> Column:
        return let(F.sort_array(hashes), lambda s: let(
            F.array_distinct(F.filter(s, lambda h, i: h == F.get(s, i + 1))),
            lambda twice: F.when(F.size(twice) == 0, F.lit(0).cast("long")).otherwise(let(positions(hashes, twice), covered))))

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                             lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, from_hashes))
    return let(words, of)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, WHITE + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(NOT_WHITE)))
    counts = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"),
                                           (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                             F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                                             _repeated(w).alias("n_repeat_words")))
    return (docs.select("doc_id", of_words.alias("w"), counts.alias("l"),
                        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols"))
            .select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The measurements and fail_bits (bit i: the row fails rule i)."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    both = bits[0]
    for b in bits[1:]:
        both = both.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", both)


def apply_policy(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, out: str = "kept") -> DataFrame:
    """A boolean column: no rule of the policy failed."""
    return entries.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0)


def ablations(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: rows it fails, rows only it fails (those kept
    without it), and rows the policy keeps.  One pass, grouped by the bit
    pattern (at most 2^rules groups, summed before the shuffle)."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(policy, rules)).cast("long"))
    patterns = entries.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    names = [r.name for r in rules]
    rows = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit"))
                               for r in policy.rules)))
    return (patterns.select("bits", "n", rows.alias("r")).groupBy(F.col("r.rule").alias("rule"))
            .agg(F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
                 F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"))
            .withColumn("version", F.lit(policy.version)))
