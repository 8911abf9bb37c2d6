"""Line dedup by a template tree, in DataFrame functions only.

A line's own template is the line with its variable fields (tokens with a digit,
an @, or a slash: numbers, dates, addresses, paths) as ``<*>``, so lines that
differ in such fields only share a template.  It is known by its number of tokens
and two hashes, of its leading ``depth`` tokens and of all.  Where fewer than
``min_constant`` different tokens with a letter are left, or they are under half
of the tokens (numbers, prices, tables), the line's fields are its content: it
keeps them, and recurs by its exact content only.

The tree generalises plain words.  Templates go down by number of tokens and
leading tokens (``depth`` + 1 of them, one of which may vary, so that a field
among them does not part its lines).  A node counts each position's distinct
tokens.  A position of ``min_values`` or more is a field; one of two or more, but
fewer, is none (single edits of copied prose look like that), and the node is
parted by all such positions.  If too few tokens with a letter agree even so
(under ``agree`` per cent, or fewer than ``min_constant`` different ones), it is
parted by as many fields as are short too, those of the fewest tokens.  The
templates of a node that needs no parting are one.  A node whose templates stem from fewer than ``min_values`` documents is given up,
and its templates stay as they are.  A template that ends in several nodes belongs
to the largest.

A template found in ``min_docs`` or more documents recurs; its lines are dropped
from all documents but the one with the smallest doc_id, so one copy of every
passage stays in the corpus.

Templates are counted with map-side partials, so a line that a third of all
documents share costs a few rows per task.  Lines are matched to recurring
templates by a join on the template's hashes; documents get back only the
positions to drop.  Only one line of each template in a crowded node is parsed
into tokens for the tree, whose levels are joins and counts of hashes.

Defined results: null text stays null, text without newline is one line; lines
of fewer than ``min_tokens`` tokens and fewer than ``min_chars`` characters
(scripts without spaces have long lines of one token) are never dropped; a line
repeated inside one document only stays; a text whose lines are all dropped is
empty; rows with equal doc_id are one document; rows without a doc_id count as
one document that comes last; repeated rows stay repeated; extra columns pass
through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemail.llm.common import fresh, let, written

#: A token with one of these is a variable field.
VARIABLE = "[0-9@/]"
TOKEN = "[^ \\t\\r\\x0B\\f\\n]"
REST = "[^ \\t\\r\\x0B\\f\\n0-9@/]"
_LAST = (1 << 63) - 1
#: What a line's own template is known by.
KEYS = ("count", "lead", "leaf")


def _spaced(line: Column) -> Column:
    """The line with one space between tokens."""
    def one(x: Column) -> Column:
        odd = F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" "))
        for part in ("  ", "\t", "\r", "\x0b", "\x0c"):
            odd = odd | F.contains(x, F.lit(part))
        return F.when(odd, F.trim(F.regexp_replace(x, "[ \\t\\r\\x0B\\f]+", " "))).otherwise(x)
    return let(line, one)


def template(line: Column, min_constant: int = 3) -> Column:
    """The line with variable fields as <*> and one space between tokens, or
    with its fields as they are if too little of it is constant.  A regular
    expression runs only on lines that need it."""
    def masked(t: Column) -> Column:
        tokens = F.split(t, " ")
        constant = F.filter(tokens, lambda x: F.rlike(x, F.lit("\\p{L}")))
        enough = (F.size(F.array_distinct(constant)) >= min_constant) & (2 * F.size(constant) >= F.size(tokens))
        return F.when(enough, t).otherwise(_spaced(line))
    plain = F.regexp_replace(line, f"{REST}*+{VARIABLE}{TOKEN}*", "<*>")
    return F.when(F.rlike(line, F.lit(VARIABLE)), let(_spaced(plain), masked)).otherwise(_spaced(line))


def line_places(docs: DataFrame, depth: int = 3, min_tokens: int = 3, min_constant: int = 3,
                min_chars: int = 40) -> DataFrame:
    """One row for each line that may be dropped: doc, of (the text's hash),
    pos, its own template (count, lead, leaf), and the hashes of its leading
    tokens, by which it enters the tree (head0 to head<depth>)."""
    each = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("of"),
                       F.posexplode(F.split("text", "\n")).alias("pos", "line"))

    def place(t: Column) -> Column:
        count = F.when(F.length(t) == 0, 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)
        whole = F.struct(count.cast("int").alias("count"), F.xxhash64(F.substring_index(t, " ", depth)).alias("lead"), F.xxhash64(t).alias("leaf"))
        first = F.split(F.substring_index(t, " ", depth + 1), " ")
        rows = F.transform(F.array(whole), lambda w: let(first, lambda h: F.struct(
            *(w[k].alias(k) for k in KEYS), *(F.hash(F.get(h, i)).alias(f"head{i}") for i in range(depth + 1)))))
        return F.filter(rows, lambda p: (p["count"] >= min_tokens) | (F.length(t) >= min_chars))
    # inline keeps a line's place if it has one: a filter would compute it twice
    return each.select("doc", "of", "pos", F.inline(let(template(F.col("line"), min_constant), place)))


def own_templates(places: DataFrame) -> DataFrame:
    """Templates (count, lead, leaf) with their number of documents, the first
    one, the place of one of their lines (of, pos) and its leading tokens."""
    of = [F.first(c).alias(c) for c in places.columns if c in ("of", "pos") or c.startswith("head")]
    each = places.groupBy(*KEYS, "doc").agg(*of)
    return each.groupBy(*KEYS).agg(F.count("*").alias("n_docs"), F.min("doc").alias("first"), *of)


def _crowded(members: DataFrame, min_values: int) -> DataFrame:
    """The nodes whose templates stem from ``min_values`` documents."""
    return members.groupBy("node").agg(F.count_distinct("first").alias("n")).where(F.col("n") >= min_values).select("node")


def tree_members(docs: DataFrame, templates: DataFrame, depth: int = 3, min_constant: int = 3, min_values: int = 3) -> DataFrame:
    """One row for each template and crowded node of the tree's leading levels:
    node, count, lead, leaf, first, and its tokens' hashes (odd: with a letter)."""
    heads = [f"head{i}" for i in range(depth + 1)]
    nodes = [F.xxhash64("count", F.lit(i), *(h for h in heads if h != heads[i])) for i in range(depth + 1)]
    inner = templates.where(F.col("count") > min_constant).select(*KEYS, "first", "of", "pos", F.explode(F.array(*nodes)).alias("node"))
    members = written(inner.join(written(_crowded(inner, min_values), "nodes"), "node", "left_semi"), "members")
    lines = written(members.select(*KEYS, "of", "pos").distinct(), "lines")

    def token(x: Column) -> Column:
        word = F.rlike(x, F.lit("\\p{L}")) & ~F.rlike(x, F.lit(VARIABLE))
        return F.shiftleft(F.xxhash64(x), 1) + word.cast("long")
    texts = docs.select(F.xxhash64("text").alias("of"), "text")
    line = template(F.get(F.split("text", "\n"), F.col("pos")), min_constant)
    # lines grow with the corpus: never broadcast, whatever they measure
    parsed = (texts.join(lines.hint("merge"), "of").select(*KEYS, F.transform(F.split(line, " "), token).alias("tokens"))
              .dropDuplicates(list(KEYS)))
    return members.select("node", *KEYS, "first").join(parsed, list(KEYS))


def grown(members: DataFrame, min_constant: int = 3, min_values: int = 3, agree: int = 60) -> DataFrame:
    """The templates that the tree generalises: count, lead, leaf, node.  Every
    level settles, parts or gives up each node; a parted node's children have
    one more constant position at least, so the levels come to an end."""
    settled, members = [], written(members, "level")
    # nodes are written before members are joined to them, so that a hot node's members can be split
    while not (crowd := written(_crowded(members, min_values), "crowd")).isEmpty():
        live = members.join(crowd, "node", "left_semi")
        values = live.select("node", F.posexplode("tokens").alias("at", "token")).distinct()
        positions = values.groupBy("node", "at").agg(F.count("*").alias("n"), F.min("token").alias("token"))
        word = F.when((F.col("n") == 1) & (F.col("token") % 2 != 0), F.col("token"))
        nodes = positions.groupBy("node").agg(
            F.size(F.collect_set(word)).alias("words"), F.count(word).alias("same"), F.count("*").alias("size"),
            F.collect_list(F.when((F.col("n") > 1) & (F.col("n") < min_values), F.col("at"))).alias("few"),
            F.array_sort(F.collect_list(F.when(F.col("n") >= min_values, F.struct("n", "at")))).alias("fields"))
        short = F.greatest(F.ceil(F.col("size") * agree / 100) - F.col("same"), min_constant - F.col("words")) - F.size("few")
        cut = F.array_sort(F.concat("few", F.slice("fields", 1, F.greatest(short, F.lit(0)).cast("int"))["at"]))
        cuts = written(nodes.where(F.size("few") + F.size("fields") > 0).select("node", cut.alias("cut")), "cuts")
        judged = written(members.join(cuts, "node"), "level")
        settled.append(judged.where(F.size("cut") == 0).select("node", *KEYS))
        child = F.xxhash64("node", F.transform("cut", lambda p: F.get("tokens", p)))
        members = judged.where(F.size("cut") > 0).select(child.alias("node"), *KEYS, "first", "tokens")
    if not settled:
        return members.select(*KEYS, "node")
    settled = written(reduce(DataFrame.unionByName, settled), "settled")
    sizes = settled.groupBy("node").agg(F.count("*").alias("n"))
    return settled.join(sizes, "node").groupBy(*KEYS).agg(F.max(F.struct("n", "node"))["node"].alias("node"))


def recurring(docs: DataFrame, places: DataFrame, depth: int = 3, min_docs: int = 2, min_constant: int = 3,
              min_values: int = 3, agree: int = 60) -> DataFrame:
    """Templates (count, lead, leaf) that recur in ``min_docs`` or more documents,
    by themselves or as the tree generalises them, with the number of documents
    and the first one."""
    templates = written(own_templates(places), "own")
    merged = written(grown(tree_members(docs, templates, depth, min_constant, min_values), min_constant, min_values, agree), "merged")
    own = templates.join(merged, list(KEYS), "left_anti").select(*KEYS, "n_docs", "first")
    nodes = (places.join(merged, list(KEYS)).select("node", "doc").distinct()
             .groupBy("node").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first")))
    shared = merged.join(nodes, "node").select(*KEYS, "n_docs", "first")
    return own.unionByName(shared).where(F.col("n_docs") >= min_docs)


def dropped(docs: DataFrame, depth: int = 3, min_tokens: int = 3, min_docs: int = 2, min_constant: int = 3,
            min_chars: int = 40, min_values: int = 3, agree: int = 60) -> DataFrame:
    """doc, of (the text's hash) and drop: the positions of its lines to drop,
    of every document that loses some.  The places (hashes only) are written
    once, so that the texts are parsed once, but for the lines the tree reads."""
    places = written(line_places(docs, depth, min_tokens, min_constant, min_chars), "places")
    # written as well, so that both sides of the join are dealt for it alone and a hot template's side can be split
    found = written(recurring(docs, places, depth, min_docs, min_constant, min_values, agree), "templates")
    rows = places.join(found, list(KEYS)).where(F.col("doc") != F.col("first"))
    return rows.groupBy("doc", "of").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, depth: int = 3, min_tokens: int = 3, min_docs: int = 2,
                count: str | None = None, min_constant: int = 3, min_chars: int = 40, min_values: int = 3,
                agree: int = 60) -> DataFrame:
    """``docs`` without lines of recurring templates.  ``count`` names a new
    column with the number of lines dropped."""
    if count in docs.columns:
        raise ValueError(f"column {count} exists")
    doc, of, drop = fresh(docs, "doc", "of", "drop")
    lost = dropped(docs.select("doc_id", "text"), depth, min_tokens, min_docs, min_constant, min_chars, min_values, agree).select(
        F.col("doc").alias(doc), F.col("of").alias(of), F.col("drop").alias(drop))
    keyed = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), of: F.xxhash64("text")})
    joined = keyed.join(lost, [doc, of], "left")
    rest = let(F.split("text", "\n"), lambda a: F.array_join(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col(drop)), lambda i: F.get(a, i)), "\n"))
    every = F.size(F.split("text", "\n")) == F.size(drop)
    text = F.when(F.col(drop).isNull(), F.col("text")).when(every, F.lit("")).otherwise(rest)
    out = joined.withColumn("text", text)
    if count:
        out = out.withColumn(count, F.coalesce(F.size(F.col(drop)), F.lit(0)).cast("long"))
        return out.select(*docs.columns, count)
    return out.select(*docs.columns)


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, the number of lines dropped, and the text left."""
    out = dedup_lines(docs.select("doc_id", "text"), count="n_dropped", **options)
    return out.select("doc_id", "n_dropped", F.length("text").cast("long").alias("chars_left"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
