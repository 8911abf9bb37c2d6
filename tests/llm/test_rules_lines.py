import random

import brute
from conftest import SF001
from tidemail.llm import line_templates as lt
from tidemail.llm import quality_rules as qr

COLS = "doc_id long, text string, lang string, source string, n_words string, doc string, drop int"


def odd_docs(spark, extra=()):
    r = random.Random(3)
    prose = [" ".join(r.choice(["the", "of", "a", "tion", "re"]) for _ in range(r.randint(1, 400))) for _ in range(40)]
    texts = [None, "", " \n\t ", "a", "a b", "a b c", "a b c a b c", "\n\n", "x\ny\nx\nx \n", "é # * $ é", "word " * 30000,
             *prose, prose[0], *extra]
    rows = [(i, t, None, "s", "clash", "d", 1) for i, t in enumerate(texts)] + [(None, "null id text here", "en", None, None, None, None)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, COLS)


def test_measurements_match_brute_force(spark):
    docs = odd_docs(spark)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in qr.ledger(docs).collect()), key=str)
    want = sorted(((r.doc_id, *brute.quality(r.text)) for r in docs.collect()), key=str)
    assert got == want


def test_measurements_on_the_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.measure(docs).collect()}
    assert got == {r.doc_id: brute.quality(r.text) for r in docs.collect()}


def test_ledger_bits_policies_and_ablations(spark):
    entries = qr.ledger(odd_docs(spark)).cache()
    rows = qr.apply_policy(entries, qr.STRICT).collect()
    for r in rows:
        assert bool(r.fail_bits & 1) == (r.n_words < 50)
        assert bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.fail_bits & qr.mask(qr.STRICT) == 0)
    ab = {r.rule: r for r in qr.ablations(entries, qr.BASE).collect()}
    for i, rule in enumerate(qr.BASE.rules):
        assert ab[rule].n_failed == sum(bool(r.fail_bits >> i & 1) for r in rows)
        assert ab[rule].n_only_this == sum(r.fail_bits & 3 == 1 << i for r in rows)
        assert ab[rule].n_kept == sum(r.fail_bits & 3 == 0 for r in rows)
    assert qr.ledger(odd_docs(spark).limit(0)).count() == 0


def test_rules_and_lines_plan_no_python(spark):
    docs = odd_docs(spark)
    for df in (qr.ledger(docs), lt.report(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_templates_recur_across_documents_only(spark):
    rows = [(1, "Page 3 of 10 here\nmy own line one\nshared words in line"), (2, "shared words in line\nPage 17 of 20 here"),
            (3, "twice in one doc\ntwice in one doc\n\nshared  words\tin line "), (4, None), (5, ""),
            (6, "Page 4 of 7 here"), (7, "a b\na b"), (8, "a b"), (None, "shared words in line\nonly me in here"),
            (9, "see http://x.org/1 now ok\nown text in nine"), (10, "see a@b.c now ok")]
    docs = spark.createDataFrame([(d, t, "en", "x") for d, t in rows], "doc_id long, text string, drop string, of string")
    got = {r.doc_id: r for r in lt.dedup_lines(docs, count="n").collect()}
    assert got[1].text == rows[0][1] and got[1].n == 0
    assert got[2].text == "" and got[2].n == 2
    assert got[3].text == "twice in one doc\ntwice in one doc\n"
    assert got[4].text is None and got[5].text == ""
    assert got[6].text == "" and got[7].text == "a b\na b" and got[8].text == "a b"
    assert got[None].text == "only me in here"
    assert got[9].text == rows[9][1] and got[10].text == ""
    assert got[1].drop == "en" and got[1].of == "x"
    assert lt.dedup_lines(docs.limit(0)).count() == 0


def test_lines_of_fields_recur_by_content_only(spark):
    rows = [(1, "2021-01-05 14.2 77%\n3 of 4 5\n12 kg 14 kg 16 kg\nTotal for year 1 2 3 4"),
            (2, "1987 3.1 12%\n8 of 9 1\n1 kg 2 kg 3 kg\nTotal for year 7 8 9 6\n2021-01-05  14.2\t77%"),
            (3, "Row 1 of the table"), (4, "Row 2 of the table"), (5, "1 -- -- -- 2"), (6, "7 -- -- -- 8"), (7, "8 of 9 1 ")]
    got = {r.doc_id: (r.text, r.n) for r in lt.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()}
    assert got == {1: (rows[0][1], 0), 2: (rows[1][1].rsplit("\n", 1)[0], 1), 3: (rows[2][1], 0), 4: ("", 1),
                   5: (rows[4][1], 0), 6: (rows[5][1], 0), 7: ("", 1)}


def test_tree_generalises_plain_words(spark):
    rows = [(1, "Posted by Alice in Sports today\nRow of the quick table stays\nsome line that was edited once here"),
            (2, "Posted by Bob in News today\n  own words of two\nsome line that is edited once here"),
            (3, "Posted by Carol in Arts\ttoday\nI want to eat some cake"), (4, "Posted by Dan in Sports today\nI want to go home now"),
            (5, "Posted by Dan in Sports yesterday\nI want to buy a car"),
            (6, "user logged in from home page"), (7, "user logged in from work page"), (8, "user logged in from start page\nown line of eight"),
            (9, "Chapter One of the book\nChapter Two of the book\nChapter Three of the book"), (10, "Chapter Four of the book"),
            (11, "12 kg 14 kg 16 kg red"), (12, "12 kg 14 kg 16 kg blue"), (13, "12 kg 14 kg 16 kg green"), (None, "Posted by Eve in News today")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n) for r in lt.dedup_lines(docs, count="n").collect()}
    want = {d: (t, 0) for d, t in rows}
    want |= {2: (rows[1][1].split("\n", 1)[1], 1), 3: ("I want to eat some cake", 1), 4: ("I want to go home now", 1),
             7: ("", 1), 8: ("own line of eight", 1), None: ("", 1)}
    assert got == want


def test_tree_parts_mixed_and_hot_nodes(spark):
    names = ["Ann", "Bea", "Cid", "Dora", "Emil"]
    rows = [(i, f"Notes taken by the {w} team on a {names[i % 5]} of spring") for i, w in enumerate(["red", "blue", "green"] * 5)]
    rows += [(100 + i, "Notes taken by " + " ".join(f"w{'abcdefghij'[(i * k) % 7]}{'xyz'[i % 3]}" for k in range(2, 10))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lt.dedup_lines(docs).collect()}
    assert got[0] == rows[0][1] and all(got[i] == "" for i in range(1, 15))
    first = {}
    for d, t in rows[15:]:                      # the unrelated lines go where they are equal only
        assert got[d] == ("" if t in first else t)
        first.setdefault(t, d)
    every = {r.doc_id: r.text for r in lt.dedup_lines(docs, min_docs=16).collect()}
    assert every == dict(rows)                  # the node's lines are in 15 documents


def test_long_lines_without_spaces_recur(spark):
    long, short = "本网站所有内容版权归作者所有未经许可不得转载" * 2, "版权所有"
    rows = [(1, f"{long}\n{short}"), (2, f"{long}\n{short}\n一"), (3, "x" * 39), (4, "x" * 39)]
    got = {r.doc_id: r.text for r in lt.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: f"{short}\n一", 3: "x" * 39, 4: "x" * 39}


def test_lines_brute_force_on_the_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    import re

    def template(line):
        line = re.sub(r"[\t\r\x0b\f]", " ", line).strip(" ")
        return re.sub(" +", " ", re.sub(r"[^ ]*[0-9@/][^ ]*", "<*>", line))
    all_rows = docs.select("doc_id", "text").collect()
    where = {}
    for r in all_rows:
        for line in r.text.split("\n"):
            t = template(line)
            if t.count(" ") >= 2:
                where.setdefault(t, set()).add(r.doc_id)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n")
                                if not (len(where.get(template(x), ())) >= 2 and min(where[template(x)]) != r.doc_id)) for r in all_rows}
    got = {r.doc_id: r.text for r in lt.dedup_lines(docs).collect()}
    assert got == want
