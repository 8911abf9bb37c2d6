import os

import pytest
from pyspark.sql import functions as F

from tidemail.sources import csv as cs

BAD_LINES = [
    ("1,2", ("1", "2")),
    ("3,4,", None),
    ("5,6,,", None),
    ("7", ("7", None)),
    ('8,""', ("8", None)),
    ('"9, x\ny",', ("9, x\ny", None)),
    ('"1,,,""q",2,x', None),
    ('"a,b,c"', ("a,b,c", None)),
    ("", None),
]


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_bad_line_rule_matches_pandas(spark, tmp_dir):
    path = os.path.join(tmp_dir, "bad", "f.csv")
    write(path, "a,b\n" + "\n".join(line for line, _ in BAD_LINES) + "\n")
    got = [tuple(r) for r in cs.read_mail_csv(spark, path).collect()]
    assert sorted(got, key=str) == sorted([e for _, e in BAD_LINES if e is not None], key=str)


def test_roundtrip_keeps_values(spark, tmp_dir):
    rows = [(1, " lead and trail ", 'q"uote, comma'), (2, "multi\r\nline\n", "tab\tback\\slash"),
            (3, "", None), (4, "NA", "ok")]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(2)
    cs.write_csv_parts(df, os.path.join(tmp_dir, "parts"))
    back = cs.read_mail_csv(spark, os.path.join(tmp_dir, "parts"))
    got = sorted((int(r["id"]), r["a"], r["b"]) for r in back.collect())
    assert got == [(1, " lead and trail ", 'q"uote, comma'), (2, "multi\r\nline\n", "tab\tback\\slash"),
                   (3, None, None), (4, None, "ok")]


def test_with_text_rules(spark):
    both = spark.createDataFrame([("s", None, 1)], "subject string, body string, label int")
    assert cs.with_text(both).first()["text"] == "s "
    body = spark.createDataFrame([(None, 1)], "body string, label int")
    assert cs.with_text(body).first()["text"] == ""
    only_text = spark.createDataFrame([("t", 1)], "text string, label int")
    with pytest.raises(ValueError):
        cs.with_text(only_text)


def test_missing_label_fails(spark):
    from pyspark.errors import AnalysisException
    df = spark.createDataFrame([("b",)], "body string")
    with pytest.raises(AnalysisException):
        cs.training_table(df).collect()


def test_corpus_headers_per_file(spark, tmp_dir):
    a = os.path.join(tmp_dir, "a.csv")
    b = os.path.join(tmp_dir, "b.csv")
    write(a, "subject,body,label,extra\nhi,there,1,x\n,only body,0,y\n")
    write(b, "label,body\n1,second file\n")
    c = cs.read_corpus(spark, [a, b])
    got = sorted((r["text"], r["label"]) for r in c.collect())
    assert got == [(" only body", 0), ("hi there", 1), ("second file", 1)]
    from tidemail.operators.counts import corpus_counts
    counts = {(r["source"], r["is_total"]): r["n_rows"] for r in corpus_counts(c.cache()).collect()}
    assert counts[(None, True)] == 3 and counts[(a, False)] == 2


def test_corpus_of_many_files_is_one_scan(spark, tmp_dir):
    heads = [["subject", "body", "label"], ["label", "body"], ["x", "body", "odd name, quoted", "label", "subject"]]
    want = []
    for i in range(300):
        head = heads[i % 3]
        values = {"subject": f"s{i}", "body": f"b{i}", "label": str(i % 2), "x": "NA", "odd name, quoted": ""}
        quoted = [f'"{c}"' if "," in c else c for c in head]
        bad = ",".join(["1"] * (len(head) + 1 + i % 4))            # too many fields, also as many as the widest file has
        write(os.path.join(tmp_dir, f"d{i % 2}", f"f {i}.csv"), "\n".join([",".join(quoted), ",".join(values[c] for c in head), bad, ""]))
        want.append(((f"s{i} " if "subject" in head else "") + f"b{i}", i % 2, f"d{i % 2}"))
    write(os.path.join(tmp_dir, "d0", "empty.csv"), "")
    write(os.path.join(tmp_dir, "d0", "_hidden.csv"), "nothing")
    c = cs.read_corpus(spark, [os.path.join(tmp_dir, "d0"), os.path.join(tmp_dir, "d1")])
    assert sorted((r["text"], r["label"], r["source"].rsplit("/", 1)[1]) for r in c.collect()) == sorted(want)
    plan = c._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def test_corpus_files_must_fit(spark, tmp_dir):
    write(os.path.join(tmp_dir, "a.csv"), "subject,label\nx,1\n")
    with pytest.raises(ValueError, match="no body column"):
        cs.read_corpus(spark, [os.path.join(tmp_dir, "a.csv")])
    write(os.path.join(tmp_dir, "b.csv"), "subject,body\nx,1\n")
    with pytest.raises(ValueError, match="no label column"):
        cs.read_corpus(spark, [os.path.join(tmp_dir, "b.csv")])
    with pytest.raises(FileNotFoundError):
        cs.read_corpus(spark, [os.path.join(tmp_dir, "none.csv")])
    write(os.path.join(tmp_dir, "c.csv"), '"a\nlong ""header""",body,label\n1,"two\nlines",0\n2\n')
    got = cs.read_corpus(spark, [os.path.join(tmp_dir, "c.csv")]).collect()
    assert sorted((r["text"], r["label"]) for r in got) == [("", None), ("two\nlines", 0)]


def test_merge_index(spark, tmp_dir):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(20)], "k long, v string").repartition(3)
    cs.write_csv_parts(df, os.path.join(tmp_dir, "p"))
    cs.merge_csv(spark, os.path.join(tmp_dir, "p"), os.path.join(tmp_dir, "m"),
                 order=[F.col("k").cast("long")], single_file=True)
    files = [f for f in os.listdir(os.path.join(tmp_dir, "m")) if f.endswith(".csv")]
    assert len(files) == 1
    with open(os.path.join(tmp_dir, "m", files[0])) as f:
        lines = f.read().splitlines()
    assert lines[0] == ",k,v"
    assert lines[1:4] == ["0,0,v0", "1,1,v1", "2,2,v2"]


def test_sources_and_model_inputs(spark, tmp_dir):
    from tidemail.operators.tokens import model_inputs, pad
    from tidemail.sources.sinks import read_pages, read_parts
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").repartition(2)
    df.write.parquet(os.path.join(tmp_dir, "parts"))
    assert sorted(tuple(r) for r in read_parts(spark, os.path.join(tmp_dir, "parts")).collect()) == [(1, "a"), (2, "b")]
    write(os.path.join(tmp_dir, "html", "one.html"), "<p>x</p>\n<p>y</p>")
    pages = read_pages(spark, os.path.join(tmp_dir, "html"), wholetext=True).collect()
    assert len(pages) == 1 and pages[0]["html"] == "<p>x</p>\n<p>y</p>" and pages[0]["url"].endswith("one.html")
    assert cs.describe_columns(df) == ["id", "v"]
    m = spark.createDataFrame([([5, 6], 1)], "ids array<int>, label int")
    r = model_inputs(pad(m, "ids", 3)).first()
    assert (r["input_ids"], r["attention_mask"], r["label"]) == ([5, 6, 0], [1, 1, 0], 1)


def test_labels_written_as_decimals(spark):
    from tidemail.sources.csv import training_table
    df = spark.createDataFrame([("a", "1.0"), ("b", "0"), ("c", None), ("d", "spam")], "body string, label string")
    assert [r["label"] for r in training_table(df).orderBy("text").collect()] == [1, 0, None, None]
