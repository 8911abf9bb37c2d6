from pyspark.sql import functions as F

from tidemail.functions import text as tx


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expr(F.col("c")).alias("r")).first()["r"]


def test_clean_body_whitespace_fixture(spark):
    src = "  a\n\n\nb \u00a0 c\n d \ufeff "
    assert one(spark, src, tx.clean_body) == "a\nb c d"


def test_js_trim_keeps_inner_and_nel(spark):
    assert one(spark, "\u3000 x y \u2028", tx.js_trim) == "x y"
    assert one(spark, "ab \u0085", tx.js_trim) == "ab \u0085"


def test_or_default_before_trim(spark):
    assert one(spark, "", lambda c: tx.or_default(c, "Sender not found")) == "Sender not found"
    assert one(spark, None, lambda c: tx.or_default(c, "X")) == "X"
    assert one(spark, "  ", lambda c: tx.js_trim(tx.or_default(c, "X"))) == ""


def test_training_text_keeps_space(spark):
    df = spark.createDataFrame([(None, "b"), (None, None), ("s", None)], "subject string, body string")
    got = [r[0] for r in df.select(tx.training_text("subject", "body")).collect()]
    assert got == [" b", " ", "s "]


def test_words_and_staff_email(spark):
    assert one(spark, "Dr. Ada Quill Lovelace", lambda c: tx.staff_email(c, "example.edu")) == "ada.lovelace@example.edu"
    assert one(spark, "Associate Professor Sam Park Moon",
               lambda c: tx.staff_email(c, "example.edu")) == "professor.moon@example.edu"
    assert one(spark, "Registrar", lambda c: tx.staff_email(c, "example.edu")) is None
    assert one(spark, "   ", lambda c: tx.word_at(c, -1)) is None
    assert one(spark, " a  b\tc ", lambda c: tx.word_at(c, -1)) == "c"


def test_snippet_and_escape(spark):
    s = "x" * 501
    assert one(spark, s, lambda c: tx.snippet(c, 500)) == "x" * 500 + "..."
    assert one(spark, "x" * 500, lambda c: tx.snippet(c, 500)) == "x" * 500
    assert one(spark, "<a href='x'>&\"", tx.escape_html) == "&lt;a href=&#039;x&#039;&gt;&amp;&quot;"


def test_na_tokens(spark):
    df = spark.createDataFrame([(t,) for t in tx.NA_TOKENS + ["ok", "na"]], "c string")
    got = [r[0] for r in df.select(tx.na_to_null("c")).collect()]
    assert got == [None] * len(tx.NA_TOKENS) + ["ok", "na"]


def test_tokens(spark):
    assert one(spark, "Héllo, WORLD 42!", tx.tokens) == ["héllo", "world", "42"]
