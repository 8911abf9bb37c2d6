from pyspark.sql import functions as F

from tidemail.functions import html as h

PAGE = ("<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x:0}</style>"
        "<script>var t=\"</p>\";</script></head><body><!-- c --><div class=\"title x\"><p>one</p>"
        "<span><p>deep</p></span></div><div class=\"ad\">Ad &copy; <b>bold</div>"
        "<article><p>a<br>b</p><p>c &quot;q&quot;</p></article></body></html>")


def test_text_parser_and_native_agree(spark):
    df = spark.createDataFrame([(PAGE,), (None,)], "html string")
    got = df.select(h.html_to_text("html").alias("a"), h.html_to_text_native("html").alias("b")).collect()
    assert got[0]["a"] == 'T & Uonedeep' + 'Ad © bold' + 'abc "q"'
    assert got[0]["a"] == got[0]["b"]
    assert got[1]["a"] is None and got[1]["b"] is None


def test_references_and_quoted_attributes(spark):
    pages = ["&#233;&eacute;&#128226;&#x1F4E2; &#150; &Alpha;&apos;", '<a title="x>y" b=\'p>q\' c = "r>s">in</a>', "&#38;lt; &amp;#233; &amp;lt;",
             "&nosuch; & &; &#; &#0;&#xD800;&#99999999; a&lt;b", "", "no tags", '<p x="1" y="2" z=3>t</p><i a=b>u', "it's <p>don't</p> 'x'"]
    df = spark.createDataFrame([(p,) for p in [*pages, None]], "html string")
    for r in df.select("html", h.html_to_text_native("html").alias("got")).collect():
        assert r.got == h.text_of(r.html), r.html
    long = "<p " + 'a="b>" ' * 500 + ">x" + " <q y=1 " * 2000
    got = spark.createDataFrame([(long,)], "html string").select(h.html_to_text_native("html")).first()[0]
    assert got.startswith("x <q y=1")


def test_selectors():
    assert h.select_texts(PAGE, "div.title > p") == ["one"]
    assert h.select_texts(PAGE, "div.title p") == ["one", "deep"]
    assert h.select_texts(PAGE, "article > p") == ["ab", 'c "q"']
    assert h.select_texts(PAGE, ".ad") == ["Ad © bold"]
    assert h.select_texts(PAGE, "div.nope > p") == []


def test_select_udf(spark):
    df = spark.createDataFrame([(PAGE,)], "html string")
    r = df.select(F.explode(h.select_text("html", "article > p"))).collect()
    assert [x[0] for x in r] == ["ab", 'c "q"']
