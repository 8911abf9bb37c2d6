import pytest

from tidemail.functions import sender as snd

D = "trusted.example"

CASES = [
    ("Ann <ann@trusted.example>", "trusted.example", True),
    ("Ann <ann@TRUSTED.example>", "TRUSTED.example", False),
    ("ann@trusted.example", "Not found", False),
    ("x <a@b> <c@trusted.example>", "b", False),
    ("odd@x <nodomain>", None, False),
    ("Bob <b@mail.trusted.example>", "mail.trusted.example", False),
    ("A <a@trusted.example@evil.com>", "trusted.example", True),
    ("", "Not found", False),
    (None, "Not found", False),
]


@pytest.mark.parametrize("sender,domain,trusted", CASES)
def test_sender_rules(spark, sender, domain, trusted):
    df = spark.createDataFrame([(sender,)], "s string")
    r = df.select(snd.sender_domain("s").alias("d"), snd.is_trusted("s", D).alias("t")).first()
    assert r["d"] == domain
    assert r["t"] is trusted


def test_strict_rejects_double_at(spark):
    df = spark.createDataFrame([("A <a@trusted.example@evil.com>",), ("A <a@trusted.example>",)], "s string")
    got = [r[0] for r in df.select(snd.is_trusted("s", D, strict=True)).collect()]
    assert got == [False, True]
