"""Pseudonyms: permutations that keep their format, equal values, very long texts."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii


def swapped(spark, texts, key="key"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymize(df, key).orderBy("doc_id").collect()]


def test_digits_are_permuted(spark):
    """All strings of one format, each hit once."""
    for form, n in (("{:02d}", 100), ("{:03d}", 1000), ("a{:01d}", 10)):
        df = spark.range(n).select(pii.feistel(F.format_string(form.replace("{:", "%").replace("}", ""), "id"), "key", "x").alias("p"))
        found = [r.p for r in df.collect()]
        assert len(set(found)) == n and all(re.fullmatch(form[0] == "a" and "[a-z]\\d" or "\\d+", p) for p in found)


def test_every_day_is_hit_once(spark):
    days = spark.range(pii.DAYS).select(F.date_format(F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    out = days.select(pii._date(F.col("d"), "key").alias("p"))
    assert out.distinct().count() == pii.DAYS and out.where("p < '1900-01-01' OR p > '2099-12-31'").count() == 0


def test_social_security_numbers_stay_valid(spark):
    df = spark.range(1, 5000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 665 + 1, F.col("id") % 99 + 1, F.col("id")).alias("s"))
    out = df.select("s", pii._ssn(F.col("s"), "key").alias("p"))
    assert out.where(~pii.is_ssn(F.col("p"))).count() == 0 and out.select("p").distinct().count() == out.select("s").distinct().count()


def test_cards_stay_valid(spark):
    cards = [f"4{i:014d}" for i in range(200)]
    df = spark.createDataFrame([(c,) for c in cards], "head string").select(F.concat("head", pii._check_digit(F.col("head"))).alias("c"))
    out = df.select("c", pii._card(F.col("c"), "key").alias("p")).where(pii.is_card(F.col("c")))
    assert out.where(~pii.is_card(F.col("p"))).count() == 0 and out.select("p").distinct().count() == out.count()


def test_equal_values_stay_linked(spark):
    digits = lambda s: re.sub(r"\D", "", s)
    phones = ["+1 202 555 0143", "+12025550143", "+1 (202) 555-0143", "+1-202-555-0143"]
    found = swapped(spark, [*phones, "202-555-0143", "(202) 555-0143", "+44 20 7946 0958", "+442079460958"])
    assert len({digits(p) for p in found[:4]}) == 1 and all(p.startswith("+1") for p in found[:4])
    assert digits(found[4]) == digits(found[5]) == digits(found[0])[1:]
    assert digits(found[6]) == digits(found[7]) and found[6].startswith("+44 ")
    dates = swapped(spark, ["1987-06-05", "05/06/1987", "05.06.1987"])
    assert dates[0].split("-") == dates[1].split("/")[::-1] == dates[2].split(".")[::-1]
    cards = swapped(spark, ["4111111111111111", "4111 1111 1111 1111"])
    assert digits(cards[0]) == digits(cards[1]) != "4111111111111111"


def test_key_is_not_in_the_plan(spark, capsys):
    df = pii.pseudonymize(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "very secret key")
    df.explain(True)
    assert "very secret key" not in capsys.readouterr().out


@pytest.mark.parametrize(
    "text",
    [
        "x@" + "a." * 500_000 + "com",
        "a" * 1_000_000 + "@example.com",
        "a.b" * 300_000,
        "a@" * 500_000,
        "1" * 1_000_000,
        "1." * 500_000,
        "(" * 1_000_000,
        "1" + "-" * 1_000_000,
        "1-" * 500_000,
        "+1 " * 300_000,
        "/" * 500_000 + "1/" * 250_000,
        "\n" * 1_000_000,
    ],
    ids=lambda t: repr(t[:6]),
)
def test_long_texts(spark, text):
    began = time.time()
    assert swapped(spark, [text]) == [text]
    assert time.time() - began < 60


def test_long_texts_with_values(spark):
    (found,) = swapped(spark, ["mail ann@example.com, 10.1.2.3\n" * 3_000])
    assert len(set(found.splitlines())) == 1 and "ann@" not in found and found.count("@example.com") == 3_000


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "no values", "ann@example.com"), (3, "no values", "ann@example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    assert sorted(map(tuple, pii.pseudonymize(df, "k").collect())) == sorted(rows, key=lambda r: (r[0], r[1] or ""))
    assert pii.pseudonymize(df.where("false"), "k").count() == 0
