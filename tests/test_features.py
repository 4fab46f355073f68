import datetime as dt
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from txnlens.functions.features import age_years, haversine_km, with_calendar
from txnlens.functions.measures import fraud_metrics
from txnlens.functions.scoring import base_score, final_score
from txnlens.functions.text import clean_text, heading_level, is_all_caps, sentences, snippet, word_count


def test_calendar(spark):
    data = [(1, dt.datetime(2024, 3, 2, 23, 59, 59, 999999)), (2, dt.datetime(2024, 3, 4)), (3, None)]
    df = with_calendar(spark.createDataFrame(data, "k int, trans_ts timestamp_ntz"))
    got = rows(df, "k", "trans_date", "year", "month", "day", "day_of_week", "is_weekend", "year_month", "hour")
    assert got == [
        (1, dt.date(2024, 3, 2), 2024, 3, 2, "Saturday", True, "2024-03", 23),
        (2, dt.date(2024, 3, 4), 2024, 3, 4, "Monday", False, "2024-03", 0),
        (3, None, None, None, None, None, False, None, None),
    ]


def test_day_names_agree_with_python(spark):
    days = [dt.date(2023, 12, 28) + dt.timedelta(n) for n in range(10)]
    df = with_calendar(spark.createDataFrame([(d,) for d in days], "trans_ts date").withColumn("trans_ts", F.col("trans_ts").cast("timestamp_ntz")))
    assert rows(df, "trans_date", "day_of_week", "is_weekend") == [(d, d.strftime("%A"), d.weekday() >= 5) for d in days]


def test_age(spark):
    data = [(1, dt.datetime(2020, 1, 1, 23, 0), dt.date(2019, 1, 1)), (2, dt.datetime(2020, 1, 1), dt.date(2020, 1, 11))]
    df = spark.createDataFrame(data, "k int, ts timestamp_ntz, dob date")
    got = dict(rows(df.select("k", age_years(F.col("ts"), F.col("dob")).alias("a"))))
    assert got[1] == pytest.approx(365 / 365.25)
    assert got[2] == pytest.approx(-10 / 365.25)


def test_haversine(spark):
    data = [(1, 10.0, 20.0, 10.0, 20.0), (2, 0.0, 0.0, 0.0, 180.0), (3, 52.52, 13.405, 48.8566, 2.3522), (4, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "k int, a double, b double, c double, d double")
    got = dict(rows(df.select("k", haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("km"))))
    assert got[1] == 0.0
    assert got[2] == pytest.approx(6371.0 * math.pi)
    assert got[3] == pytest.approx(877.46, abs=0.01)
    assert got[4] is None


def test_metrics_edges(spark):
    data = [("zero", 1, 5.0), ("zero", 0, -5.0), ("nulls", 1, None), ("nulls", 0, None), ("unknown", None, 2.0), ("plain", 0, 1.0)]
    df = spark.createDataFrame(data, "g string, is_fraud short, amt double")
    got = {r["g"]: tuple(r)[1:] for r in df.groupBy("g").agg(*fraud_metrics(F.col("is_fraud"), F.col("amt"))).collect()}
    assert got["zero"] == (2, 1, 0.5, 0.0, 5.0, None)
    assert got["nulls"] == (2, 1, 0.5, None, 0.0, None)
    assert got["unknown"] == (1, 0, 0.0, 2.0, 0.0, 0.0)
    assert got["plain"] == (1, 0, 0.0, 1.0, 0.0, 0.0)


SPACES = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())


@pytest.mark.parametrize(
    "text",
    ["", "  ", "a b", " a  b\t\nc ", "\x1ca\x1f\x1fb", "x" + SPACES + "y", "é  ü ß ​ z", "a 　b", " ", "a\n\nb  c d", SPACES.join("abc")],
)
def test_clean_and_count_like_python(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(clean_text(F.col("t")).alias("c"), word_count(F.col("t")).alias("n"), sentences(F.col("t")).alias("s")).first()
    assert row["c"] == " ".join(text.split())
    assert row["n"] == len(text.split())
    assert row["s"] == ([text.strip()] if text.strip() else [])


def test_every_space_character(spark):
    texts = [f"a{c}b" for c in SPACES] + ["a​b", "a᠎b", "a­b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", clean_text(F.col("t")).alias("c"))
    assert all(r["c"] == " ".join(r["t"].split()) for r in df.collect())


def test_caps(spark):
    cases = {"ABCD": True, "ABC": False, "A-B C 1 D!": True, "ABCDe": False, "1234": False, "ÄÖÜß ABCD": True, "": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", is_all_caps(F.col("t")).alias("c"))
    assert dict(rows(df)) == cases


def test_heading_level(spark):
    cases = {"Heading 1": 1, "Heading 12": 12, "Heading": 1, "Heading x": 1, "Heading 2 ": 2, "Heading 1.0": 1}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", heading_level(F.col("t")).alias("c"))
    assert dict(rows(df)) == cases


def test_sentences(spark):
    df = spark.createDataFrame([(" One. Two!  Three?\nFour 3.5 e.g. five ",)], "t string")
    assert df.select(sentences(F.col("t"))).first()[0] == ["One.", "Two!", "Three?", "Four 3.5 e.g.", "five"]


def test_snippet(spark):
    df = spark.createDataFrame([("ab\ncd\U0001f600e",)], "t string")
    assert df.select(snippet(F.col("t"), 6)).first()[0] == "ab cd\U0001f600"


def test_scores(spark):
    cases = [
        ("data", 3, False, 0, None, 0.75), ("data", 3, True, 0, None, 0.5), ("data", 0, True, 0, None, 0.3), ("data", None, None, 0, None, 0.3),
        ("document", None, None, 2, 0.0, 0.75), ("document", None, None, 2, None, 0.75), ("document", None, None, 0, None, 0.3),
        ("none", None, None, None, None, 0.3), (None, None, None, 1, 1000.0, 0.9), ("document", None, None, 1, -1e6, 0.6),
    ]
    df = spark.createDataFrame(cases, "t string, n int, f boolean, h int, m double, want double")
    got = df.select("want", base_score(F.col("t"), F.col("n"), F.col("f"), F.col("h"), F.col("m")).alias("got")).collect()
    assert [r["got"] for r in got] == pytest.approx([r["want"] for r in got])


@pytest.mark.parametrize(
    "judge, score", [("0.8", 0.8), (" 1.7 ", 1.0), ("-2", 0.0), ("n/a", None), ("", None), (None, None), ("nan", 1.0), ("inf", 1.0), ("1e-1", 0.1), ("0.5d", None), ("0x1p3", None), (".5", 0.5), ("1.", 1.0)]
)
def test_final_score(spark, judge, score):
    df = spark.createDataFrame([(0.4, judge)], "b double, j string")
    assert df.select(final_score(F.col("b"), F.col("j"))).first()[0] == pytest.approx((0.4 + (0.4 if score is None else score)) / 2)
