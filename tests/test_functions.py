"""Scalar expressions on edge values."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.functions import numbers as N
from tallywatch.functions import text as X


def evaluate(spark, values, make, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_parse_number_text(spark):
    values = [None, "", "nan", "inf", "-Infinity", "1,000", "1d", " 12 ", "0", "2500", ".5", "1e3", "5000.01", "abc"]
    got = evaluate(spark, values, lambda c: N.parse_number(c, T.StringType()))
    inf = float("inf")
    assert got == [None, None, None, inf, -inf, None, None, 12.0, 0.0, 2500.0, 0.5, 1000.0, 5000.01, None]


def test_parse_number_double(spark):
    got = evaluate(spark, [1.5, float("nan"), None], lambda c: N.parse_number(c, T.DoubleType()), "double")
    assert got == [1.5, None, None]


def test_parse_timestamp(spark):
    values = ["2022/09/01 00:20", "2024-01-05 10:00:00", "2024-01-05T10:00:00", "2024-01-05", "bad", "", None]
    got = evaluate(spark, values, lambda c: N.parse_timestamp(c, T.StringType()).cast("string"))
    assert got == [
        "2022-09-01 00:20:00", "2024-01-05 10:00:00", "2024-01-05 10:00:00", "2024-01-05 00:00:00", None, None, None,
    ]


def test_normalise_mcc(spark):
    values = ["6012", "6012.0", "6012.9", "0742", " abc ", None, "inf", "nan", "1d"]
    assert evaluate(spark, values, X.normalise_mcc) == [
        "6012", "6012", "6012", "742", "abc", None, "inf", "nan", "1d",
    ]


def test_country_lookup(spark):
    values = ["irn", " IRN ", "USA", None]
    assert evaluate(spark, values, lambda c: X.fatf_name(X.normalise_country(c))) == ["Iran", "Iran", None, None]
    assert evaluate(spark, values, lambda c: X.is_fatf(X.normalise_country(c))) == [True, True, False, False]


def test_currency(spark):
    values = [1234.5, -5.0, 0.0, 1e9, None, float("nan"), float("inf")]
    assert evaluate(spark, values, X.currency, "double") == [
        "$1,234.50", "$-5.00", "$0.00", "$1,000,000,000.00", "N/A", "$nan", "$inf",
    ]
    assert evaluate(spark, ["12", "n/a", None], X.currency_text) == ["$12.00", "n/a", "N/A"]


def test_counterparty(spark):
    rows = [
        ("Ann", "Lee", "Shop", "A1"),
        ("Ann", None, "Unknown", "A1"),
        ("", "", "Shop", "A1"),
        (None, None, "Unknown", "A1"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "f string, l string, m string, a string")
    got = [r[0] for r in df.select(X.counterparty(*(F.col(c) for c in "flma"))).collect()]
    assert got == ["Ann Lee (Shop)", "Ann", "Shop", "A1", "Unknown"]


def test_flag_texts(spark):
    long = "x" * 61
    assert evaluate(spark, ["No flags", "a", "a | b"], X.flag_count) == [0, 1, 2]
    assert evaluate(spark, ["x" * 60, long], X.shortened) == ["x" * 60, "x" * 60 + "..."]


def test_masked_card(spark):
    assert evaluate(spark, ["4000123412341234", "12", None], X.masked_card) == [
        "4000XXXXXXXX1234", "12XXXXXXXX****", "XXXXXXXXXXXXXXXX",
    ]


def test_feature_label(spark):
    values = ["amount_usd", "some_new_feature"]
    assert evaluate(spark, values, X.feature_label) == ["Transaction Amount", "Some New Feature"]


def test_levels(spark):
    scores = [30, 31, 39, 40, 60, 61, 69, 70, 100]
    v3 = evaluate(spark, scores, lambda c: X.risk_level(c, 70, 40), "int")
    v2 = evaluate(spark, scores, lambda c: X.risk_level(c, 61, 31), "int")
    assert v3 == ["LOW"] * 3 + ["MEDIUM"] * 4 + ["HIGH"] * 2
    assert v2 == ["LOW"] + ["MEDIUM"] * 4 + ["HIGH"] * 4


def test_row_json(spark):
    df = spark.sql("SELECT double('nan') AS a, double('inf') AS b, 1.5D AS c, timestamp '2024-01-02 03:04:05' AS d")
    assert df.select(N.row_json(df)).first()[0] == '{"c":1.5,"d":"2024-01-02 03:04:05"}'
