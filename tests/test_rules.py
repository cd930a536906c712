"""Rules on boundary values, in both profiles."""

import pytest
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators import rules as R
from tallywatch.schema import canonicalise
from tallywatch.sources.star import transactions, transactions_table

AMOUNTS = [0.0, 2000.0, 2500.0, 5000.0, 5000.01, 8999.0, 9000.0, 9999.0, 9999.5, 10000.0, 10000.01, 50000.0, 50000.01]


def scored(df, profile=C.V3, **kw):
    return {r["txn_id"]: r for r in R.score_rules(df, profile, **kw).collect()}


def amounts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "txn_id bigint, amount double")


def points(df, outcome):
    return [r[0] for r in df.orderBy("txn_id").select(outcome.points).collect()]


def test_amount_tiers(spark):
    df = amounts(spark, AMOUNTS)
    assert points(df, R.amount_rule(F.col("amount"))) == [0, 0, 0, 0, 10, 10, 10, 10, 10, 10, 20, 20, 25]


def test_structuring_band(spark):
    df = amounts(spark, AMOUNTS)
    assert points(df, R.structuring_rule(F.col("amount"))) == [0, 0, 0, 0, 0, 0, 20, 20, 0, 0, 0, 0, 0]


def test_round_amounts(spark):
    df = amounts(spark, [1500.0, 2000.0, 2500.0, 4000.0, 4500.0, 5000.0, 5500.0, 6000.0, 6000.5])
    outcome, value = R.round_rule(F.col("amount"))
    assert points(df, outcome) == [0, 5, 5, 5, 5, 10, 5, 10, 0]
    assert [r[0] for r in df.orderBy("txn_id").select(value).collect()] == [0, 1, 1, 1, 1, 2, 1, 2, 0]


@pytest.mark.parametrize(
    "sender, receiver, worth, flag",
    [
        ("USA", "usa ", 0, None),
        ("USA", "GBR", 10, "Cross-Border Transaction"),
        ("USA", None, 10, "Cross-Border Transaction"),
        (None, None, 0, None),
        ("IRN", "USA", 30, "FATF High-Risk Country (Iran)"),
        ("USA", "PRK", 30, "FATF High-Risk Country (North Korea)"),
        ("IRN", "CUB", 30, "FATF High-Risk Country (Cuba)"),
        ("IRN", " irn", 15, "FATF High-Risk Country (Iran)"),
    ],
)
def test_geography(spark, sender, receiver, worth, flag):
    df = spark.createDataFrame([(sender, receiver)], "s string, r string")
    outcome, _, _ = R.geography_rule(F.col("s"), F.col("r"))
    assert tuple(df.select(outcome.points, outcome.flag).first()) == (worth, flag)


def frequency_rows(spark):
    rows = [(i, "A", "B", "c1") for i in range(5)] + [(i, "A", "C", "c2") for i in range(5, 11)]
    rows += [(i, None, None, None) for i in range(11, 18)] + [(i, "", " ", "c3") for i in range(18, 29)]
    return spark.createDataFrame(
        rows, "txn_id bigint, receiver_first_name string, receiver_last_name string, card_number string"
    )


def test_frequencies(spark):
    """Blank receivers and blank or missing cards do not count."""
    rows = frequency_rows(spark)
    blank = spark.createDataFrame([(100 + i, "x", str(i), " " * (i % 3)) for i in range(12)], rows.schema)
    got = scored(rows.unionByName(blank))
    assert {got[100 + i]["feature_card_velocity"] for i in range(12)} == {0}
    assert {i: got[i]["feature_recv_velocity"] for i in (0, 5, 11, 18)} == {0: 5, 5: 6, 11: 0, 18: 0}
    assert {i: got[i]["feature_card_velocity"] for i in (0, 5, 11, 18)} == {0: 5, 5: 6, 11: 0, 18: 11}
    assert got[0]["score"] == 0 and got[5]["flags"] == ["High Receiver Velocity (6x same receiver)"]
    assert got[18]["breakdown"] == ["Card Velocity +5"] and len(got) == 41


def test_zscore_guards(spark):
    assert scored(amounts(spark, [7.0]))[0]["feature_zscore"] == 0.0
    assert scored(amounts(spark, [7.0, 7.0, 7.0]))[1]["feature_zscore"] == 0.0
    infinite = scored(amounts(spark, [1.0, 2.0, float("inf")]))
    assert {r["feature_zscore"] for r in infinite.values()} == {0.0}


def test_zscore_uses_unrounded_value(spark):
    df = amounts(spark, [0.0] * 50 + [100.0])
    row = scored(df)[50]
    assert row["feature_zscore"] == 7.0 and row["flags"] == ["Statistical Anomaly (Z=7.00)"]


def test_no_rule_hits(spark):
    row = scored(amounts(spark, [10.0, 10.0]))[0]
    assert (row["score"], row["flags_text"], row["breakdown_text"]) == (0, "No flags", "No risk points scored")


def test_cap_order_and_profiles(spark):
    columns = "txn_id bigint, amount double, mcc string, sender_country string, receiver_country string"
    rows = [(0, 60000.0, "6012.0", "USA", "IRN")] + [(i, 1.0, "1", "USA", "USA") for i in range(1, 40)]
    df = spark.createDataFrame(rows, columns)
    v3, v2 = scored(df)[0], scored(df, C.V2)[0]
    assert v3["score"] == 100 and v3["risk_level"] == "HIGH"
    assert v3["flags"] == [
        "Very Large Amount (>$50K)",
        "High-Risk MCC 6012 (Financial Institution Merchandise)",
        "FATF High-Risk Country (Iran)",
        "Round Amount ($1,000 multiple)",
        "Statistical Anomaly (Z=6.17)",
    ]
    assert v3["breakdown_text"] == (
        "Large Amount +25, High-Risk MCC +20, FATF +30, Round Amount +10, Z-Score Anomaly +15"
    )
    assert "feature_structuring" not in v2.asDict() and v2["score"] == 100


def test_single_record(spark):
    df = spark.createDataFrame(
        [(1, 9501.0, "Ann", "Lee", "c")],
        "txn_id bigint, amount double, receiver_first_name string, receiver_last_name string, card_number string",
    )
    row = scored(df, snapshots=R.SINGLE_RECORD)[1]
    assert (row["score"], row["feature_recv_velocity"], row["feature_card_velocity"]) == (30, 1, 1)


def test_points_sum_and_invariance(spark, txn):
    """Breakdown points add up to the score below the cap, however the rows are laid out."""
    one = {i: r["score"] for i, r in scored(txn).items()}
    other = scored(txn.repartition(7).orderBy(F.col("txn_id").desc()))
    assert one == {i: r["score"] for i, r in other.items()}
    for row in other.values():
        total = sum(int(p.rsplit("+", 1)[1]) for p in row["breakdown"])
        assert row["score"] == min(100, total) and 0 <= row["score"] <= 100


def test_aliases(spark):
    df = spark.createDataFrame(
        [(1, "12.5", "x", "IRN", "usa", "3")],
        ["txn_id", "Transaction Amount", "Amount Paid", "From Bank", "Receiver Country", "MCC"],
    )
    v3, v2 = canonicalise(df, "v3"), canonicalise(df, "v2")
    assert v3.columns == ["txn_id", "amount", "sender_country", "receiver_country", "mcc"]
    assert v3.first()["amount"] == 12.5
    assert v2.columns == ["txn_id", "amount", "receiver_country", "mcc"]
    assert canonicalise(df, "features").first()["amount"] is None
    with pytest.raises(ValueError):
        canonicalise(df.drop("txn_id"))


def test_stored_source_gives_the_same(spark, folder, txn):
    stored = transactions_table(spark, folder)
    assert "/transactions-" in stored.inputFiles()[0]
    fresh = transactions(spark, folder)
    assert stored.exceptAll(fresh).count() == 0 and stored.count() == fresh.count()
