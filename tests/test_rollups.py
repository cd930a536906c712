"""Roll-ups and listings on small hand-made scored tables."""

from datetime import datetime

from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators import listings, reports, rollups
from tallywatch.operators.rules import score_rules, with_texts
from tallywatch.plans.analysis import analyse
from tallywatch.schema import canonicalise
from tallywatch.streaming.rollups import RollupStates


def table(spark, scores, **columns):
    rows = [(i, s, *(c[i] for c in columns.values())) for i, s in enumerate(scores)]
    types = {"ts": "timestamp", "amount": "double"}
    schema = ", ".join(["txn_id bigint, score int", *(f"{c} {types.get(c, 'string')}" for c in columns)])
    df = spark.createDataFrame(rows, schema).withColumns(
        {
            "flags": F.array(F.lit("f")),
            "breakdown": F.array(F.lit("p +1")),
            "feature_zscore": F.lit(0.0),
        }
    )
    return with_texts(df, C.V3)


def test_elevated_mean(spark):
    def mean(scores):
        df = spark.createDataFrame([(s,) for s in scores], "score int")
        return df.agg(rollups.elevated_mean(F.col("score"))).first()[0]

    assert mean([39, 40, 60]) == 50.0
    assert mean([10, 20]) == 15.0
    assert mean([]) == 0.0


def test_kpis_of_nothing(spark):
    row = rollups.kpis(table(spark, [50], sender_country=["A"], receiver_country=["B"]).limit(0)).first()
    assert (row["total"], row["avg_score"], row["fatf_pct"]) == (0, 0.0, 0.0)


def test_histogram_order(spark):
    rows = rollups.histogram(table(spark, [0, 9, 10, 100, 25])).collect()
    assert [(r["range"], r["count"]) for r in rows] == [("0-10", 2), ("10-20", 1), ("100-110", 1), ("20-30", 1)]


def test_trend_periods(spark):
    days = [datetime(2024, 1, 7, 23), datetime(2024, 1, 8), datetime(2024, 3, 1), None]
    df = table(spark, [80, 20, 10, 90], ts=days, amount=[10.0, None, 5.0, 1.0])
    weekly = [tuple(r) for r in rollups.trend_weekly(df).collect()]
    assert weekly == [("W/01-01", 80.0, 1, 10.0), ("W/01-08", 20.0, 0, None), ("W/02-26", 10.0, 0, 5.0)]
    assert [r["label"] for r in rollups.trend_monthly(df).collect()] == ["2024-01", "2024-03"]
    assert tuple(rollups.trend_view(df).first()) == (53, "weekly")


def test_sequence_trend(spark):
    df = table(spark, list(range(0, 19)), amount=[float(i) for i in range(19)])
    rows = rollups.trend_sequence(df).collect()
    assert [r["label"] for r in rows] == [f"Batch {i}" for i in range(1, 9)]
    assert [r["score"] for r in rows] == [*(2 * i + 0.5 for i in range(7)), 16.0]
    few = rollups.trend_sequence(table(spark, [1, 2, 3], amount=[1.0, 2.0, 3.0])).collect()
    assert [(r["label"], r["avg_amount"]) for r in few] == [("Batch 1", 1.0), ("Batch 2", 2.0), ("Batch 3", 3.0)]


def test_customers(spark):
    df = table(
        spark,
        [30, 85, 40, 39, 10],
        sender_first_name=["Ann", " Ann", None, None, ""],
        sender_last_name=["Lee", "Lee ", None, None, None],
        reference=["r0", "r1", "r2", "", None],
        receiver_country=["usa", "irn", "USA", "USA", "USA"],
        merchant_name=["first", "second", "m", "m", "m"],
    )
    profiles = {r["customer"]: r for r in rollups.customer_profile(df).collect()}
    assert set(profiles) == {"Ann Lee", "r2"}
    ann = profiles["Ann Lee"]
    assert (ann["risk_score"], ann["has_fatf"], ann["history_size"], ann["transactions"]) == (85, True, 1, 2)
    assert ann["work"]["employer"] == "first" and ann["account"]["number"] == "XXXX"
    assert ann["case"]["status"] == "Open" and profiles["r2"]["case"] is None
    assert profiles["r2"]["name"] == "Unknown Customer"
    history = {(r["customer"], r["txn_id"]) for r in rollups.customer_history(df).collect()}
    assert history == {("Ann Lee", 1), ("r2", 2)}


def test_sar_index_is_dense_when_distributed(spark):
    df = table(spark, [80, 10, 90, 70, 69, 75])
    found = listings.sar_candidates(df.repartition(3)).collect()
    assert {r["txn_id"]: r["report_index"] for r in found} == {0: 0, 2: 1, 3: 2, 5: 3}
    assert all(f'"score":{r["score"]}' in r["all_fields"] for r in found)


def test_rollups_add_up(spark, txn):
    scored = score_rules(txn).persist()
    total = txn.count()
    assert rollups.histogram(scored).agg(F.sum("count")).first()[0] == total
    assert rollups.level_summary(scored).agg(F.sum("count")).first()[0] == total
    assert rollups.customer_profile(scored).agg(F.sum("transactions")).first()[0] == total
    sizes = rollups.customer_profile(scored).agg(F.sum("history_size")).first()[0]
    assert sizes == rollups.customer_history(scored).count()


def test_analyse_all_and_without_dates(spark, txn):
    scored = score_rules(txn).persist()
    full = analyse(scored)
    assert len(full) == 21 and all(df.count() > 0 for df in full.values())
    undated = analyse(score_rules(txn.drop("ts", "mcc", "sender_account")).persist())
    assert undated["trend_daily"].count() == 8 and "merchant_data" not in undated and "network_edges" not in undated


def test_report_text(spark):
    raw = spark.createDataFrame(
        [(7, "2024-01-05 10:00:00", "60000", "6012", "USA", "IRN", "Ann", "Lee", "4000111122223333", "REF-0000000077")]
        + [(i, "2024-01-05 10:00:00", "1", "1", "USA", "USA", "B", str(i), "5", "x") for i in range(8, 40)],
        "txn_id bigint, `Transaction Date` string, `Transaction Amount` string, MCC string, `Sender Country` string, "
        "`Receiver Country` string, `Receiver First Name` string, `Receiver Last Name` string, `Card Number` string, "
        "`Transaction Reference` string",
    )
    facts = reports.report_facts(score_rules(canonicalise(raw)))
    rows = reports.report_texts(facts, datetime(2024, 2, 3, 4, 5, 6), closing="To be reviewed").collect()
    assert [r["report"] for r in rows] == [
        "Draft SAR-20240203-REF-000000 of 2024-02-03 04:05:06\n"
        "Transaction REF-0000000077, 2024-01-05 10:00:00, $60,000.00\n"
        "Route: USA to IRN\n"
        "Payee: Ann Lee; card 4000XXXXXXXX3333\n"
        "Merchant: N/A; code 6012\n"
        f"Score: 100 (HIGH); mean {facts.first()['batch_avg_score']:.1f} of 33 rows\n"
        "Found\n1. Very Large Amount (>$50K)\n2. High-Risk MCC 6012 (Financial Institution Merchandise)\n"
        "3. FATF High-Risk Country (Iran)\n4. Round Amount ($1,000 multiple)\n5. Statistical Anomaly (Z=5.57)\n"
        "Points\n1. Large Amount +25\n2. High-Risk MCC +20\n3. FATF +30\n4. Round Amount +10\n5. Z-Score Anomaly +15\n"
        "Amount: 5.57 standard deviations from the mean of the rows\n"
        "Payee country: on the list of high-risk countries\n"
        "Merchant code: on the high-risk list, Financial Institution Merchandise\n"
        "To be reviewed"
    ]


def test_stored_sums_equal_the_direct_roll_ups(spark, txn, tmp_path):
    """After three batches, one of them added twice, the views are those of all rows."""
    scored = score_rules(txn).persist()
    states = RollupStates(str(tmp_path), fan=2)
    assert states.kpis(spark).collect() == rollups.kpis(scored.limit(0)).collect()
    for part in (0, 1, 1, 2):
        states.add(scored.filter(F.col("txn_id") % 3 == part), part)
    pairs = [
        (states.kpis(spark), rollups.kpis(scored)), (states.histogram(spark), rollups.histogram(scored)),
        (states.trend(spark, "daily"), rollups.trend_daily(scored)), (states.trend(spark, "weekly"), rollups.trend_weekly(scored)),
        (states.trend(spark, "monthly"), rollups.trend_monthly(scored)), (states.level_summary(spark), rollups.level_summary(scored)),
        (states.merchant_rollup(spark), rollups.merchant_rollup(scored)), (states.country_rollup(spark), rollups.country_rollup(scored)),
    ]
    for ours, direct in pairs:
        assert ours.columns == direct.columns
        assert list(map(tuple, ours.collect())) == list(map(tuple, direct.collect()))
    scored.unpersist()


def test_stored_sums_of_rows_without_keys(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, None, None, None, None), (2, 6000.0, " 6012.0 ", "IRN", datetime(2024, 1, 31)), (3, None, "", None, datetime(2024, 2, 1))],
        "txn_id bigint, amount double, mcc string, receiver_country string, ts timestamp",
    )
    scored = score_rules(rows)
    states = RollupStates(str(tmp_path))
    states.add(scored, 0)
    for ours, direct in (
        (states.merchant_rollup(spark), rollups.merchant_rollup(scored)),
        (states.country_rollup(spark), rollups.country_rollup(scored)),
        (states.trend(spark, "daily"), rollups.trend_daily(scored)),
    ):
        assert list(map(tuple, ours.collect())) == list(map(tuple, direct.collect()))
