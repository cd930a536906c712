"""Features on time edges and under skew, against plain counting."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators import features as FT
from tallywatch.operators.ranking import block_of, order_statistics, ordered_index
from tallywatch.operators.rules import amount_stats
from tallywatch.operators.velocity import with_velocity

T0 = datetime(2024, 1, 5, 12, 0, 0)
MICRO = timedelta(microseconds=1)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "txn_id bigint, ts timestamp, sender_account string, receiver_account string",
    )


def brute(rows):
    """Counting pair by pair."""
    out = []
    first = {}
    for i, (ts, sender, receiver) in enumerate(rows):
        place = (ts is None, ts or T0, i)
        pair = (sender or "", receiver or "")
        first[pair] = min(first.get(pair, place), place)
    for ts, sender, receiver in rows:
        key = sender or ""
        counts = [
            1
            if ts is None
            else sum(1 for t, s, _ in rows if (s or "") == key and t is not None and ts - timedelta(hours=h) < t <= ts)
            for h in (1, 6, 24)
        ]
        out.append((*counts, int(first[key, receiver or ""][2] == len(out))))
    return out


def edge_rows():
    rows = [(T0, "a", "x"), (T0, "a", "x"), (T0, "b", "x"), (None, "a", "y"), (T0, None, "x"), (T0, None, None)]
    for hours in (1, 6, 24):
        rows += [(T0 + timedelta(hours=hours), "a", "y"), (T0 + timedelta(hours=hours) - MICRO, "a", "z")]
        rows += [(T0 + timedelta(hours=hours) + MICRO, "a", "w")]
    rows += [(T0 + timedelta(seconds=31 * i, microseconds=i * i), "a", f"p{i % 5}") for i in range(60)]
    rows += [(T0 + timedelta(minutes=17 * i), "c", f"p{i % 3}") for i in range(120)]
    rows += [(datetime(1969, 12, 31, 23, 59, 58) + timedelta(seconds=i), "old", "x") for i in range(4)]
    return rows


def test_velocity_and_payees(spark):
    rows = edge_rows()
    df = with_velocity(frame(spark, rows), "sender_account", "receiver_account")
    got = df.orderBy("txn_id").select(*C.VELOCITY_HOURS, "is_new_payee").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_features_without_columns(spark):
    df = spark.createDataFrame([(1, "x")], "txn_id bigint, mcc string")
    row = FT.build_features(df).first().asDict()
    assert row == {
        "txn_id": 1, "amount_usd": 0.0, "amount_zscore": 0.0, "is_round_1k": 0, "is_round_500": 0,
        "is_just_below_threshold": 0, "hour_of_day": 12, "is_weekend": 0, "is_odd_hours": 0, "is_cross_border": 0,
        "is_fatf_country": 0, "is_new_payee": 0, "payment_format_encoded": 0, "velocity_1hr": 1, "velocity_6hr": 1,
        "velocity_24hr": 1,
    }


def test_time_features(spark):
    times = [datetime(2024, 1, 5, 22, 59), datetime(2024, 1, 5, 23, 0), datetime(2024, 1, 6, 0, 0),
             datetime(2024, 1, 7, 4, 59), datetime(2024, 1, 8, 5, 0), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "txn_id bigint, ts timestamp")
    cols = FT.time_features(df)
    got = [tuple(r) for r in df.orderBy("txn_id").select(*cols.values()).collect()]
    assert got == [(22, 0, 0), (23, 0, 1), (0, 1, 1), (4, 1, 1), (5, 0, 0), (12, 0, 0)]


def test_no_frame_moves(spark):
    df = with_velocity(frame(spark, edge_rows()), "sender_account", "receiver_account")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\((\w+, [^,]+),", plan)
    assert len(frames) == 2 and all("unboundedpreceding" in f for f in frames)


def test_payment_codes(spark):
    df = spark.createDataFrame(
        [(i, f) for i, f in enumerate(["Wire", "ACH", None, "ACH", "Cash", "Wire"])],
        "txn_id bigint, payment_format string",
    )
    codes = FT.fit_payment_codes(df)
    new = df.unionByName(spark.createDataFrame([(9, "Crypto")], df.schema))
    got = FT.with_payment_code(new, codes).orderBy("txn_id").select("payment_format_encoded").collect()
    assert [r[0] for r in got] == [3, 0, 2, 0, 1, 3, -1]


def test_feature_layout_does_not_matter(spark, txn):
    stats = amount_stats(txn)  # its last bits depend on the order of summation
    usual = sorted(map(tuple, FT.build_features(txn, stats).collect()))
    assert usual == sorted(map(tuple, FT.build_features(txn.repartition(5), stats).collect()))


def test_ordered_index(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "k bigint").repartition(6)
    got = ordered_index(df, ["k"], "place").collect()
    assert sorted((r["k"], r["place"]) for r in got) == [(i, i) for i in range(101)]


@pytest.mark.parametrize("error", [1e-3, 0.2])
def test_order_statistics(spark, error):
    big = 2**61
    df = spark.createDataFrame([(big + i * 3,) for i in range(1000)], "k bigint").repartition(5)
    assert order_statistics(df, "k", [0, 1, 499, 999], 1000, error=error) == [big + 3 * i for i in (0, 1, 499, 999)]
    ties = spark.createDataFrame([(i, float(i // 400)) for i in range(1000)], "i bigint, v double")
    assert order_statistics(ties, "v", [0, 399, 400, 999], 1000, tie="i", error=error) == [0.0, 0.0, 1.0, 2.0]


def test_block_of(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "k int")
    assert [r[0] for r in df.orderBy("k").select(block_of(F.col("k"), [0, 2, 5])).collect()] == [0, 0, 1, 1, 1, 2]


def test_wide_rows_cross_one_shuffle(spark, txn):
    """Velocities travel on four columns; whatever else a row has is shuffled once, by its id."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = txn.drop("payment_format")  # its codes are a join of their own
        df = FT.build_features(rows, amount_stats(rows))
        wide, pending = 0, [df._jdf.queryExecution().executedPlan()]
        while pending:
            node = pending.pop()
            if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                wide += "amount_zscore" in node.output().toString()
            pending += [node.children().apply(i) for i in range(node.children().size())]
        assert wide == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_velocities_from_a_narrow_source(spark):
    rows = frame(spark, edge_rows())
    wide = rows.withColumn("more", F.col("txn_id") * 2)
    got = with_velocity(wide, "sender_account", "receiver_account", rows).drop("more")
    want = with_velocity(rows, "sender_account", "receiver_account")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
