"""Alert life cycle, blending and penalties."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators import alerts as A
from tallywatch.operators import hybrid, quality
from tallywatch.operators.rules import score_rules, with_texts
from tallywatch.streaming.alerts import AlertStates

NOW = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def alerts(spark, txn):
    return A.generate_alerts(score_rules(txn), "b", NOW).persist()


def test_generation(alerts):
    row = alerts.orderBy("txn_id").first()
    assert (row["status"], row["severity"], row["created_at"], row["attributions"]) == ("open", "danger", NOW, [])
    assert '"risk_level":"HIGH"' in row["all_fields"]
    assert alerts.select("alert_id").distinct().count() == alerts.count() == 72


def test_actions(spark, alerts):
    ids = [r[0] for r in alerts.orderBy("txn_id").select("alert_id").limit(3).collect()]
    at = [datetime(2024, 1, 2, h) for h in range(4)]
    actions = spark.createDataFrame(
        [
            (ids[0], "resolve", at[0], "fine"),
            (ids[0], "escalate", at[1], None),
            (ids[0], "resolve", at[2], None),
            (ids[1], "escalate", at[3], "look"),
            ("unknown", "resolve", at[0], None),
        ],
        A.ACTION_SCHEMA,
    )
    state = {r["alert_id"]: r for r in A.current_state(alerts, actions).collect()}
    assert len(state) == 72
    first, second, third = (state[i] for i in ids)
    assert (first["status"], first["resolved_at"], first["resolution_note"]) == ("resolved", at[2], "fine")
    assert first["escalated_at"] == at[1] and first["severity"] == "danger"
    assert (second["status"], second["escalation_note"], third["status"]) == ("escalated", "look", "open")
    current = A.current_state(alerts, actions)
    assert A.count_alerts(current, "high", "OPEN").first()[0] == 70
    assert A.list_alerts(current, limit=1).first()["status"] == "open"
    assert A.list_alerts(current, limit=500).count() == 72
    assert [r["status"] for r in A.list_alerts(current, limit=500).collect()][-2:] != ["open", "open"]
    assert A.list_alerts(current).count() == 72
    with pytest.raises(ValueError):
        A.list_alerts(current, limit=0)


def test_explain(spark):
    entry = [("amount_usd", "Transaction Amount", 2.0)]
    rows = [("a", "r", 80, "HIGH", entry, "f"), ("b", "r", 80, "HIGH", [], "f"), ("c", "r", 80, "HIGH", [], "f")]
    schema = f"alert_id string, reference string, score int, risk_level string, attributions {hybrid.ATTRIBUTION_TYPE}, flags_text string"
    df = spark.createDataFrame(rows, schema)
    asked = []

    def recompute(missing):
        asked.extend(sorted(r[0] for r in missing.select("alert_id").collect()))
        return spark.createDataFrame([("b", entry)], f"alert_id string, attributions {hybrid.ATTRIBUTION_TYPE}")

    got = {r["alert_id"]: len(r["attributions"]) for r in A.explain_alerts(df, recompute).collect()}
    assert asked == ["b", "c"] and got == {"a": 1, "b": 1, "c": 0}
    assert A.explain_alerts(df).count() == 3


def penalised(spark, impacts, score=50):
    entries = [("f", f"L{i}", v) for i, v in enumerate(impacts)]
    df = spark.createDataFrame([(1, score, entries)], f"txn_id bigint, score int, attributions {hybrid.ATTRIBUTION_TYPE}")
    df = df.withColumns({"flags": F.array().cast("array<string>"), "breakdown": F.array().cast("array<string>")})
    return hybrid.apply_penalty(with_texts(df, C.V3)).first()


def test_penalty(spark):
    none = penalised(spark, [0.0005, 1.4999, -9.0])
    assert (none["score"], none["flags_text"], none["breakdown_text"]) == (50, "No flags", "No risk points scored")
    one = penalised(spark, [1.5])
    assert (one["score"], one["flags_text"]) == (57, "AI Risk Indicator: L0 (+7 pts)")
    assert one["breakdown_text"] == "ML Interpretability Penalty +7"
    two = penalised(spark, [2.0, 9.0])
    assert two["score"] == 90 and two["risk_level"] == "HIGH"
    assert two["flags"] == ["AI Risk Indicator: L0 (+15 pts)", "AI Risk Indicator: L1 (+30 pts)"]
    assert penalised(spark, [3.0, 9.0], 80)["score"] == 100
    assert penalised(spark, [])["score"] == 50


def test_blend_edges(spark):
    df = spark.createDataFrame([(-0.5,), (-0.4,)], "raw double")
    one = df.select(hybrid.rescaled_anomaly(F.col("raw"), -0.5, -0.4)).collect()
    assert [r[0] for r in one] == [1.0, 0.0]
    flat = df.limit(1).select(hybrid.rescaled_anomaly(F.col("raw"), -0.5, -0.5)).first()[0]
    assert flat == 1.0
    halves = spark.createDataFrame([(50, 51.25), (50, 53.75)], "s int, m double")
    merged = [r[0] for r in halves.select(hybrid.merged_score(F.col("s"), F.col("m"))).collect()]
    assert merged == [50, 52]


def test_top_attributions(spark):
    impacts = {"a": F.lit(0.0005), "b": F.lit(-2.0), "c": F.lit(2.0), "d": F.lit(1.23456), "e": F.lit(0.5)}
    got = spark.range(1).select(hybrid.top_attributions(impacts)).first()[0]
    assert [(e["feature"], e["impact"]) for e in got] == [("b", -2.0), ("c", 2.0), ("d", 1.2346)]


def test_metrics_without_hits(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "prediction int, label int")
    row = quality.classifier_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["positive_weight"]) == (0.0, 0.0, 0.0, 1.0)


def test_split_is_stratified_and_stable(spark):
    df = spark.range(20000).select(F.col("id").alias("txn_id"), (F.col("id") % 50 == 0).cast("int").alias("label"))
    split = quality.stratified_split(df)
    shares = {r["label"]: r["s"] for r in split.groupBy("label").agg(F.avg(F.col("is_test").cast("int")).alias("s")).collect()}
    assert abs(shares[0] - 0.2) < 0.02 and abs(shares[1] - 0.2) < 0.08
    again = quality.stratified_split(df.repartition(9))
    assert split.filter("is_test").exceptAll(again.filter("is_test")).count() == 0


def test_deliveries_of_actions_add_up(spark, txn, tmp_path):
    made = A.generate_alerts(score_rules(txn), "b", F.col("ts")).persist()
    ids = [r["alert_id"] for r in made.orderBy("alert_id").limit(12).collect()]
    t0 = datetime(2024, 5, 1)
    history = [
        (a, ("resolve", "escalate")[(i + k) % 2], t0 + timedelta(minutes=7 * i + 31 * k), f"n{k}" if k % 2 else None)
        for i, a in enumerate(ids)
        for k in range(4)
    ] + [("unknown", "resolve", t0, "x"), (None, "resolve", t0, "y")]
    actions = spark.createDataFrame(history, A.ACTION_SCHEMA)
    states = AlertStates(str(tmp_path / "state"), fan=2)
    parts = [actions.filter(F.pmod(F.xxhash64("alert_id", "at"), F.lit(3)) == i) for i in range(3)]
    for delivery, part in ((0, 2), (1, 0), (1, 0), (2, 1), (3, 0)):  # out of order, one again and one under another number
        states.add(parts[part], delivery)
    want = sorted(map(repr, A.current_state(made, actions).collect()))
    assert sorted(map(repr, states.state(made).collect())) == want
    one = states.one(made, ids[3])
    assert [r["status"] for r in one.collect()] == [r["status"] for r in states.state(made).filter(F.col("alert_id") == ids[3]).collect()]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert len(states.store.manifest(spark)) <= 3
    made.unpersist()


def test_deliveries_do_not_score_again(spark, folder):
    from tallywatch.plans.registry import QUERIES

    state = QUERIES["alerts_incremental"](spark, folder)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "/high-" in plan and "/transactions-" not in plan
    whole = QUERIES["alerts_after_actions"](spark, folder)
    assert sorted(map(str, state.collect())) == sorted(map(str, whole.collect()))


def test_a_stream_of_actions(spark, txn, tmp_path):
    made = A.generate_alerts(score_rules(txn), "b", F.col("ts"))
    ids = [r["alert_id"] for r in made.orderBy("alert_id").limit(2).collect()]
    states = AlertStates(str(tmp_path / "state"))
    for i, action in enumerate(("escalate", "resolve")):
        rows = [(ids[0], action, datetime(2024, 1, 1 + i), "note")]
        spark.createDataFrame(rows, A.ACTION_SCHEMA).write.mode("append").parquet(str(tmp_path / "actions"))
        incoming = spark.readStream.schema(A.ACTION_SCHEMA).parquet(str(tmp_path / "actions"))
        states.start(incoming, str(tmp_path / "checkpoint")).awaitTermination()
    found = {r["alert_id"]: (r["status"], r["severity"]) for r in states.state(made).filter(F.col("alert_id").isin(ids)).collect()}
    assert found == {ids[0]: ("resolved", "danger"), ids[1]: ("open", "danger")}
