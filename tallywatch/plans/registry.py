"""Every computation as a named query over the given star-schema tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions import text as X
from tallywatch.functions.numbers import row_json
from tallywatch.operators import alerts as A
from tallywatch.operators import features as FT
from tallywatch.operators import attribution, boosting, forest, graph, hybrid, listings, quality, reports, rollups
from tallywatch.operators import rules as R
from tallywatch.plans.models import Models, alert_attributions, load_models, score_batch, train_models
from tallywatch.schema import canonicalise
from tallywatch.session import ensure_checkpoint_dir, written
from tallywatch.sources import files, lookup, tables
from tallywatch.sources.star import read_table, stream_events, transactions, transactions_table
from tallywatch.streaming.scoring import load_snapshots, read_reject_stream, save_snapshots, score_stream, write_stream
from tallywatch.streaming.alerts import AlertStates
from tallywatch.streaming.keyed import KeyedVelocity
from tallywatch.streaming.rolling import RollingScores
from tallywatch.streaming.rollups import RollupStates
from tallywatch.streaming.velocity import RunningVelocity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BATCH = "batch-1"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def scored_v3(spark: SparkSession, folder: str) -> DataFrame:
    return R.score_rules(transactions_table(spark, folder), C.V3)


def over_scored(name: str, operator: Callable[[DataFrame], DataFrame]) -> None:
    """Registers an operator that takes the scored table as it is."""
    QUERIES[name] = lambda spark, folder: operator(scored_v3(spark, folder))


def seconds_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# --- scalar projections -------------------------------------------------------------------------


@query
def txn_canonical(spark: SparkSession, folder: str) -> DataFrame:
    txn = transactions_table(spark, folder)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text")
    return txn.select("txn_id", stamp, *(c for c in txn.columns if c not in ("txn_id", "ts")))


@query
def mcc_normalise(spark: SparkSession, folder: str) -> DataFrame:
    mcc = F.col("mcc")
    return transactions_table(spark, folder).select(
        "txn_id",
        X.normalise_mcc(F.concat(F.lit(" "), mcc)).alias("plain"),
        X.normalise_mcc(F.concat(mcc, F.lit(".9"))).alias("with_fraction"),
        X.normalise_mcc(F.concat(F.lit("0"), mcc)).alias("with_zero"),
        X.normalise_mcc(F.concat(F.lit("x"), mcc, F.lit(" "))).alias("with_letter"),
    )


@query
def country_flags(spark: SparkSession, folder: str) -> DataFrame:
    sender = X.normalise_country(F.concat(F.lit(" "), F.lower("sender_country")))
    receiver = X.normalise_country(F.concat("receiver_country", F.lit("  ")))
    return transactions_table(spark, folder).select(
        "txn_id",
        sender.alias("sender"),
        receiver.alias("receiver"),
        (sender != receiver).alias("is_cross"),
        X.is_fatf(sender).alias("sender_is_fatf"),
        X.is_fatf(receiver).alias("receiver_is_fatf"),
        X.fatf_name(receiver).alias("receiver_fatf_name"),
        X.mcc_name(F.col("mcc")).alias("mcc_name"),
    )


@query
def display_fields(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_v3(spark, folder)
    return scored.select(
        "txn_id",
        listings.receiver_display(scored).alias("receiver"),
        X.masked_card(F.col("card_number")).alias("card"),
        X.flag_count(F.col("flags_text")).alias("flag_count"),
        X.shortened(F.col("flags_text")).alias("flags_short"),
        X.currency(F.col("amount")).alias("amount_text"),
    )


# --- rules --------------------------------------------------------------------------------------


def _outcome(df: DataFrame, outcome: R.Outcome, *more: Column | str) -> DataFrame:
    return df.select("txn_id", outcome.points.alias("points"), outcome.flag.alias("flag"), *more)


@query
def rule_amount(spark: SparkSession, folder: str) -> DataFrame:
    return _outcome(transactions_table(spark, folder), R.amount_rule(F.col("amount")))


@query
def rule_structuring(spark: SparkSession, folder: str) -> DataFrame:
    return _outcome(transactions_table(spark, folder), R.structuring_rule(F.col("amount")))


@query
def rule_mcc(spark: SparkSession, folder: str) -> DataFrame:
    return _outcome(transactions_table(spark, folder), R.mcc_rule(F.col("mcc"))[0])


@query
def rule_geo(spark: SparkSession, folder: str) -> DataFrame:
    return _outcome(transactions_table(spark, folder), R.geography_rule(F.col("sender_country"), F.col("receiver_country"))[0])


@query
def rule_round(spark: SparkSession, folder: str) -> DataFrame:
    outcome, value = R.round_rule(F.col("amount"))
    return _outcome(transactions_table(spark, folder), outcome, value.alias("value"))


@query
def rule_receiver_freq(spark: SparkSession, folder: str) -> DataFrame:
    txn = transactions_table(spark, folder)
    narrow = txn.select("txn_id", "receiver_first_name", "receiver_last_name")
    counted = R.with_receiver_frequency(narrow, R.snapshots_of(narrow))
    return _outcome(counted, R.receiver_rule(F.col("receiver_n")), F.col("receiver_n").alias("n"))


@query
def rule_card_freq(spark: SparkSession, folder: str) -> DataFrame:
    narrow = transactions_table(spark, folder).select("txn_id", "card_number")
    counted = R.with_card_frequency(narrow, R.snapshots_of(narrow))
    return _outcome(counted, R.card_rule(F.col("card_n")), F.col("card_n").alias("n"))


@query
def rule_zscore(spark: SparkSession, folder: str) -> DataFrame:
    txn = transactions_table(spark, folder)
    z = R.zscore(F.col("amount"), R.amount_stats(txn))
    return _outcome(txn, R.zscore_rule(z), F.round(z, 6).alias("z"))


_SCORED = [
    "txn_id", "amount", "sender_account", "receiver_account", "payment_format", "label", "score", "risk_level",
    "flags_text", "breakdown_text",
]


def _flat(scored: DataFrame) -> DataFrame:
    return scored.select(*_SCORED, *(c for c in scored.columns if c.startswith("feature_")))


@query
def rules_v3(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(scored_v3(spark, folder))


@query
def rules_v2(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(R.score_rules(transactions_table(spark, folder), C.V2))


@query
def batch_stats(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.coalesce("amount", F.lit(0.0))
    return transactions_table(spark, folder).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(amount), 6).alias("mean"),
        F.round(F.stddev_samp(amount), 4).alias("std"),
    )


# --- features -----------------------------------------------------------------------------------


def _columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("txn_id", *(column.alias(name) for name, column in columns.items()))


@query
def feat_amount(spark: SparkSession, folder: str) -> DataFrame:
    txn = transactions_table(spark, folder)
    features = FT.amount_features(txn, R.amount_stats(txn))
    features["amount_zscore"] = F.round(features["amount_zscore"], 6)
    return _columns(txn, features)


@query
def feat_time(spark: SparkSession, folder: str) -> DataFrame:
    txn = transactions_table(spark, folder)
    return _columns(txn, FT.time_features(txn))


@query
def feat_geo(spark: SparkSession, folder: str) -> DataFrame:
    txn = transactions_table(spark, folder)
    return _columns(txn, FT.geo_features(txn))


def _with_velocity(spark: SparkSession, folder: str) -> DataFrame:
    narrow = transactions_table(spark, folder).select("txn_id", "ts", "sender_account", "receiver_account")
    return FT.with_velocity(narrow, "sender_account", "receiver_account")


@query
def feat_new_payee(spark: SparkSession, folder: str) -> DataFrame:
    return _with_velocity(spark, folder).select("txn_id", "is_new_payee")


@query
def feat_velocity(spark: SparkSession, folder: str) -> DataFrame:
    return _with_velocity(spark, folder).select("txn_id", *C.VELOCITY_HOURS)


@query
def feat_payment_code(spark: SparkSession, folder: str) -> DataFrame:
    narrow = transactions_table(spark, folder).select("txn_id", "payment_format")
    coded = FT.with_payment_code(narrow, FT.fit_payment_codes(narrow))
    return coded.select("txn_id", "payment_format_encoded")


@query
def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return FT.build_features(transactions_table(spark, folder)).withColumn("amount_zscore", F.round("amount_zscore", 6))


# --- roll-ups, listings, graph ------------------------------------------------------------------

over_scored("kpis", rollups.kpis)
over_scored("batch_kpis", rollups.batch_kpis)
over_scored("level_summary", rollups.level_summary)
over_scored("histogram", rollups.histogram)
over_scored("alert_feed", rollups.alert_feed)
over_scored("trend_daily", rollups.trend_daily)
over_scored("trend_weekly", rollups.trend_weekly)
over_scored("trend_monthly", rollups.trend_monthly)
over_scored("trend_short", rollups.trend_short)
over_scored("trend_view", rollups.trend_view)
over_scored("trend_sequence", rollups.trend_sequence)
over_scored("merchant_rollup", rollups.merchant_rollup)
over_scored("country_rollup", rollups.country_rollup)
over_scored("alert_cards_high", lambda scored: listings.alert_cards(scored, "HIGH"))
over_scored("alert_cards_medium", lambda scored: listings.alert_cards(scored, "MEDIUM"))
over_scored("anomalies", listings.anomalies)
over_scored("fatf_listing", listings.fatf_listing)
over_scored("network_edges", graph.network_edges)
over_scored("network_nodes", graph.network_nodes)
over_scored("sar_facts", reports.report_facts)


def _json_number(name: str) -> Column:
    return F.get_json_object("all_fields", f"$.{name}").cast("double")


def _json_time() -> Column:
    return F.substring(F.get_json_object("all_fields", "$.ts"), 1, 19)


@query
def sar_candidates(spark: SparkSession, folder: str) -> DataFrame:
    listed = listings.sar_candidates(scored_v3(spark, folder))
    return listed.withColumns({"amount": _json_number("amount"), "ts_text": _json_time()}).drop("all_fields")


@query
def row_fields(spark: SparkSession, folder: str) -> DataFrame:
    """All fields of a row as JSON, read back; a number that JSON cannot hold is null there."""
    endless = F.when(F.col("txn_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("amount"))
    scored = scored_v3(spark, folder).withColumn("amount", endless)
    fields = scored.select("txn_id", row_json(scored).alias("all_fields"))
    return fields.select(
        "txn_id",
        _json_number("amount").alias("amount"),
        _json_number("score").cast("int").alias("score"),
        _json_time().alias("ts_text"),
        F.get_json_object("all_fields", "$.sender_account").alias("sender_account"),
        F.get_json_object("all_fields", "$.flags[0]").alias("first_flag"),
    )


@query
def elevated_mean(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_v3(spark, folder)
    return scored.groupBy("risk_level").agg(F.round(rollups.elevated_mean(F.col("score")), 4).alias("elevated_mean"))


@query
def top_transactions(spark: SparkSession, folder: str) -> DataFrame:
    listed = listings.transaction_listing(scored_v3(spark, folder))
    return listed.withColumn("date_text", seconds_text("date")).drop("date")


@query
def customer_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.customer_profile(scored_v3(spark, folder)).select(
        "customer",
        "name",
        F.col("address.country").alias("country"),
        F.col("account.number").alias("card"),
        F.col("work.employer").alias("employer"),
        F.col("work.industry").alias("industry"),
        "risk_score",
        "has_fatf",
        "history_size",
        "transactions",
        F.col("case.status").alias("case_status"),
        F.date_format("case.opened", "yyyy-MM-dd").alias("case_opened"),
        F.col("case.description").alias("case_description"),
    )


@query
def customer_history(spark: SparkSession, folder: str) -> DataFrame:
    history = rollups.customer_history(scored_v3(spark, folder))
    return history.select("customer", "txn_id", "date", "decision", "score", "flags_text")


# --- alerts, tables, reports --------------------------------------------------------------------


def _alerts(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_v3(spark, folder)
    return A.generate_alerts(scored, BATCH, F.col("ts"))


def _actions(scored: DataFrame) -> DataFrame:
    """An action history that follows from the data: who acts depends on the payment format."""
    high = scored.filter(rollups.is_high())
    form = F.col("payment_format")
    resolve = F.when(
        form.isin("purchase", "signup"),
        F.struct(
            F.lit("resolve").alias("action"),
            (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("at"),
            F.concat(F.lit("checked "), F.col("txn_id").cast("string")).alias("note"),
        ),
    )
    escalate = F.when(
        form.isin("error", "signup"),
        F.struct(
            F.lit("escalate").alias("action"),
            (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("at"),
            F.lit(None).cast("string").alias("note"),
        ),
    )
    taken = F.array_compact(F.array(resolve, escalate))
    return high.select(A.alert_id(F.lit(BATCH), F.col("txn_id")).alias("alert_id"), F.inline(taken))


def _state(spark: SparkSession, folder: str) -> DataFrame:
    scored = scored_v3(spark, folder)
    return A.current_state(A.generate_alerts(scored, BATCH, F.col("ts")), _actions(scored))


@query
def alerts_generated(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["alert_id", "txn_id", "reference", "score", "risk_level", "flags_text", "status", "severity"]
    return _alerts(spark, folder).select(*columns)


@query
def alerts_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What an alert keeps of its row."""
    return _alerts(spark, folder).select(
        "alert_id",
        _json_number("amount").alias("amount"),
        _json_time().alias("ts_text"),
        F.get_json_object("all_fields", "$.receiver_country").alias("receiver_country"),
        F.get_json_object("all_fields", "$.risk_level").alias("risk_level"),
        F.size("attributions").alias("attributions"),
    )


def _shown_state(state: DataFrame) -> DataFrame:
    return state.select(
        "alert_id",
        "txn_id",
        "status",
        "severity",
        seconds_text("resolved_at").alias("resolved_at"),
        "resolution_note",
        seconds_text("escalated_at").alias("escalated_at"),
    )


@query
def alerts_after_actions(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_state(_state(spark, folder))


@query
def alerts_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The state of alerts after three deliveries of actions, the second of which comes twice. The rows with alerts are
    scored once: all deliveries and the alerts come from them as stored."""
    scored = written(scored_v3(spark, folder).filter(rollups.is_high()), "high")
    actions = _actions(scored).withColumn("part", F.pmod(F.crc32(F.concat("alert_id", "action").cast("binary")), F.lit(3)))
    states = AlertStates(f"{_run_folder(spark)}/histories", fan=2)
    for delivery, part in enumerate((0, 1, 1, 2)):
        states.add(actions.filter(F.col("part") == part).drop("part"), delivery)
    return _shown_state(states.state(A.generate_alerts(scored, BATCH, F.col("ts"))))


@query
def alerts_listing(spark: SparkSession, folder: str) -> DataFrame:
    return A.list_alerts(_state(spark, folder)).select("alert_id", "txn_id", "score", "status")


@query
def alerts_count(spark: SparkSession, folder: str) -> DataFrame:
    return A.count_alerts(_state(spark, folder), status="escalated")


def _stored(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """A run folder, and the scored table as stored in it."""
    run = _run_folder(spark)
    tables.save_scored(scored_v3(spark, folder), f"{run}/scored", BATCH)
    return run, tables.load_scored(spark, f"{run}/scored", BATCH)


@query
def scored_table(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(_stored(spark, folder)[1])


@query
def export_views(spark: SparkSession, folder: str) -> DataFrame:
    run, scored = _stored(spark, folder)
    tables.write_export(scored, f"{run}/export")
    views = {name: tables.read_export(spark, f"{run}/export", name, scored.schema) for name in tables.export_columns(scored)}
    shown = [
        view.select(
            F.lit(name).alias("name"),
            *(F.col(c) if c in view.columns else F.lit(None).cast("bigint").alias(c) for c in ("txn_id",)),
            *("score", "risk_level", "feature_amount", "feature_fatf", "feature_recv_velocity", "feature_zscore"),
        )
        for name, view in views.items()
    ]
    return shown[0].union(shown[1]).union(shown[2]).union(shown[3])


@query
def lookup_txn(spark: SparkSession, folder: str) -> DataFrame:
    """One row of the stored table; the condition on the id reaches its scan."""
    _, scored = _stored(spark, folder)
    wanted = scored.agg(F.max("txn_id")).first()[0]
    found = tables.lookup_transaction(scored, wanted)
    return found.select("txn_id", "score", "risk_level", "flags_text")


@query
def lookup_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """Rows found by id, by reference and by account, in a layout made for that."""
    path = f"{_run_folder(spark)}/lookup"
    scored = scored_v3(spark, folder).withColumn("reference", F.concat(F.lit("Row-"), F.col("txn_id").cast("string")))
    lookup.save_lookup(scored, path)
    low, high = scored.agg(F.min("txn_id"), F.max("txn_id")).first()
    account = lookup.find(spark, path, "txn_id", high).first()["sender_account"]
    keys = [("id", "txn_id", high), ("reference", "reference", f"Row-{low}"), ("account", "sender_account", account), ("none", "reference", "Row-x")]
    found = [lookup.find(spark, path, key, value).withColumn("how", F.lit(how)) for how, key, value in keys]
    shown = [f.select("how", "txn_id", "reference", "sender_account", "score", "risk_level", "flags_text") for f in found]
    return shown[0].union(shown[1]).union(shown[2]).union(shown[3])


@query
def sar_context(spark: SparkSession, folder: str) -> DataFrame:
    context = reports.batch_context(scored_v3(spark, folder))
    return context.select("total", F.round("avg_score", 6).alias("avg_score"))


# --- blending, on stand-in model outputs that both engines can compute --------------------------


def _stand_ins(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("txn_id")
    return scored_v3(spark, folder).withColumns(
        {
            "probability": (key * 37 % 1000) / F.lit(1000.0),
            "anomaly_raw": -(0.3 + (key * 53 % 700) / F.lit(1000.0)),
        }
    )


def _impacts() -> dict[str, Column]:
    features = {"amount_usd": 7, "is_new_payee": 11, "velocity_24hr": 13}
    return {name: ((F.col("txn_id") * k) % 60) / F.lit(10.0) - 2.0 for name, k in features.items()}


def _modelled(spark: SparkSession, folder: str) -> DataFrame:
    given = _stand_ins(spark, folder)
    low, high = hybrid.raw_range(given)
    anomaly = hybrid.rescaled_anomaly(F.col("anomaly_raw"), low, high)
    return given.withColumn("anomaly", anomaly).withColumn(
        "model", hybrid.model_score(F.col("anomaly"), F.col("probability"))
    )


@query
def iso_rescale(spark: SparkSession, folder: str) -> DataFrame:
    return _modelled(spark, folder).select("txn_id", F.round("anomaly", 9).alias("anomaly"))


@query
def model_blend(spark: SparkSession, folder: str) -> DataFrame:
    return _modelled(spark, folder).select("txn_id", F.round("model", 9).alias("model"))


@query
def rule_model_merge(spark: SparkSession, folder: str) -> DataFrame:
    final = hybrid.merged_score(F.col("score"), F.col("model"))
    merged = _modelled(spark, folder).select("txn_id", final.alias("final_score"))
    return merged.withColumn("risk_level", X.risk_level(F.col("final_score"), C.V3.high, C.V3.medium))


@query
def attribution_topn(spark: SparkSession, folder: str) -> DataFrame:
    top = hybrid.top_attributions(_impacts())
    listed = transactions_table(spark, folder).select("txn_id", F.posexplode(top).alias("place", "a"))
    return listed.select("txn_id", "place", "a.feature", "a.label", "a.impact")


@query
def attribution_penalty(spark: SparkSession, folder: str) -> DataFrame:
    merged = _modelled(spark, folder).withColumns(
        {
            "score": hybrid.merged_score(F.col("score"), F.col("model")),
            "attributions": hybrid.top_attributions(_impacts()),
        }
    )
    return hybrid.apply_penalty(merged).select("txn_id", "score", "risk_level", "flags_text", "breakdown_text")


@query
def weak_labels(spark: SparkSession, folder: str) -> DataFrame:
    return quality.weak_labels(_stand_ins(spark, folder).select("txn_id", "anomaly_raw")).select("txn_id", "label")


@query
def classifier_metrics(spark: SparkSession, folder: str) -> DataFrame:
    given = _stand_ins(spark, folder).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    metrics = quality.classifier_metrics(given)
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "positive_weight")]
    return metrics.select(*rounded, "positives", "negatives")


@query
def without_models(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of a batch for which there are no models: the rules alone."""
    scored = score_batch(transactions_table(spark, folder))
    return scored.select("txn_id", "score", "risk_level", F.size("attributions").alias("attributions"))


@query
def model_store(spark: SparkSession, folder: str) -> DataFrame:
    """Two sets of metrics of the table registered one after the other, and the newest as read back."""
    registry = f"{_run_folder(spark)}/registry"
    given = _stand_ins(spark, folder)
    for version, limit, day in (("early", 0.2, 1), ("late", 0.5, 2)):
        said = given.withColumn("prediction", (F.col("probability") >= limit).cast("int"))
        found = quality.classifier_metrics(said).first()
        metrics = {name: found[name] for name in ("precision", "recall", "f1")}
        rows = found["positives"] + found["negatives"]
        at = datetime(2024, 1, day)
        tables.register_model(
            spark, registry, model_version=version, trained_at=at, dataset_rows=rows, classifier_path="c", **metrics
        )
    entry = tables.latest_model(spark, registry)
    newest = spark.createDataFrame(
        [(entry["model_version"], entry["dataset_rows"], entry["precision"], entry["recall"], entry["f1"])],
        "model_version string, dataset_rows bigint, precision double, recall double, f1 double",
    )
    rounded = {c: F.round(c, 9) for c in ("precision", "recall", "f1")}
    return newest.withColumns(rounded).withColumn("ready", F.lit(tables.models_ready(spark, registry)))


# --- streams: the events table arriving as files ------------------------------------------------


def _run_folder(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


@query
def stream_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """All events scored as a stream against the snapshots of the table."""
    run = _run_folder(spark)
    save_snapshots(R.snapshots_of(transactions_table(spark, folder)), f"{run}/snapshots")
    incoming = transactions(spark, folder, stream_events(spark, folder))
    scored = score_stream(incoming, load_snapshots(spark, f"{run}/snapshots"))
    write_stream(_flat(scored), f"{run}/scored", f"{run}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{run}/scored")


@query
def stream_scoring_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """All events in four deliveries by id, each scored against everything delivered before it."""
    run = _run_folder(spark)
    events = read_table(spark, folder, "events")
    rolling = RollingScores(f"{run}/rolling", fan=2)
    for part in range(4):
        events.filter(F.col("event_id") % 4 == part).write.parquet(f"{run}/incoming/events-{part}.parquet")
        incoming = transactions(spark, folder, stream_events(spark, f"{run}/incoming/*"))
        rolling.start(incoming, f"{run}/checkpoint").awaitTermination()
    return _flat(rolling.results(spark))


# A booster of a base and two fixed trees: (tree, node, feature, threshold, lower, upper, value, cover).
_FIXED_BOOSTER = [
    (0, 0, None, None, -1, -1, -1.0, 100.0),
    (1, 0, "amount_usd", 10000.0, 1, 2, 0.0, 100.0), (1, 1, None, None, -1, -1, -0.5, 70.0),
    (1, 2, "is_cross_border", 0.5, 5, 6, 0.0, 30.0), (1, 5, None, None, -1, -1, 0.25, 10.0), (1, 6, None, None, -1, -1, 1.5, 20.0),
    (2, 0, "hour_of_day", 12.0, 1, 2, 0.0, 100.0), (2, 1, None, None, -1, -1, 0.3, 50.0), (2, 2, None, None, -1, -1, -0.2, 50.0),
]


def _fixed_models(spark: SparkSession, folder: str) -> Models:
    """Models that both engines can walk, with the payment codes of the table."""
    place = {name: i for i, name in enumerate(C.FEATURE_COLUMNS)}
    nodes = spark.createDataFrame(
        [(t, n, place.get(f, -1), at, low, up, value, 0.0, 0.0, cover) for t, n, f, at, low, up, value, cover in _FIXED_BOOSTER],
        boosting.NODE_SCHEMA,
    )
    return Models(
        classifier=boosting.Booster.from_nodes(nodes),
        forest=_fixed_forest(spark),
        codes=FT.fit_payment_codes(transactions_table(spark, folder)),
        raw_low=-0.8,
        raw_high=-0.4,
        leaf_tables=attribution.build_tables(nodes),
        version="fixed",
    )


@query
def stream_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    """All events scored as a stream by rules and fixed models, each row on its own."""
    run = _run_folder(spark)
    save_snapshots(R.snapshots_of(transactions_table(spark, folder)), f"{run}/snapshots")
    incoming = transactions(spark, folder, stream_events(spark, folder))
    scored = score_stream(incoming, load_snapshots(spark, f"{run}/snapshots"), _fixed_models(spark, folder))
    shown = scored.select("txn_id", "score", "risk_level", F.round("model_score", 6).alias("model_score"))
    write_stream(shown, f"{run}/scored", f"{run}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{run}/scored")


@query
def rollup_states(spark: SparkSession, folder: str) -> DataFrame:
    """All views of the dashboard from the stored sums of three batches."""
    scored = scored_v3(spark, folder)
    states = RollupStates(f"{_run_folder(spark)}/sums", fan=2)
    for part in range(3):
        states.add(scored.filter(F.col("txn_id") % 3 == part), part)

    def shown(view: str, df: DataFrame, label: str | Column, **values: str) -> DataFrame:
        kinds = {"n": "bigint", "score": "double", "high_count": "bigint", "avg_amount": "double"}
        name = F.col(label) if isinstance(label, str) else label
        cells = (F.col(values[c]).cast(k).alias(c) if c in values else F.lit(None).cast(k).alias(c) for c, k in kinds.items())
        return df.select(F.lit(view).alias("view"), name.alias("label"), *cells)

    trends = states.trends(spark).select(
        F.concat(F.lit("trend_"), "view").alias("view"), "label", F.lit(None).cast("bigint").alias("n"), "score", "high_count", "avg_amount"
    )
    views = [
        shown("kpis", states.kpis(spark), F.lit("all"), n="total", score="avg_score", high_count="high"),
        shown("border", states.kpis(spark), F.lit("all"), n="cross_border_count", score="fatf_pct"),
        shown("histogram", states.histogram(spark), "range", n="count"),
        shown("level_summary", states.level_summary(spark), "risk_level", n="count", score="avg_score", high_count="max_score"),
        shown("merchant_rollup", states.merchant_rollup(spark), "mcc", n="count", score="avg_score"),
        shown("country_rollup", states.country_rollup(spark), "country", n="count"),
    ]
    for view in views:
        trends = trends.unionByName(view)
    return trends


@query
def stream_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """All events in three deliveries, velocities and payees carried from one to the next."""
    run = _run_folder(spark)
    events = read_table(spark, folder, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    delivery = F.floor((micros - low) / ((high - low) // 3 + 1))
    running = RunningVelocity(f"{run}/state")
    for part in range(3):
        arrived = events.filter(delivery == part)
        arrived.write.parquet(f"{run}/incoming/events-{part}.parquet")
        incoming = transactions(spark, folder, stream_events(spark, f"{run}/incoming/*"))
        running.start(incoming, f"{run}/checkpoint").awaitTermination()
    return running.results(spark).select("txn_id", *C.VELOCITY_HOURS, "is_new_payee")


def _delivered(spark: SparkSession, folder: str, deliveries: Column, count: int) -> KeyedVelocity:
    """All transactions through the keyed state, ``deliveries`` naming the number of each row's delivery; a heartbeat
    at the end moves the watermark past all of them."""
    run = _run_folder(spark)
    rows = transactions_table(spark, folder).select("txn_id", "ts", "sender_account")
    running = KeyedVelocity(f"{run}/state")
    beat = spark.createDataFrame([(None, datetime(2100, 1, 1), None)], rows.schema)
    for part in range(count + 1):
        arrived = rows.filter(deliveries == part) if part < count else beat
        arrived.write.parquet(f"{run}/incoming/{part}")
        incoming = spark.readStream.schema(rows.schema).parquet(f"{run}/incoming/*")
        running.start(incoming, f"{run}/checkpoint").awaitTermination()
    return running


@query
def stream_state_velocity(spark: SparkSession, folder: str) -> DataFrame:
    """Velocities of all transactions by keyed state, delivered in three parts in the order of their times."""
    low, high = transactions_table(spark, folder).agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - low) / ((high - low) // 3 + 1))
    return _delivered(spark, folder, part, 3).results(spark)


@query
def stream_state_late(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth transaction comes after all others: what the watermark has passed is late and not counted."""
    running = _delivered(spark, folder, (F.col("txn_id") % 50 == 0).cast("int"), 2)
    late = running.late(spark).select("txn_id", F.lit(True).alias("late"), *(F.lit(None).cast("bigint").alias(c) for c in C.VELOCITY_HOURS))
    return running.results(spark).select("txn_id", F.lit(False).alias("late"), *C.VELOCITY_HOURS).unionByName(late)


# --- models -------------------------------------------------------------------------------------

_TRAINED: dict[str, Models] = {}


def trained_models(spark: SparkSession, folder: str) -> Models:
    """Models trained on the whole table, once per session and folder."""
    key = f"{spark.sparkContext.applicationId}:{folder}"
    if key not in _TRAINED:
        store = f"{_run_folder(spark)}/models"
        train_models(transactions_table(spark, folder), store)
        _TRAINED[key] = load_models(spark, store)
    return _TRAINED[key]


@query
def split_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the hold-out per label."""
    rows = quality.stratified_split(transactions_table(spark, folder).select("txn_id", "label"))
    held = F.avg(F.col("is_test").cast("double"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(held, 4).alias("test_share"))


@query
def forest_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A forest grown from the table, and the raw score of every row by it."""
    txn = transactions_table(spark, folder)
    stats = R.amount_stats(txn)
    path = f"{_run_folder(spark)}/features"
    FT.build_features(txn, stats).write.parquet(path)
    features = spark.read.parquet(path)
    grown = forest.Forest.from_nodes(*forest.fit_forest(features, stats.rows))
    return forest.with_anomaly_raw(features, grown).select("txn_id", "anomaly_raw")


@query
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    features = FT.build_features(transactions_table(spark, folder))
    rated = boosting.with_probability(features, trained_models(spark, folder).classifier)
    return rated.select("txn_id", "probability", "prediction")


# A forest of two fixed trees, so that both engines can walk it: nodes in order, -1 at a leaf.
_FIXED_TREES = [  # (feature, threshold, lower, upper, path)
    [("amount_usd", 10000.0, 1, 2, 0.0), (None, 0.0, 1, 1, 1.0), ("amount_usd", 30000.0, 3, 4, 0.0),
     (None, 0.0, 3, 3, 2.5), (None, 0.0, 4, 4, 2.0)],
    [("is_cross_border", 0.5, 1, 2, 0.0), (None, 0.0, 1, 1, 1.0), ("hour_of_day", 12.0, 3, 4, 0.0),
     (None, 0.0, 3, 3, 2.0), (None, 0.0, 4, 4, 3.0)],
]


def _fixed_forest(spark: SparkSession) -> forest.Forest:
    rows = [
        (t, i, C.FEATURE_COLUMNS.index(feature) if feature else -1, threshold, lower, upper, path)
        for t, tree in enumerate(_FIXED_TREES)
        for i, (feature, threshold, lower, upper, path) in enumerate(tree)
    ]
    return forest.Forest.from_nodes(spark.createDataFrame(rows, forest.NODE_SCHEMA), 8)


@query
def forest_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Raw anomaly scores of all rows by a fixed forest."""
    features = FT.build_features(transactions_table(spark, folder))
    scored = forest.with_anomaly_raw(features, _fixed_forest(spark))
    return scored.select("txn_id", F.round("anomaly_raw", 9).alias("anomaly_raw"))


# Bin edges of the features for trees that both engines can grow: a value lies below the first edge it does not exceed.
_FIXED_EDGES = {
    "amount_usd": [100, 500, 1000, 2000, 3000, 5000, 8000, 9000, 10000, 20000, 50000, 100000],
    "amount_zscore": [-0.9, -0.7, -0.5, -0.25, 0.05, 0.35, 0.75, 1.25, 2.15],
    "hour_of_day": list(range(23)),
    "payment_format_encoded": list(range(10)),
    "velocity_1hr": [1, 2, 3, 5],
    "velocity_6hr": [1, 2, 3, 5, 8],
    "velocity_24hr": [1, 2, 3, 5, 8, 12],
}


@query
def gbt_first_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The first tree of a booster on fixed bins: splits, gains and sums of every node."""
    edges = tuple(np.array(_FIXED_EDGES.get(c, [0]), float) for c in C.FEATURE_COLUMNS)
    rows = feature_matrix(spark, folder)
    counts = quality.class_counts(rows)[1::-1]
    path = f"{_run_folder(spark)}/first-tree"
    nodes = boosting.boost(rows, path, (1.0, 8.0), counts, 1, 3, C.BOOST_RATE, bins=boosting.Bins(edges))
    name = F.get(F.array(*(F.lit(c) for c in C.FEATURE_COLUMNS)), F.col("feature"))
    return nodes.filter("tree_id = 1").select(
        "node_id", F.when(F.col("feature") >= 0, name).alias("feature"), "threshold", "gain", "gradient", "cover", "value"
    )


@query
def gbt_residual(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose attributions and base do not add up to the log-odds, or whose probability is not
    that of the log-odds."""
    models = trained_models(spark, folder)
    features = FT.build_features(transactions_table(spark, folder))
    explained = attribution.with_impacts(features, models.leaf_tables)
    total = F.aggregate("impacts", F.lit(models.leaf_tables.base), lambda a, b: a + b)
    rated = boosting.with_probability(explained.withColumn("total", total), models.classifier)
    off = F.abs(F.col("probability") - 1 / (1 + F.exp(-F.col("total")))) > 1e-9
    return rated.agg(F.count(F.lit(1)).alias("n"), F.count_if(off).alias("off"))


@query
def gbt_attributions(spark: SparkSession, folder: str) -> DataFrame:
    features = FT.build_features(transactions_table(spark, folder))
    explained = attribution.with_attributions(features, trained_models(spark, folder).leaf_tables)
    listed = explained.select("txn_id", F.posexplode("attributions").alias("place", "a"))
    return listed.select("txn_id", "place", "a.feature", "a.label", "a.impact")


@query
def hybrid_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Rules, both models and the attribution penalty, from raw rows to final score."""
    scored = score_batch(transactions_table(spark, folder), C.V2, trained_models(spark, folder), penalise=True)
    return scored.select("txn_id", "score", "risk_level", "model_score", "flags_text", "breakdown_text")


@query
def alerts_explained(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts with attributions recomputed from their stored fields."""
    models = trained_models(spark, folder)
    explained = A.explain_alerts(_alerts(spark, folder), lambda missing: alert_attributions(missing, models))
    listed = explained.select("alert_id", "score", F.posexplode("attributions").alias("place", "a"))
    return listed.select("alert_id", "score", "place", "a.feature", "a.label", "a.impact")


@query
def sar_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The report drafts, generated as of the last transaction."""
    scored = scored_v3(spark, folder)
    latest = scored.agg(F.max("ts")).first()[0]
    return reports.report_texts(reports.report_facts(scored), latest)


# --- sources: the table written in each accepted layout and read back ---------------------------


@query
def source_labelled_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{_run_folder(spark)}/labelled"
    columns = {
        "Timestamp": F.date_format("ts", "yyyy/MM/dd HH:mm"),
        "From Bank": F.col("sender_country"),
        "Account": F.col("sender_account"),
        "To Bank": F.col("receiver_country"),
        "Account.1": F.col("receiver_account"),
        "Amount Received": F.lit(0.0),
        "Receiving Currency": F.lit("US Dollar"),
        "Amount Paid": F.col("amount"),
        "Payment Currency": F.lit("US Dollar"),
        "Payment Format": F.col("payment_format"),
        "Is Laundering": F.col("label"),
    }
    written = transactions_table(spark, folder).select(*(column.alias(name) for name, column in columns.items()))
    written.write.option("header", True).csv(path)
    rows = canonicalise(files.read_labelled_csv(spark, path), "features")
    return rows.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"),
        *("amount", "sender_account", "receiver_account", "sender_country", "receiver_country"),
        *("payment_format", "label"),
    )


@query
def source_sheet_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A sheet with padded headers and text, and with blanks spelled in three ways."""
    path = f"{_run_folder(spark)}/sheet"
    form = F.col("payment_format")
    merchant = F.when(form == "error", "nan").when(form == "click", "None").when(form != "view", F.col("merchant_name"))
    columns = {
        " transaction_reference_number ": F.col("txn_id").cast("string"),
        "Transaction Date": F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        "Transaction Amount ": F.when(form == "signup", "n/a").otherwise(F.col("amount").cast("string")),
        "MCC": F.concat("mcc", F.lit(".0")),
        "Merchant Name": merchant,
    }
    written = transactions_table(spark, folder).select(*(column.alias(name) for name, column in columns.items()))
    written.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    rows = canonicalise(files.read_sheet_csv(spark, path), "v2")
    return rows.select(
        "reference", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"), "amount", "mcc", "merchant_name"
    )


@query
def source_json(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{_run_folder(spark)}/json"
    transactions_table(spark, folder).select(
        "amount",
        "mcc",
        "sender_account",
        F.lower("sender_country").alias("sender_country"),
        "receiver_country",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("transaction_date"),
        F.col("txn_id").cast("string").alias("transaction_reference"),
    ).write.json(path)
    return files.read_json(spark, path).select(
        "reference",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"),
        *("amount", "mcc", "sender_account", "sender_country", "receiver_country", "receiver_account"),
    )


@query
def source_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What is refused of a sheet, of JSON lines and of a stream of them with faults planted by id: broken quotes,
    short rows, amounts that are missing or no numbers, and lines that are not JSON."""
    run = _run_folder(spark)
    txn = transactions_table(spark, folder)
    key, kind = F.col("txn_id").cast("string"), F.col("txn_id") % 20
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    amount = F.when(kind == 1, "").when(kind == 2, "12,5x").otherwise(F.col("amount").cast("string"))
    quoted = F.when(kind == 2, F.concat(F.lit('"'), amount, F.lit('"'))).otherwise(amount)
    name = F.when(kind == 3, F.concat(F.lit('"'), "merchant_name")).otherwise(F.col("merchant_name"))
    line = F.when(kind == 4, F.concat_ws(",", key, stamp)).otherwise(F.concat_ws(",", key, stamp, quoted, name, "mcc"))
    sheet = txn.select(line.alias("Transaction Reference Number,Transaction Date,Transaction Amount,Merchant Name,MCC"))
    # One column under quotes and separators that do not occur, so that the lines go out as they are.
    sheet.write.option("header", True).option("quote", "\u0000").option("sep", "\u0001").csv(f"{run}/sheet")

    given = F.to_json(F.struct(key.alias("transaction_reference"), F.when(kind != 5, F.col("amount")).alias("amount"), "mcc"))
    broken = F.when(kind == 6, F.concat(F.lit("{"), key, F.lit(" is no JSON"))).otherwise(given)
    txn.select(broken.alias("value")).write.text(f"{run}/json")
    write_stream(read_reject_stream(spark, f"{run}/json"), f"{run}/rejects", f"{run}/checkpoint").awaitTermination()

    rejects = files.csv_rejects(spark, f"{run}/sheet", "v2")
    rejects = rejects.unionByName(files.named_rejects(files.json_records(spark, f"{run}/json"), "json"))
    rejects = rejects.unionByName(spark.read.parquet(f"{run}/rejects"))
    found = F.coalesce(F.nullif(F.regexp_extract("record", '[Rr]eference[^:]*":"(\\d+)"', 1), F.lit("")), F.regexp_extract("record", "(\\d+)", 1))
    return rejects.select("source", "reason", found.cast("bigint").alias("txn_id"))
