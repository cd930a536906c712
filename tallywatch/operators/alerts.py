"""Alerts: generation from HIGH rows, action history, listing and explanation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywatch.functions.numbers import row_json
from tallywatch.operators.hybrid import ATTRIBUTION_TYPE
from tallywatch.operators.rollups import is_high
from tallywatch.schema import reference_text

ACTION_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("action", T.StringType()),  # resolve | escalate
        T.StructField("at", T.TimestampType()),
        T.StructField("note", T.StringType()),
    ]
)


def alert_id(batch_id: Column, txn_id: Column) -> Column:
    """The same alert gets the same id however often a batch is scored."""
    return F.sha2(F.concat_ws("-", batch_id, txn_id.cast("string")), 256)


def generate_alerts(scored: DataFrame, batch_id: str, created_at: datetime | Column) -> DataFrame:
    """One open alert per HIGH row, with the row's own attributions and all its fields."""
    created = created_at if isinstance(created_at, Column) else F.lit(created_at)
    none = F.array().cast(ATTRIBUTION_TYPE)
    shown = F.col("attributions") if "attributions" in scored.columns else none
    return scored.filter(is_high()).select(
        alert_id(F.lit(batch_id), F.col("txn_id")).alias("alert_id"),
        "txn_id",
        reference_text(scored).alias("reference"),
        "score",
        "risk_level",
        "flags_text",
        F.lit("open").alias("status"),
        F.lit("danger").alias("severity"),
        created.alias("created_at"),
        shown.alias("attributions"),
        row_json(scored).alias("all_fields"),
    )


LAST = "struct<at:timestamp,value:string>"
HISTORY = ("status", "resolution", "escalation", "resolved_at", "escalated_at")
HISTORY_SCHEMA = f"alert_id string, status {LAST}, resolution {LAST}, escalation {LAST}, resolved_at timestamp, escalated_at timestamp"


def reduced_history(actions: DataFrame) -> DataFrame:
    """What the actions on each alert amount to: the last status, the last time of each kind, its last note.

    Each is a maximum, so histories merge in any order and an action that comes twice counts once.
    """

    def of_kind(kind: str) -> Column:
        return F.col("action") == kind

    def last(value: Column, condition: Column) -> Column:
        return F.max(F.when(condition, F.struct(F.col("at").alias("at"), value.alias("value"))))

    noted = F.coalesce(F.col("note"), F.lit("")) != ""
    status = F.when(of_kind("resolve"), "resolved").when(of_kind("escalate"), "escalated")
    return actions.groupBy("alert_id").agg(
        last(status, status.isNotNull()).alias("status"),
        last(F.col("note"), of_kind("resolve") & noted).alias("resolution"),
        last(F.col("note"), of_kind("escalate") & noted).alias("escalation"),
        F.max(F.when(of_kind("resolve"), F.col("at"))).alias("resolved_at"),
        F.max(F.when(of_kind("escalate"), F.col("at"))).alias("escalated_at"),
    )


def merged_history(histories: DataFrame) -> DataFrame:
    """One row per alert from reduced histories of several deliveries."""
    keys = [c for c in histories.columns if c not in HISTORY]
    return histories.groupBy(*keys).agg(*(F.max(c).alias(c) for c in HISTORY))


def with_history(alerts: DataFrame, history: DataFrame) -> DataFrame:
    """Alerts with their reduced history applied."""
    latest = history.select(
        F.col("alert_id").alias("_alert"),
        F.col("status.value").alias("_status"),
        "resolved_at",
        F.col("resolution.value").alias("resolution_note"),
        "escalated_at",
        F.col("escalation.value").alias("escalation_note"),
    )
    joined = alerts.join(latest, F.col("alert_id") == F.col("_alert"), "left").drop("_alert")
    escalated = F.col("escalated_at").isNotNull()
    return joined.withColumns(
        {
            "status": F.coalesce("_status", "status"),
            "severity": F.when(escalated, "danger").otherwise(F.col("severity")),
        }
    ).drop("_status")


def current_state(alerts: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with their history applied.

    Status comes from the last action; the time and note of each kind of action come from the last
    one of that kind (a later action without a note leaves the earlier note). Actions on unknown
    alerts have no effect. The history is reduced per alert map-side, so long histories are cheap.
    """
    return with_history(alerts, reduced_history(actions))


def filter_alerts(alerts: DataFrame, tier: str | None = None, status: str | None = None) -> DataFrame:
    if tier:
        alerts = alerts.filter(F.upper("risk_level") == tier.upper())
    if status:
        alerts = alerts.filter(F.col("status") == status.lower())
    return alerts


def list_alerts(
    alerts: DataFrame, tier: str | None = None, status: str | None = None, limit: int | None = None
) -> DataFrame:
    """Open alerts first, then the highest scores; ties by id. ``limit`` asks for a first page."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    ordered = filter_alerts(alerts, tier, status).orderBy(F.col("status") != "open", F.col("score").desc(), "alert_id")
    return ordered if limit is None else ordered.limit(limit)


def count_alerts(alerts: DataFrame, tier: str | None = None, status: str | None = None) -> DataFrame:
    """All matching alerts, before any limit."""
    return filter_alerts(alerts, tier, status).agg(F.count(F.lit(1)).alias("total"))


def explain_alerts(alerts: DataFrame, recompute: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Alerts with their attributions; empty ones are filled by ``recompute`` when it is given.

    ``recompute`` maps alerts to (alert_id, attributions) and only sees those that need it.
    """
    columns = ["alert_id", "reference", "score", "risk_level", "attributions", "flags_text"]
    shown = alerts.select(*columns)
    if recompute is None:
        return shown
    fresh = recompute(alerts.filter(F.size("attributions") == 0)).select(
        F.col("alert_id").alias("_alert"), F.col("attributions").alias("_fresh")
    )
    joined = shown.join(fresh, F.col("alert_id") == F.col("_alert"), "left")
    stored = F.when(F.size("attributions") > 0, F.col("attributions"))
    return joined.withColumn(
        "attributions", F.coalesce(stored, "_fresh", F.array().cast(ATTRIBUTION_TYPE))
    ).select(*columns)
