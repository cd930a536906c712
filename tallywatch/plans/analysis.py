"""The whole analysis of a batch: from a file to the scored table and every roll-up of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators import alerts, graph, listings, rollups
from tallywatch.plans.models import Models, score_batch
from tallywatch.schema import canonicalise, has
from tallywatch.sources import tables
from tallywatch.sources.files import read_batch_csv, read_sheet_csv


def has_dates(scored: DataFrame) -> bool:
    return has(scored, "ts") and bool(scored.filter(F.col("ts").isNotNull()).select("txn_id").head(1))


def trends(scored: DataFrame) -> dict[str, DataFrame]:
    """The three trends and the default view; equal blocks of rows where no date is usable."""
    if has_dates(scored):
        return {
            "trend_daily": rollups.trend_daily(scored),
            "trend_weekly": rollups.trend_weekly(scored),
            "trend_monthly": rollups.trend_monthly(scored),
            "default_view": rollups.trend_view(scored).select("default_view"),
        }
    blocks = rollups.trend_sequence(scored)
    view = scored.sparkSession.range(1).select(F.lit("daily").alias("default_view"))
    return {"trend_daily": blocks, "trend_weekly": blocks, "trend_monthly": blocks, "default_view": view}


def analyse(scored: DataFrame) -> dict[str, DataFrame]:
    """Every roll-up of a scored table, lazily and independent of one another.

    Pass a stored or persisted table: each roll-up reads it again, pruned to its own columns.
    Roll-ups whose columns the source lacks are left out.
    """
    result = {
        "kpis": rollups.kpis(scored),
        **trends(scored),
        "transactions": listings.transaction_listing(scored),
        "alerts": rollups.alert_feed(scored),
        "histogram": rollups.histogram(scored),
        "risk_summary": rollups.level_summary(scored),
        "high_alerts": listings.alert_cards(scored, "HIGH"),
        "medium_alerts": listings.alert_cards(scored, "MEDIUM"),
        "anomalies": listings.anomalies(scored),
        "sar_candidates": listings.sar_candidates(scored),
        "customers": rollups.customer_profile(scored),
        "customer_history": rollups.customer_history(scored),
    }
    result["trend"] = result["trend_daily"].select(F.col("label").alias("day"), "score")
    if has(scored, "mcc"):
        result["merchant_data"] = rollups.merchant_rollup(scored)
    if has(scored, "receiver_country"):
        result["country_data"] = rollups.country_rollup(scored)
        result["fatf_transactions"] = listings.fatf_listing(scored)
    if has(scored, "sender_account", "receiver_account"):
        result["network_edges"] = graph.network_edges(scored)
        result["network_nodes"] = graph.network_nodes(scored)
    return result


def analyse_sheet(
    spark: SparkSession, path: str, out: str, batch_id: str, models: Models | None = None
) -> dict[str, DataFrame]:
    """A spreadsheet export: v2 rules, models with penalty when given, stored, then every roll-up."""
    rows = canonicalise(read_sheet_csv(spark, path), "v2")
    scored = score_batch(rows, C.V2, models, penalise=models is not None)
    tables.save_scored(scored, f"{out}/scored", batch_id)
    return analyse(tables.load_scored(spark, f"{out}/scored", batch_id))


def analyse_batch(
    spark: SparkSession, path: str, out: str, batch_id: str, created_at: datetime, models: Models | None = None
) -> dict[str, DataFrame]:
    """A batch CSV: v3 rules and models, stored, with the batch KPIs, listing and HIGH alerts."""
    rows = canonicalise(read_batch_csv(spark, path), "v3")
    tables.save_scored(score_batch(rows, C.V3, models), f"{out}/scored", batch_id)
    scored = tables.load_scored(spark, f"{out}/scored", batch_id)
    generated = alerts.generate_alerts(scored, batch_id, created_at)
    tables.save_scored(generated, f"{out}/alerts", batch_id)
    return {
        "kpis": rollups.batch_kpis(scored, models is not None),
        "transactions": listings.transaction_listing(scored),
        "alerts": tables.load_scored(spark, f"{out}/alerts", batch_id),
    }
