"""Row listings, and the full list of report candidates.

Lists are ordered by the row id and complete; ``rows`` asks for a first page. The strongest outliers
are a top list, whose ``orderBy(...).limit(n)`` keeps the best n rows per task and merges those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions import text as X
from tallywatch.functions.numbers import row_json
from tallywatch.operators.ranking import ordered_index
from tallywatch.operators.rollups import fatf_receiver, is_high
from tallywatch.schema import optional, reference_text


def receiver_display(df: DataFrame) -> Column:
    names = ("receiver_first_name", "receiver_last_name", "merchant_name", "receiver_account")
    return X.counterparty(*(optional(df, n) for n in names))


def _page(listed: DataFrame, rows: int | None) -> DataFrame:
    ordered = listed.orderBy("txn_id")
    return ordered if rows is None else ordered.limit(rows)


def transaction_listing(scored: DataFrame, rows: int | None = None) -> DataFrame:
    listed = _page(scored, rows)
    return listed.select(
        "txn_id",
        reference_text(scored).alias("reference"),
        optional(scored, "ts").alias("date"),
        receiver_display(scored).alias("receiver"),
        F.coalesce(optional(scored, "amount"), F.lit(0.0)).alias("amount"),
        "score",
        "risk_level",
        "flags_text",
        "breakdown_text",
        "feature_zscore",
    )


def alert_cards(scored: DataFrame, level: str, rows: int | None = None) -> DataFrame:
    listed = _page(scored.filter(F.col("risk_level") == level), rows)
    return listed.select(
        "txn_id",
        reference_text(scored).alias("reference"),
        X.currency(optional(scored, "amount")).alias("amount"),
        "score",
        "risk_level",
        "flags_text",
        "breakdown_text",
        "feature_zscore",
        X.flag_count(F.col("flags_text")).alias("flag_count"),
    )


def anomalies(scored: DataFrame, rows: int = C.ANOMALY_ROWS) -> DataFrame:
    """The strongest outliers by the rounded z."""
    strength = F.abs("feature_zscore")
    listed = scored.filter(strength > C.ZSCORE_LIMIT).orderBy(strength.desc(), "txn_id").limit(rows)
    return listed.select(
        "txn_id",
        reference_text(scored).alias("reference"),
        "feature_zscore",
        "score",
        F.substring("flags_text", 1, 80).alias("flags_short"),
        "flags_text",
    )


def fatf_listing(scored: DataFrame, rows: int | None = None) -> DataFrame:
    country = X.normalise_country(optional(scored, "receiver_country"))
    listed = _page(scored.filter(fatf_receiver(scored)), rows)
    return listed.select(
        "txn_id",
        country.alias("country"),
        F.coalesce(X.fatf_name(country), country).alias("country_name"),
        X.currency(optional(scored, "amount")).alias("amount"),
        "score",
        "risk_level",
        reference_text(scored).alias("reference"),
    )


def sar_candidates(scored: DataFrame) -> DataFrame:
    """Every HIGH row with its report number (position among the HIGH rows) and all its fields."""
    listed = scored.filter(is_high()).select(
        "txn_id",
        reference_text(scored).alias("reference"),
        "score",
        "feature_zscore",
        X.flag_count(F.col("flags_text")).alias("flag_count"),
        X.shortened(F.col("flags_text")).alias("flags_short"),
        "flags_text",
        "breakdown_text",
        row_json(scored).alias("all_fields"),
    )
    return ordered_index(listed, ["txn_id"], "report_index")
