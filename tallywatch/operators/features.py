"""The fifteen model features of a transaction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions.numbers import clipped, zero_filled
from tallywatch.operators.ranking import ordered_index
from tallywatch.operators.rules import AmountStats, amount_stats, geography, is_multiple, is_structuring, zscore
from tallywatch.operators.skew import attach_by_key
from tallywatch.operators.velocity import with_velocity
from tallywatch.schema import has, optional

UNSEEN_CODE = -1


@dataclass(frozen=True)
class PaymentCodes:
    """A fitted code per payment format."""

    table: DataFrame


def format_text(df: DataFrame) -> Column:
    return F.coalesce(optional(df, "payment_format"), F.lit("Unknown"))


def fit_payment_codes(df: DataFrame) -> PaymentCodes:
    """Codes 0.. in the text order of the distinct formats, with the rows of each format."""
    formats = df.groupBy(format_text(df).alias("format")).agg(F.count(F.lit(1)).alias("n"))
    coded = ordered_index(formats, ["format"], "code")
    return PaymentCodes(coded.select("format", "n", F.col("code").cast("int").alias("code")))


def with_payment_code(df: DataFrame, codes: PaymentCodes) -> DataFrame:
    """Adds ``payment_format_encoded``; formats not seen at fit time get -1."""
    keyed = df.withColumn("_format", format_text(df))
    table = codes.table.withColumnRenamed("format", "_format")
    joined = attach_by_key(keyed, table, ["_format"], {"code": "_code"})
    code = F.coalesce("_code", F.lit(UNSEEN_CODE))
    return joined.withColumn("payment_format_encoded", code).drop("_format", "_code")


def amount_features(df: DataFrame, stats: AmountStats) -> dict[str, Column]:
    if not has(df, "amount"):
        zeros = {c: F.lit(0) for c in ("is_round_1k", "is_round_500", "is_just_below_threshold")}
        return {"amount_usd": F.lit(0.0), "amount_zscore": F.lit(0.0), **zeros}
    amount = zero_filled(F.col("amount"))
    (thousand, from_thousand, *_), (half, from_half, *_) = C.ROUND_TIERS
    on_thousand = amount % thousand == 0
    return {
        "amount_usd": amount,
        "amount_zscore": F.coalesce(clipped(zscore(F.col("amount"), stats), -5.0, 5.0), F.lit(0.0)),
        "is_round_1k": is_multiple(amount, thousand, from_thousand).cast("int"),
        "is_round_500": (is_multiple(amount, half, from_half) & ~on_thousand).cast("int"),
        "is_just_below_threshold": is_structuring(amount).cast("int"),
    }


def time_features(df: DataFrame) -> dict[str, Column]:
    if not has(df, "ts"):
        return {"hour_of_day": F.lit(12), "is_weekend": F.lit(0), "is_odd_hours": F.lit(0)}
    hour = F.hour("ts")
    return {
        "hour_of_day": F.coalesce(hour, F.lit(12)),
        "is_weekend": F.coalesce((F.weekday("ts") >= 5).cast("int"), F.lit(0)),
        "is_odd_hours": F.coalesce(((hour >= 23) | (hour < 5)).cast("int"), F.lit(0)),
    }


def geo_features(df: DataFrame) -> dict[str, Column]:
    if not has(df, "sender_country", "receiver_country"):
        return {"is_cross_border": F.lit(0), "is_fatf_country": F.lit(0)}
    cross, fatf = geography(F.col("sender_country"), F.col("receiver_country"))
    return {"is_cross_border": cross.cast("int"), "is_fatf_country": fatf.cast("int")}


def label_column(df: DataFrame) -> Column:
    return F.coalesce(optional(df, "label").cast("int"), F.lit(0))


def build_features(
    df: DataFrame,
    stats: AmountStats | None = None,
    codes: PaymentCodes | None = None,
    keep: tuple[str, ...] = (),
    stateless: bool = False,
    source: DataFrame | None = None,
) -> DataFrame:
    """``txn_id``, the kept columns, the features in model order and ``label`` when present.

    Row-local features are one projection. Velocities are worked out on four columns (of ``source``, the same rows
    before joins, when it is given); the projected rows cross one shuffle. A ``stateless`` row knows no
    other rows: its velocities are 1 and its payee is new.
    """
    stats = stats or amount_stats(df)
    coded = has(df, "payment_format")
    if coded and codes is None:
        codes = fit_payment_codes(df)
    sender = "sender_account" if has(df, "sender_account") else None
    receiver = "receiver_account" if has(df, "receiver_account") else None

    local = {**amount_features(df, stats), **time_features(df), **geo_features(df)}
    if not coded:
        local["payment_format_encoded"] = F.lit(0)
    if has(df, "label"):
        local["label"] = label_column(df)
    carried = [c for c in ("ts", "sender_account", "receiver_account", "payment_format") if has(df, c)]
    extra = [c for c in keep if c not in local and c not in carried]
    rows = df.select("txn_id", *extra, *carried, *(column.alias(name) for name, column in local.items()))
    if coded:
        rows = with_payment_code(rows, codes)
    if stateless:
        ones = {c: F.lit(1).cast("bigint") for c in C.VELOCITY_HOURS}
        rows = rows.withColumns({**ones, "is_new_payee": F.lit(int(bool(sender and receiver)))})
    else:
        rows = with_velocity(rows, sender, receiver, source)
    labels = ["label"] if has(df, "label") and "label" not in keep else []
    return rows.select("txn_id", *keep, *C.FEATURE_COLUMNS, *labels)


def assemble(features: DataFrame, out: str = "features") -> DataFrame:
    """The features as one vector column, absent values as 0."""
    filled = features.na.fill(0, subset=C.FEATURE_COLUMNS)
    return VectorAssembler(inputCols=C.FEATURE_COLUMNS, outputCol=out).transform(filled)
