"""Rule scoring: eight additive rules, their texts, and the total."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions import text as X
from tallywatch.functions.numbers import zero_filled
from tallywatch.operators.skew import attach_by_key, key_totals
from tallywatch.schema import has


@dataclass(frozen=True)
class Outcome:
    """What one rule contributes to a row."""

    points: Column
    flag: Column | None = None
    part: Column | None = None


@dataclass(frozen=True)
class AmountStats:
    """Row count, mean and sample deviation of the zero-filled amounts: one row of facts."""

    rows: int
    mean: float | None = None
    std: float | None = None


@dataclass(frozen=True)
class Snapshots:
    """Batch-wide inputs of the rules: amount statistics and key frequencies.

    The frequency tables hold one row per key with its count ``n``. A batch makes its own; a
    stream uses stored ones.
    """

    stats: AmountStats
    receivers: DataFrame | None = None
    cards: DataFrame | None = None


SINGLE_RECORD = Snapshots(AmountStats(rows=1))
RECEIVER_KEYS = ["receiver_first", "receiver_last"]
CARD_KEYS = ["card_key"]


def amount_stats(df: DataFrame) -> AmountStats:
    """One aggregate over one column; its single row becomes constants of the scoring plan."""
    rows = F.count(F.lit(1)).alias("rows")
    if not has(df, "amount"):
        return AmountStats(df.agg(rows).first()["rows"])
    amount = zero_filled(F.col("amount"))
    return AmountStats(*df.agg(rows, F.avg(amount), F.stddev_samp(amount)).first())


def receiver_key(df: DataFrame) -> list[Column]:
    """First and last name as one two-column key; both null where the name is blank."""
    first = F.coalesce("receiver_first_name", F.lit(""))
    last = F.coalesce("receiver_last_name", F.lit(""))
    known = (F.trim(first) != "") | (F.trim(last) != "")
    return [F.when(known, first).alias("receiver_first"), F.when(known, last).alias("receiver_last")]


def receiver_totals(df: DataFrame) -> DataFrame:
    named = df.select(*receiver_key(df)).filter(F.col("receiver_first").isNotNull())
    return key_totals(named, RECEIVER_KEYS)


def card_key(df: DataFrame) -> Column:
    """The card number; a blank one is no card."""
    return F.nullif(F.trim("card_number"), F.lit(""))


def card_totals(df: DataFrame) -> DataFrame:
    return key_totals(df.select(card_key(df).alias("card_key")).filter("card_key IS NOT NULL"), CARD_KEYS)


def snapshots_of(df: DataFrame) -> Snapshots:
    """Statistics and frequencies of a batch; the frequency tables stay lazy."""
    return Snapshots(
        stats=amount_stats(df),
        receivers=receiver_totals(df) if has(df, "receiver_first_name", "receiver_last_name") else None,
        cards=card_totals(df) if has(df, "card_number") else None,
    )


def with_receiver_frequency(df: DataFrame, snapshots: Snapshots) -> DataFrame:
    """Adds ``receiver_n``; a blank or unknown receiver has none. Without a table, rows stand alone."""
    keyed = df.select("*", *receiver_key(df))
    if snapshots.receivers is None:
        alone = F.when(F.col("receiver_first").isNotNull(), F.lit(1).cast("bigint"))
        return keyed.withColumn("receiver_n", alone).drop(*RECEIVER_KEYS)
    return attach_by_key(keyed, snapshots.receivers, RECEIVER_KEYS, {"n": "receiver_n"}).drop(*RECEIVER_KEYS)


def with_card_frequency(df: DataFrame, snapshots: Snapshots) -> DataFrame:
    """Adds ``card_n``; a missing or unknown card has none. Without a table, rows stand alone."""
    if snapshots.cards is None:
        return df.withColumn("card_n", F.when(card_key(df).isNotNull(), F.lit(1).cast("bigint")))
    keyed = df.select("*", card_key(df).alias("card_key"))
    return attach_by_key(keyed, snapshots.cards, CARD_KEYS, {"n": "card_n"}).drop(*CARD_KEYS)


def zscore(amount: Column, stats: AmountStats) -> Column:
    """Unrounded z of an amount; null where the batch has no finite, positive spread."""
    if not stats.std or not math.isfinite(stats.std):
        return F.lit(None).cast("double")
    return (zero_filled(amount) - stats.mean) / stats.std


def text_with_points(label: str, points: Column) -> Column:
    return F.concat(F.lit(f"{label} +"), points.cast("string"))


def amount_rule(amount: Column) -> Outcome:
    points, flag, part = F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string")
    for above, value, flag_text, label in reversed(C.AMOUNT_TIERS):
        hit = amount > above
        points = F.when(hit, value).otherwise(points)
        flag = F.when(hit, flag_text).otherwise(flag)
        part = F.when(hit, f"{label} +{value}").otherwise(part)
    return Outcome(points, flag, part)


def is_structuring(amount: Column) -> Column:
    return amount.between(C.STRUCTURING_LOW, C.STRUCTURING_HIGH)


def structuring_rule(amount: Column) -> Outcome:
    hit = is_structuring(amount)
    return Outcome(
        F.when(hit, C.STRUCTURING_POINTS).otherwise(0),
        F.when(hit, "Structuring Detected ($9K-$10K band)"),
        F.when(hit, f"Structuring +{C.STRUCTURING_POINTS}"),
    )


def mcc_rule(mcc: Column) -> tuple[Outcome, Column]:
    """The outcome and whether the code is high-risk."""
    code = X.normalise_mcc(mcc)
    hit = X.is_high_risk_mcc(code)
    flag = F.concat(F.lit("High-Risk MCC "), code, F.lit(" ("), X.mcc_name(code), F.lit(")"))
    outcome = Outcome(
        F.when(hit, C.MCC_POINTS).otherwise(0),
        F.when(hit, flag),
        F.when(hit, f"High-Risk MCC +{C.MCC_POINTS}"),
    )
    return outcome, hit


def geography(sender: Column, receiver: Column) -> tuple[Column, Column]:
    """(crosses a border, touches a FATF country)."""
    here, there = X.normalise_country(sender), X.normalise_country(receiver)
    return here != there, X.is_fatf(here) | X.is_fatf(there)


def geography_rule(sender: Column, receiver: Column) -> tuple[Outcome, Column, Column]:
    """The outcome, whether a border is crossed, and whether a FATF country takes part."""
    cross, fatf = geography(sender, receiver)
    total = (
        F.when(cross, C.CROSS_BORDER_POINTS).otherwise(0)
        + F.when(fatf, C.FATF_POINTS).otherwise(0)
        + F.when(cross & fatf, C.FATF_CROSS_POINTS).otherwise(0)
    )
    points = F.least(total, F.lit(C.GEO_CAP))
    country = F.coalesce(X.fatf_name(X.normalise_country(receiver)), X.fatf_name(X.normalise_country(sender)))
    flag = F.when(fatf, F.concat(F.lit("FATF High-Risk Country ("), country, F.lit(")"))).when(
        cross, "Cross-Border Transaction"
    )
    part = F.when(fatf, text_with_points("FATF", points)).when(cross, text_with_points("Cross-Border", points))
    return Outcome(points, flag, part), cross, fatf


def is_multiple(amount: Column, of: int, at_least: int) -> Column:
    return (amount % of == 0) & (amount >= at_least)


def round_rule(amount: Column) -> tuple[Outcome, Column]:
    """The outcome and the 0/1/2 feature value; the coarser multiple wins."""
    points, value = F.lit(0), F.lit(0)
    flag, part = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of, at_least, worth, code, flag_text in reversed(C.ROUND_TIERS):
        hit = is_multiple(amount, of, at_least)
        points = F.when(hit, worth).otherwise(points)
        value = F.when(hit, code).otherwise(value)
        flag = F.when(hit, flag_text).otherwise(flag)
        part = F.when(hit, f"Round Amount +{worth}").otherwise(part)
    return Outcome(points, flag, part), value


def frequency_rule(n: Column, limit: int, points: int, flag: str, label: str) -> Outcome:
    hit = F.coalesce(n > limit, F.lit(False))
    prefix, suffix = flag.split("{n}")
    return Outcome(
        F.when(hit, points).otherwise(0),
        F.when(hit, F.concat(F.lit(prefix), n.cast("string"), F.lit(suffix))),
        F.when(hit, f"{label} +{points}"),
    )


def receiver_rule(n: Column) -> Outcome:
    flag = "High Receiver Velocity ({n}x same receiver)"
    return frequency_rule(n, C.RECEIVER_LIMIT, C.RECEIVER_POINTS, flag, "Receiver Velocity")


def card_rule(n: Column) -> Outcome:
    return frequency_rule(n, C.CARD_LIMIT, C.CARD_POINTS, "High Card Usage ({n}x same card)", "Card Velocity")


def zscore_rule(z: Column) -> Outcome:
    hit = F.coalesce(F.abs(z) > C.ZSCORE_LIMIT, F.lit(False))
    return Outcome(
        F.when(hit, C.ZSCORE_POINTS).otherwise(0),
        F.when(hit, F.format_string("Statistical Anomaly (Z=%.2f)", z)),
        F.when(hit, f"Z-Score Anomaly +{C.ZSCORE_POINTS}"),
    )


def score_rules(
    df: DataFrame,
    profile: C.RuleProfile = C.V3,
    snapshots: Snapshots | None = None,
) -> DataFrame:
    """Canonical rows plus score, level, flags, breakdown and rule features.

    One projection over the scan; the only shuffles are those of the two key frequencies. A rule
    whose columns are absent is left out of the plan.
    """
    if snapshots is None:
        snapshots = snapshots_of(df)
    rows = df
    outcomes: list[Outcome] = []
    features = {
        "feature_amount": F.lit(0.0),
        "feature_high_risk_mcc": F.lit(0),
        "feature_cross_border": F.lit(0),
        "feature_fatf": F.lit(0),
        "feature_round_amount": F.lit(0),
        "feature_recv_velocity": F.lit(0).cast("bigint"),
        "feature_card_velocity": F.lit(0).cast("bigint"),
        "feature_zscore": F.lit(0.0),
    }
    if profile.structuring:
        features["feature_structuring"] = F.lit(0)

    with_amount = has(df, "amount")
    amount = zero_filled(F.col("amount"))
    if with_amount:
        features["feature_amount"] = amount
        outcomes.append(amount_rule(amount))
        if profile.structuring:
            features["feature_structuring"] = is_structuring(amount).cast("int")
            outcomes.append(structuring_rule(amount))
    if has(df, "mcc"):
        outcome, risky = mcc_rule(F.col("mcc"))
        features["feature_high_risk_mcc"] = risky.cast("int")
        outcomes.append(outcome)
    if has(df, "sender_country", "receiver_country"):
        outcome, cross, fatf = geography_rule(F.col("sender_country"), F.col("receiver_country"))
        features["feature_cross_border"], features["feature_fatf"] = cross.cast("int"), fatf.cast("int")
        outcomes.append(outcome)
    if with_amount:
        outcome, features["feature_round_amount"] = round_rule(amount)
        outcomes.append(outcome)
    if has(df, "receiver_first_name", "receiver_last_name"):
        rows = with_receiver_frequency(rows, snapshots)
        features["feature_recv_velocity"] = F.coalesce("receiver_n", F.lit(0).cast("bigint"))
        outcomes.append(receiver_rule(F.col("receiver_n")))
    if has(df, "card_number"):
        rows = with_card_frequency(rows, snapshots)
        features["feature_card_velocity"] = F.coalesce("card_n", F.lit(0).cast("bigint"))
        outcomes.append(card_rule(F.col("card_n")))
    if with_amount:
        z = zscore(F.col("amount"), snapshots.stats)
        features["feature_zscore"] = F.coalesce(F.round(z, 2), F.lit(0.0))
        outcomes.append(zscore_rule(z))

    total = sum((o.points for o in outcomes), F.lit(0))
    empty = F.array().cast("array<string>")
    flags = F.array_compact(F.array(*(o.flag for o in outcomes))) if outcomes else empty
    parts = F.array_compact(F.array(*(o.part for o in outcomes))) if outcomes else empty
    scored = rows.select(
        *df.columns,
        F.least(total, F.lit(C.SCORE_CAP)).cast("int").alias("score"),
        flags.alias("flags"),
        parts.alias("breakdown"),
        *(column.alias(name) for name, column in features.items()),
    )
    return with_texts(scored, profile)


def with_texts(scored: DataFrame, profile: C.RuleProfile) -> DataFrame:
    """Level and the joined texts, from score and the two lists."""
    return scored.withColumns(
        {
            "risk_level": X.risk_level(F.col("score"), profile.high, profile.medium),
            "flags_text": joined(F.col("flags"), C.FLAG_SEPARATOR, C.NO_FLAGS),
            "breakdown_text": joined(F.col("breakdown"), C.PART_SEPARATOR, C.NO_PARTS),
        }
    )


def joined(items: Column, separator: str, none: str) -> Column:
    return F.when(F.size(items) == 0, none).otherwise(F.array_join(items, separator))
