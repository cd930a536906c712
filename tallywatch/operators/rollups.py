"""Portfolio roll-ups over the scored table: KPIs, trends, distributions, top lists of groups.

Every function takes the scored table (canonical columns plus those of ``score_rules``) and
aggregates with map-side partials, so what is shuffled is one row per group and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions import text as X
from tallywatch.operators.ranking import block_of, order_statistics
from tallywatch.schema import has, optional
from tallywatch.session import written


def is_high() -> Column:
    return _level_is("HIGH")


def _level_is(level: str) -> Column:
    return F.col("risk_level") == level


def elevated_mean(score: Column) -> Column:
    """Mean of the scores of at least 40, else mean of all, else 0."""
    return F.coalesce(F.avg(F.when(score >= C.ELEVATED_SCORE, score)), F.avg(score), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 1), F.lit(0.0))


def crosses_border(df: DataFrame) -> Column:
    if not has(df, "sender_country", "receiver_country"):
        return F.lit(False)
    return X.normalise_country(F.col("sender_country")) != X.normalise_country(F.col("receiver_country"))


def fatf_receiver(df: DataFrame) -> Column:
    return X.is_fatf(X.normalise_country(optional(df, "receiver_country")))


def kpis(scored: DataFrame) -> DataFrame:
    """The headline row of an analysis."""
    total = F.count(F.lit(1))
    high, medium = F.count_if(_level_is("HIGH")), F.count_if(_level_is("MEDIUM"))
    cross, fatf = F.count_if(crosses_border(scored)), F.count_if(fatf_receiver(scored))
    return scored.agg(
        total.alias("total"),
        high.alias("high"),
        medium.alias("medium"),
        F.count_if(_level_is("LOW")).alias("low"),
        F.round(elevated_mean(F.col("score")), 1).alias("avg_score"),
        high.alias("sar_candidates"),
        percent(high, total).alias("customer_risk_pct"),
        percent(high + medium, total).alias("transaction_risk_pct"),
        percent(cross, total).alias("geographic_risk_pct"),
        percent(fatf, total).alias("fatf_pct"),
        cross.alias("cross_border_count"),
    )


def batch_kpis(scored: DataFrame, model_available: bool = False) -> DataFrame:
    """The headline row of a batch upload: plain mean, and whether models took part."""
    high = F.count_if(_level_is("HIGH"))
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        high.alias("high"),
        F.count_if(_level_is("MEDIUM")).alias("medium"),
        F.count_if(_level_is("LOW")).alias("low"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        high.alias("sar_candidates"),
        F.lit(model_available).alias("model_available"),
    )


# --- trends -----------------------------------------------------------------------------------


def _day_parts(scored: DataFrame) -> DataFrame:
    """Sums and counts per date: the only pass over the rows that any trend needs."""
    elevated = F.col("score") >= C.ELEVATED_SCORE
    amount = optional(scored, "amount")
    return (
        scored.filter(F.col("ts").isNotNull())
        .groupBy(F.to_date("ts").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("score").alias("score_sum"),
            F.count_if(elevated).alias("elevated_n"),
            F.sum(F.when(elevated, F.col("score"))).alias("elevated_sum"),
            F.count_if(is_high()).alias("high_n"),
            F.sum(amount).alias("amount_sum"),
            F.count(amount).alias("amount_n"),
        )
    )


def _trend(parts: DataFrame, period: Column, label: Column) -> DataFrame:
    score = F.coalesce(
        F.try_divide(F.sum("elevated_sum"), F.sum("elevated_n")), F.try_divide(F.sum("score_sum"), F.sum("n"))
    )
    return (
        parts.groupBy(period.alias("period"))
        .agg(
            F.round(score, 1).alias("score"),
            F.sum("high_n").alias("high_count"),
            F.round(F.try_divide(F.sum("amount_sum"), F.sum("amount_n")), 2).alias("avg_amount"),
        )
        .orderBy("period")
        .select(label.alias("label"), "score", "high_count", "avg_amount")
    )


def trend_daily(scored: DataFrame) -> DataFrame:
    return _trend(_day_parts(scored), F.col("day"), F.date_format("period", "yyyy-MM-dd"))


def trend_weekly(scored: DataFrame) -> DataFrame:
    monday = F.date_trunc("week", "day").cast("date")
    return _trend(_day_parts(scored), monday, F.concat(F.lit("W/"), F.date_format("period", "MM-dd")))


def trend_monthly(scored: DataFrame) -> DataFrame:
    return _trend(_day_parts(scored), F.date_trunc("month", "day").cast("date"), F.date_format("period", "yyyy-MM"))


def trend_short(scored: DataFrame) -> DataFrame:
    """Day label and score only."""
    return trend_daily(scored).select(F.col("label").alias("day"), "score")


def trend_view(scored: DataFrame) -> DataFrame:
    """The granularity to show first, by the whole days between first and last timestamp."""
    span = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    days = F.floor(span / F.lit(86_400_000_000)).cast("bigint")
    view = (
        F.when(F.col("span_days") >= C.MONTHLY_SPAN_DAYS, "monthly")
        .when(F.col("span_days") >= C.WEEKLY_SPAN_DAYS, "weekly")
        .otherwise("daily")
    )
    return scored.agg(days.alias("span_days")).select("span_days", view.alias("default_view"))


def trend_sequence(scored: DataFrame) -> DataFrame:
    """For tables without usable dates: eight equal blocks in row order, the remainder in the last.

    Only the block borders are searched by rank; the rows themselves are never sorted.
    """
    total = scored.count()
    size = max(1, total // C.SEQUENCE_BLOCKS)
    blocks = min(C.SEQUENCE_BLOCKS, total)
    borders = order_statistics(scored.select("txn_id"), "txn_id", [i * size for i in range(blocks)], total)
    block = block_of(F.col("txn_id"), borders)
    return (
        scored.groupBy(block.alias("block"))
        .agg(
            F.round(elevated_mean(F.col("score")), 1).alias("score"),
            F.count_if(is_high()).alias("high_count"),
            F.round(F.avg(optional(scored, "amount")), 2).alias("avg_amount"),
        )
        .orderBy("block")
        .select(F.concat(F.lit("Batch "), (F.col("block") + 1).cast("string")).alias("label"), "score", "high_count", "avg_amount")
    )


# --- distributions ----------------------------------------------------------------------------


def histogram(scored: DataFrame) -> DataFrame:
    """Rows per score bucket of width ten, in text order of the bucket."""
    low = (F.floor(F.col("score") / 10) * 10).cast("int")
    name = F.concat(F.col("bucket_lo").cast("string"), F.lit("-"), (F.col("bucket_lo") + 10).cast("string"))
    return (
        scored.groupBy(low.alias("bucket_lo"))
        .agg(F.count(F.lit(1)).alias("count"))
        .select(name.alias("range"), "bucket_lo", "count")
        .orderBy("range")
    )


def level_summary(scored: DataFrame) -> DataFrame:
    order = F.when(_level_is("HIGH"), 0).when(_level_is("MEDIUM"), 1).otherwise(2)
    return (
        scored.groupBy("risk_level")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.round(F.avg("score"), 1).alias("avg_score"),
            F.max("score").alias("max_score"),
            F.min("score").alias("min_score"),
        )
        .orderBy(order)
    )


def merchant_rollup(scored: DataFrame, rows: int = C.MERCHANT_ROWS) -> DataFrame:
    """The most frequent merchant codes; names are looked up for the listed codes only."""
    return (
        scored.filter(F.col("mcc").isNotNull())
        .groupBy(X.normalise_mcc(F.col("mcc")).alias("mcc"))
        .agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("score"), 1).alias("avg_score"))
        .orderBy(F.col("count").desc(), "mcc")
        .limit(rows)
        .select(
            "mcc",
            F.coalesce(X.mcc_name(F.col("mcc")), F.lit("Standard Merchant")).alias("description"),
            "count",
            X.is_high_risk_mcc(F.col("mcc")).alias("is_high_risk"),
            "avg_score",
        )
    )


def country_rollup(scored: DataFrame, rows: int = C.COUNTRY_ROWS) -> DataFrame:
    """The most frequent receiver countries, spelled as in the source."""
    return (
        scored.filter(F.col("receiver_country").isNotNull())
        .groupBy(F.col("receiver_country").alias("country"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "country")
        .limit(rows)
        .select("country", "count", X.is_fatf(X.normalise_country(F.col("country"))).alias("is_fatf"))
    )


def alert_feed(scored: DataFrame) -> DataFrame:
    """The notices of the dashboard, from one aggregate."""
    outlier = F.abs("feature_zscore") > C.ZSCORE_LIMIT
    counts = scored.agg(
        F.count_if(fatf_receiver(scored)).alias("fatf"),
        F.count_if(is_high()).alias("high"),
        F.count_if(outlier).alias("outliers"),
    )

    def notice(order: int, key: str, title: Column, severity: str, shown: Column) -> Column:
        return F.struct(
            F.lit(order).alias("position"),
            F.lit(key).alias("id"),
            title.alias("title"),
            F.lit(severity).alias("severity"),
            shown.alias("shown"),
        )

    def counted(column: str, words: str) -> Column:
        return F.concat(F.col(column).cast("string"), F.lit(words))

    notices = F.array(
        notice(
            0, "fatf", counted("fatf", " FATF high-risk jurisdiction transactions detected"), "danger", F.col("fatf") > 0
        ),
        notice(1, "sar", counted("high", " SAR candidate(s) pending MLRO review"), "warning", F.col("high") > 0),
        notice(
            2,
            "anomaly",
            counted("outliers", " statistical anomalies detected (|Z|>2)"),
            "warning",
            F.col("outliers") > 0,
        ),
        notice(
            3, "kyc", F.lit("KYC Verification required for HIGH risk account holders"), "danger", F.lit(True)
        ),
    )
    return counts.select(F.inline(notices)).filter("shown").drop("shown").orderBy("position")


# --- customers --------------------------------------------------------------------------------


def customer_name(scored: DataFrame) -> Column:
    return X.full_name(F.trim(optional(scored, "sender_first_name")), F.trim(optional(scored, "sender_last_name")))


def _customer_key(scored: DataFrame) -> Column:
    reference = F.nullif(optional(scored, "reference"), F.lit(""))
    return F.coalesce(customer_name(scored), reference)


def _any_fatf(scored: DataFrame) -> Column:
    sides = [X.is_fatf(X.normalise_country(optional(scored, c))) for c in ("sender_country", "receiver_country")]
    return sides[0] | sides[1]


def customer_profile(scored: DataFrame) -> DataFrame:
    """One row of fixed size per customer: attributes of the first row, worst score, history size.

    The history itself is a child table (``customer_history``), so a customer with very many rows
    is never gathered into one value. The rows are scored once and their few columns written down; the
    aggregates are numbers that combine map-side by hash, and the attributes of a customer's first row
    are read from the written rows by its unique id.
    """

    def shown(name: str, default: str = "") -> Column:
        return F.coalesce(optional(scored, name), F.lit(default))

    attributes = (
        shown("reference").alias("reference"),
        F.coalesce(customer_name(scored), F.lit("Unknown Customer")).alias("name"),
        F.struct(
            shown("sender_address_line").alias("line1"),
            shown("sender_address_city").alias("city"),
            shown("sender_address_state").alias("state"),
            shown("sender_address_postal").alias("postal"),
            X.normalise_country(optional(scored, "sender_country")).alias("country"),
        ).alias("address"),
        F.struct(
            shown("card_number", "XXXX").alias("number"),
            shown("card_product_type", "Checking").alias("type"),
            shown("currency", "USD").alias("currency"),
        ).alias("account"),
        F.struct(shown("merchant_name").alias("employer"), shown("mcc").alias("industry")).alias("work"),
    )
    alerts = F.col("score") >= C.ELEVATED_SCORE
    rows = written(
        scored.select(
            _customer_key(scored).alias("customer"),
            "txn_id",
            "score",
            _any_fatf(scored).alias("fatf"),
            optional(scored, "ts").alias("at"),
            *attributes,
        ).filter(F.col("customer").isNotNull()),
        "customers",
    )
    grouped = (
        rows.groupBy("customer")
        .agg(
            F.min("txn_id").alias("first_id"),
            F.min(F.when(F.col("score") >= C.CASE_SCORE, F.col("at"))).alias("case_at"),
            F.max("score").alias("risk_score"),
            F.bool_or("fatf").alias("has_fatf"),
            F.count_if(alerts).alias("history_size"),
            F.count(F.lit(1)).alias("transactions"),
        )
    )
    case = F.when(
        F.col("risk_score") >= C.CASE_SCORE,
        F.struct(
            F.concat(F.lit("CASE-"), F.col("customer")).alias("id"),
            F.lit("AML Investigation").alias("type"),
            F.lit("Open").alias("status"),
            F.to_date("case_at").alias("opened"),
            F.concat(F.lit("Highest score "), F.col("risk_score").cast("string")).alias("description"),
        ),
    )
    firsts = rows.select(F.col("txn_id").alias("first_id"), "reference", "name", "address", "account", "work")
    return grouped.join(firsts, "first_id").select(
        "customer", "reference", "name", "address", "account", "work", "risk_score", "has_fatf", "history_size", "transactions",
        case.alias("case"),
    )


def customer_history(scored: DataFrame) -> DataFrame:
    """The alert history of the customers: one row per transaction scored 40 or more."""
    return scored.filter(F.col("score") >= C.ELEVATED_SCORE).select(
        _customer_key(scored).alias("customer"),
        "txn_id",
        F.coalesce(optional(scored, "reference"), F.lit("")).alias("reference"),
        F.date_format("ts", "yyyy-MM-dd").alias("date") if has(scored, "ts") else F.lit(None).cast("string").alias("date"),
        F.lit("Under Review").alias("decision"),
        "score",
        "flags_text",
    ).filter(F.col("customer").isNotNull())
