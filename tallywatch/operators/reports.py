"""Report drafts for HIGH rows: a table of facts, and a text built from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions import text as X
from tallywatch.operators.rollups import is_high
from tallywatch.schema import has, optional, reference_text


def batch_context(scored: DataFrame) -> DataFrame:
    """Rows and plain mean score of the batch."""
    return scored.agg(F.count(F.lit(1)).alias("total"), F.avg("score").alias("avg_score"))


def report_facts(scored: DataFrame) -> DataFrame:
    """What a draft states about each HIGH row, one row per report."""
    context = batch_context(scored).select(F.struct("total", "avg_score").alias("c")).scalar()

    def shown(name: str) -> Column:
        return F.coalesce(F.nullif(optional(scored, name).cast("string"), F.lit("")), F.lit("N/A"))

    name = X.full_name(optional(scored, "receiver_first_name"), optional(scored, "receiver_last_name"))
    code = X.normalise_mcc(optional(scored, "mcc"))
    z = F.col("feature_zscore")
    date = F.date_format("ts", "yyyy-MM-dd HH:mm:ss") if has(scored, "ts") else F.lit(None).cast("string")
    facts = scored.filter(is_high()).withColumn("_context", context)
    return facts.select(
        "txn_id",
        reference_text(scored).alias("reference"),
        F.coalesce(date, F.lit("N/A")).alias("date"),
        X.currency(optional(scored, "amount")).alias("amount"),
        shown("merchant_name").alias("merchant"),
        shown("mcc").alias("mcc"),
        X.masked_card(optional(scored, "card_number")).alias("card"),
        shown("sender_country").alias("sender_country"),
        shown("receiver_country").alias("receiver_country"),
        F.coalesce(name, F.lit("N/A")).alias("receiver_name"),
        "score",
        "risk_level",
        z.alias("zscore"),
        (F.abs(z) > C.ZSCORE_LIMIT).alias("is_outlier"),
        X.is_fatf(X.normalise_country(optional(scored, "receiver_country"))).alias("receiver_is_fatf"),
        X.is_high_risk_mcc(code).alias("mcc_is_high_risk"),
        F.coalesce(X.mcc_name(code), F.lit("")).alias("mcc_name"),
        X.flag_count(F.col("flags_text")).alias("flag_count"),
        F.col("flags_text"),
        F.col("breakdown_text"),
        F.col("_context.total").alias("batch_total"),
        F.round("_context.avg_score", 1).alias("batch_avg_score"),
    )


def _listed(title: str, text: Column, separator: str, none: str) -> Column:
    """The items of a joined text, numbered, one to a line; nothing where there are none."""
    items = F.split(text, separator)
    numbered = F.transform(items, lambda item, i: F.concat((i + 1).cast("string"), F.lit(". "), item))
    return F.when(text != none, F.concat(F.lit(f"{title}\n"), F.array_join(numbered, "\n")))


def report_texts(facts: DataFrame, generated_at: datetime | Column, closing: str | None = None) -> DataFrame:
    """A draft per report: the facts that bear on it, what was found, and the caller's ``closing``.

    The clock is an argument, so a draft can be made again.
    """
    now = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    number = F.concat(F.lit("SAR-"), F.date_format(now, "yyyyMMdd"), F.lit("-"), F.substring("reference", 1, 10))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Draft "), number, F.lit(" of "), F.date_format(now, "yyyy-MM-dd HH:mm:ss")),
        F.concat(F.lit("Transaction "), F.col("reference"), F.lit(", "), F.col("date"), F.lit(", "), F.col("amount")),
        F.concat(F.lit("Route: "), F.col("sender_country"), F.lit(" to "), F.col("receiver_country")),
        F.concat(F.lit("Payee: "), F.col("receiver_name"), F.lit("; card "), F.col("card")),
        F.concat(F.lit("Merchant: "), F.col("merchant"), F.lit("; code "), F.col("mcc")),
        F.concat(
            F.format_string("Score: %d (", "score"),
            F.col("risk_level"),
            F.format_string("); mean %.1f of ", "batch_avg_score"),
            F.col("batch_total").cast("string"),
            F.lit(" rows"),
        ),
        _listed("Found", F.col("flags_text"), r" \| ", C.NO_FLAGS),
        _listed("Points", F.col("breakdown_text"), ", ", C.NO_PARTS),
        F.when(
            F.col("is_outlier"), F.format_string("Amount: %.2f standard deviations from the mean of the rows", "zscore")
        ),
        F.when(F.col("receiver_is_fatf"), "Payee country: on the list of high-risk countries"),
        F.when(F.col("mcc_is_high_risk"), F.concat(F.lit("Merchant code: on the high-risk list, "), F.col("mcc_name"))),
        F.lit(closing),
    )
    return facts.select("txn_id", "reference", text.alias("report"))
