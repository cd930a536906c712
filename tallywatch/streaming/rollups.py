"""Roll-ups that grow batch by batch: stored partial aggregates instead of rows.

One pass over a batch makes the partial sums of all groupings (GROUPING SETS): of the whole batch and per day, score
bucket, level, merchant code and receiver country. Sums of several batches merge by addition, kept as levelled runs
(``runs.py``), so a new batch never rereads old rows and a batch that is added again replaces itself. Every
view of the dashboard is a projection of these sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.functions import text as X
from tallywatch.operators import rollups as R
from tallywatch.schema import optional
from tallywatch.streaming.runs import RunStore, Table

GROUPINGS = ("day", "bucket", "level", "mcc", "country")
SUMS = (
    "n", "score_sum", "elevated_n", "elevated_sum", "high_n", "medium_n", "low_n", "cross_n", "fatf_n", "amount_sum", "amount_n",
)
KEYS = ["grouping", "key"]


def partial_sums(scored: DataFrame) -> DataFrame:
    """One row per grouping and key; rows without a key of a grouping have no row there."""
    elevated = F.col("score") >= C.ELEVATED_SCORE
    rows = scored.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.floor(F.col("score") / 10) * 10).cast("string").alias("bucket"),
        F.col("risk_level").alias("level"),
        X.normalise_mcc(optional(scored, "mcc")).alias("mcc"),
        optional(scored, "receiver_country").cast("string").alias("country"),
        F.col("score").cast("bigint").alias("score"),
        F.when(elevated, F.col("score").cast("bigint")).alias("elevated"),
        optional(scored, "amount").cast("double").alias("amount"),
        R.crosses_border(scored).alias("cross"),
        R.fatf_receiver(scored).alias("fatf"),
        optional(scored, "mcc").isNotNull().alias("with_mcc"),
    )

    def level(name: str) -> Column:
        return F.count_if(F.col("level") == name)

    sums = [
        F.count(F.lit(1)), F.sum("score"), F.count("elevated"), F.coalesce(F.sum("elevated"), F.lit(0)), level("HIGH"), level("MEDIUM"),
        level("LOW"), F.count_if("cross"), F.count_if("fatf"), F.coalesce(F.sum("amount"), F.lit(0.0)), F.count("amount"),
    ]
    grouped = rows.groupingSets([[], *([g] for g in GROUPINGS)], *GROUPINGS).agg(
        F.grouping_id(*GROUPINGS).alias("id"),
        *(s.alias(name) for s, name in zip(sums, SUMS)),
        F.min("score").alias("low"),
        F.max("score").alias("high"),
        F.count_if("with_mcc").alias("mcc_n"),
    )
    # Of the bits of the id only that of a set's own column is 0.
    last = 2 ** len(GROUPINGS) - 1
    name, key = F.lit("all"), F.lit("")
    for i, g in enumerate(GROUPINGS):
        own = F.col("id") == last - 2 ** (len(GROUPINGS) - 1 - i)
        name, key = F.when(own, g).otherwise(name), F.when(own, F.col(g)).otherwise(key)
    named = grouped.select(name.alias("grouping"), key.alias("key"), *SUMS, "low", "high", "mcc_n")
    return named.filter(F.col("key").isNotNull() & (F.col("n") > 0) & ((F.col("grouping") != "mcc") | (F.col("mcc_n") > 0))).drop("mcc_n")


def merged_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS), F.min("low").alias("low"), F.max("high").alias("high"))


KINDS = {"amount_sum": "double"}
SCHEMA = "grouping string, key string, " + ", ".join(f"{c} {KINDS.get(c, 'bigint')}" for c in SUMS) + ", low bigint, high bigint"


@dataclass(frozen=True)
class RollupStates:
    """Where the sums lie."""

    folder: str
    fan: int = 4

    @property
    def store(self) -> RunStore:
        return RunStore(self.folder, {"sums": Table(SCHEMA, merged_sums, ("grouping", "key"))}, self.fan)

    def add(self, scored: DataFrame, batch_id: int) -> None:
        """Adds the scored rows of a batch; batches are numbered in the order in which they come."""
        self.store.commit(scored.sparkSession, batch_id, {"sums": partial_sums(scored)})

    def sums(self, spark: SparkSession, grouping: str) -> DataFrame:
        runs = self.store.manifest(spark)
        own = self.store.read(spark, "sums", runs).filter(F.col("grouping") == grouping)
        return merged_sums(own).drop("grouping")

    def kpis(self, spark: SparkSession) -> DataFrame:
        n, high, medium = F.col("n"), F.col("high_n"), F.col("medium_n")
        none = spark.createDataFrame([("",) + (0,) * 9 + (0.0, 0, None, None)], SCHEMA.removeprefix("grouping string, "))
        totals = self.sums(spark, "all").unionByName(none).groupBy().agg(*(F.sum(c).alias(c) for c in SUMS))
        score = F.coalesce(F.try_divide("elevated_sum", "elevated_n"), F.try_divide("score_sum", "n"), F.lit(0.0))
        return totals.select(
            n.alias("total"),
            high.alias("high"),
            medium.alias("medium"),
            F.col("low_n").alias("low"),
            F.round(score, 1).alias("avg_score"),
            high.alias("sar_candidates"),
            R.percent(high, n).alias("customer_risk_pct"),
            R.percent(high + medium, n).alias("transaction_risk_pct"),
            R.percent(F.col("cross_n"), n).alias("geographic_risk_pct"),
            R.percent(F.col("fatf_n"), n).alias("fatf_pct"),
            F.col("cross_n").alias("cross_border_count"),
        )

    def trends(self, spark: SparkSession) -> DataFrame:
        """The daily, weekly and monthly trend in one pass over the days: view, label, score, high_count, avg_amount."""
        days = self.sums(spark, "day").withColumn("day", F.to_date("key"))
        days = days.select(
            F.date_format("day", "yyyy-MM-dd").alias("daily"),
            F.date_trunc("week", "day").cast("date").alias("weekly"),
            F.date_format("day", "yyyy-MM").alias("monthly"),
            *SUMS,
        )
        views = ("daily", "weekly", "monthly")
        score = F.coalesce(F.try_divide(F.sum("elevated_sum"), F.sum("elevated_n")), F.try_divide(F.sum("score_sum"), F.sum("n")))
        grouped = days.groupingSets([[v] for v in views], *views).agg(
            F.grouping_id(*views).alias("id"),
            F.round(score, 1).alias("score"),
            F.sum("high_n").alias("high_count"),
            F.round(F.try_divide(F.sum("amount_sum"), F.sum("amount_n")), 2).alias("avg_amount"),
        )
        week = F.concat(F.lit("W/"), F.date_format("weekly", "MM-dd"))
        view = F.when(F.col("id") == 3, "daily").when(F.col("id") == 5, "weekly").otherwise("monthly")
        label = F.when(F.col("id") == 3, F.col("daily")).when(F.col("id") == 5, week).otherwise(F.col("monthly"))
        order = F.coalesce("daily", F.col("weekly").cast("string"), "monthly").alias("_at")
        shown = grouped.select(view.alias("view"), label.alias("label"), "score", "high_count", "avg_amount", order)
        return shown.orderBy("view", "_at").drop("_at")

    def trend(self, spark: SparkSession, view: str) -> DataFrame:
        return self.trends(spark).filter(F.col("view") == view).drop("view")

    def histogram(self, spark: SparkSession) -> DataFrame:
        low = F.col("key").cast("int")
        name = F.concat("key", F.lit("-"), (low + 10).cast("string"))
        return self.sums(spark, "bucket").select(name.alias("range"), low.alias("bucket_lo"), F.col("n").alias("count")).orderBy("range")

    def level_summary(self, spark: SparkSession) -> DataFrame:
        order = F.when(F.col("risk_level") == "HIGH", 0).when(F.col("risk_level") == "MEDIUM", 1).otherwise(2)
        return (
            self.sums(spark, "level")
            .select(
                F.col("key").alias("risk_level"),
                F.col("n").alias("count"),
                F.round(F.col("score_sum") / F.col("n"), 1).alias("avg_score"),
                F.col("high").cast("int").alias("max_score"),
                F.col("low").cast("int").alias("min_score"),
            )
            .orderBy(order)
        )

    def merchant_rollup(self, spark: SparkSession, rows: int = C.MERCHANT_ROWS) -> DataFrame:
        named = self.sums(spark, "mcc").withColumnRenamed("key", "mcc").withColumnRenamed("n", "count")
        return (
            named.orderBy(F.col("count").desc(), "mcc")
            .limit(rows)
            .select(
                "mcc",
                F.coalesce(X.mcc_name(F.col("mcc")), F.lit("Standard Merchant")).alias("description"),
                "count",
                X.is_high_risk_mcc(F.col("mcc")).alias("is_high_risk"),
                F.round(F.col("score_sum") / F.col("count"), 1).alias("avg_score"),
            )
        )

    def country_rollup(self, spark: SparkSession, rows: int = C.COUNTRY_ROWS) -> DataFrame:
        named = self.sums(spark, "country").select(F.col("key").alias("country"), F.col("n").alias("count"))
        listed = named.orderBy(F.col("count").desc(), "country").limit(rows)
        return listed.select("country", "count", X.is_fatf(X.normalise_country(F.col("country"))).alias("is_fatf"))
