"""Velocities and new payees carried across micro-batches, with tables as state.

A velocity depends on sender and time alone, so the state is the number of rows per sender and time
(``times``), their counts as last counted (``counts``), the first row of every pair (``payees``) and the ids of
all rows (``rows``). Each is a set of levelled runs (``runs.py``): a micro-batch reads the times of its own
senders within 24 hours, never stored rows, and the number of files stays bounded. The counting itself is the
batch operator, so no sender's history has to fit into one task. A late row also changes the counts of up
to 24 hours after it: those are counted again, and the newest count of a sender and time holds.

Results equal the batch features whatever the order of arrival. Running a micro-batch again after a
failure replaces what it wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywatch.constants import VELOCITY_HOURS
from tallywatch.operators.skew import key_totals
from tallywatch.operators.velocity import MICROS, SENDER, account_key, first_rows, trailing_counts_of
from tallywatch.streaming.runs import RunStore, Table, as_they_are, summed

KEY_COLUMNS = ["txn_id", "ts", "sender_account", "receiver_account"]
COUNTS = ", ".join(f"{c} bigint" for c in VELOCITY_HOURS)


def newest_counts(rows: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*VELOCITY_HOURS, "batch_id", "day"), "batch_id").alias("newest")
    return rows.groupBy("sender", "us").agg(newest).select("sender", "us", "newest.*")


def first_payees(rows: DataFrame) -> DataFrame:
    return first_rows(rows.withColumnRenamed("us", MICROS), ["sender", "payee"])


TABLES = {
    "rows": Table("txn_id bigint, sender string, us bigint, day date", as_they_are, ("day", "txn_id"), ("day",)),
    "times": Table("sender string, us bigint, n bigint, day date", summed(["sender", "us", "day"], "n"), ("day", "sender", "us"), ("day",)),
    "counts": Table(f"sender string, us bigint, batch_id bigint, {COUNTS}, day date", newest_counts, ("day", "sender", "us"), ("day",)),
    "payees": Table("sender string, payee string, txn_id bigint, us bigint", first_payees, ("sender", "payee")),
}


@dataclass(frozen=True)
class RunningVelocity:
    """Where the state lies."""

    folder: str
    fan: int = 4

    @property
    def store(self) -> RunStore:
        return RunStore(self.folder, TABLES, self.fan)

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Processes what is available; the state lies in ``folder``."""
        return (
            rows.select(*KEY_COLUMNS)
            .writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def results(self, spark: SparkSession) -> DataFrame:
        """One row per transaction so far, as of the last micro-batch; rows without a time have velocity 1."""
        counts = self.store.current(spark, "counts").drop("day", "batch_id")
        rows = self.store.current(spark, "rows").drop("day")
        firsts = self.store.current(spark, "payees").select(F.col("txn_id").alias("_first"))
        counted = rows.join(counts, ["sender", "us"], "left")
        flagged = counted.join(firsts, F.col("txn_id") == F.col("_first"), "left")
        velocities = (F.coalesce(F.col(c), F.lit(1)).cast("bigint").alias(c) for c in VELOCITY_HOURS)
        return flagged.select("txn_id", *velocities, F.col("_first").isNotNull().cast("int").alias("is_new_payee"))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.select(
            "txn_id",
            account_key(F.col("sender_account")).alias("sender"),
            account_key(F.col("receiver_account")).alias("payee"),
            F.unix_micros("ts").alias("us"),
            F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"),
        ).persist()
        try:
            rows, first, last = keyed.agg(F.count(F.lit(1)), F.min("us"), F.max("us")).first()
            if rows == 0:
                return
            timed = key_totals(keyed.filter("us IS NOT NULL"), ["sender", "us"])
            times = timed.withColumn("day", F.to_date(F.timestamp_micros("us"))).persist()
            added = {
                "rows": keyed.select("txn_id", "sender", "us", "day"),
                "times": times,
                "payees": first_payees(keyed),
            }
            if first is not None:
                added["counts"] = self._counts(spark, times, batch_id, first, last)
            self.store.commit(spark, batch_id, added)
            times.unpersist()
        finally:
            keyed.unpersist()

    def _counts(self, spark: SparkSession, new: DataFrame, batch_id: int, first: int, last: int) -> DataFrame:
        """Counts at the times of the micro-batch, and at stored times that its rows fall into."""
        reach = max(VELOCITY_HOURS.values()) * 3_600_000_000
        low, high = F.timestamp_micros(F.lit(first - reach)), F.timestamp_micros(F.lit(last + reach))
        stored = self.store.read(spark, "times", self.store.manifest(spark, batch_id))
        # Literal bounds: only the folders of these days are listed and read.
        days = F.col("day").between(F.to_date(low), F.to_date(high))
        near = stored.filter(days & F.col("us").between(first - reach + 1, last + reach - 1))
        near = near.join(new.select("sender").distinct(), "sender", "left_semi")
        both = new.unionByName(near).groupBy("sender", "us").agg(F.sum("n").alias("n"))
        wanted = trailing_counts_of(both.select(F.col("sender").alias(SENDER), F.col("us").alias(MICROS), "n"))
        wanted = wanted.filter(F.col(MICROS) >= first)
        return wanted.select(
            F.col(SENDER).alias("sender"),
            F.col(MICROS).alias("us"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
            *VELOCITY_HOURS,
            F.to_date(F.timestamp_micros(MICROS)).alias("day"),
        )
