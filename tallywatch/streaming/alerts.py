"""The state of alerts as actions arrive, without replaying the actions before.

A delivery of actions is reduced to one row per alert and added to the stored histories, which lie in folders by
a hash of the alert and merge as levelled runs (``runs.py``). Histories are maxima, so a delivery that comes
again, under its own number or another, changes nothing. One alert's history is read from its own folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywatch.operators.alerts import HISTORY, HISTORY_SCHEMA, merged_history, reduced_history, with_history
from tallywatch.streaming.runs import RunStore, Table

BUCKETS = 16


def bucket_of(alert_id: Column) -> Column:
    return F.pmod(F.xxhash64(alert_id), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class AlertStates:
    """Where the histories lie."""

    folder: str
    fan: int = 4

    @property
    def store(self) -> RunStore:
        table = Table(f"{HISTORY_SCHEMA}, bucket int", merged_history, ("bucket", "alert_id"), ("bucket",))
        return RunStore(self.folder, {"histories": table}, self.fan)

    def add(self, actions: DataFrame, delivery: int) -> None:
        """Adds a delivery of actions; deliveries are numbered in the order in which they come."""
        known = actions.filter(F.col("alert_id").isNotNull())
        reduced = reduced_history(known).select("alert_id", *HISTORY, bucket_of(F.col("alert_id")).alias("bucket"))
        self.store.commit(actions.sparkSession, delivery, {"histories": reduced})

    def start(self, actions: DataFrame, checkpoint: str) -> StreamingQuery:
        """Adds what has arrived in a stream of actions."""
        return (
            actions.writeStream.foreachBatch(lambda batch, number: self.add(batch, number))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def histories(self, spark: SparkSession) -> DataFrame:
        return self.store.current(spark, "histories").drop("bucket")

    def state(self, alerts: DataFrame) -> DataFrame:
        """All alerts as of the last delivery."""
        return with_history(alerts, self.histories(alerts.sparkSession))

    def one(self, alerts: DataFrame, alert_id: str) -> DataFrame:
        """One alert as of the last delivery; only the folders of its bucket are read."""
        spark = alerts.sparkSession
        own = self.store.read(spark, "histories", self.store.manifest(spark))
        bucket = spark.range(1).select(bucket_of(F.lit(alert_id))).first()[0]
        own = own.filter((F.col("bucket") == bucket) & (F.col("alert_id") == alert_id))
        return with_history(alerts.filter(F.col("alert_id") == alert_id), merged_history(own).drop("bucket"))
