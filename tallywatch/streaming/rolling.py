"""Scoring of micro-batches against everything that came before them.

Statistics and key frequencies grow with the stream as mergeable state: number, mean and squared deviations
of the amounts, and counts per receiver and card. A micro-batch is scored against the state before it and
then adds its own rows' share. The state is kept as levelled runs named by micro-batch (``runs.py``), so a
micro-batch that runs again sees and writes the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywatch import constants as C
from tallywatch.functions.numbers import zero_filled
from tallywatch.operators.rules import (
    CARD_KEYS,
    RECEIVER_KEYS,
    AmountStats,
    Snapshots,
    card_totals,
    receiver_totals,
    score_rules,
)
from tallywatch.streaming.runs import RunStore, Table, summed


def merged_moments(rows: DataFrame) -> DataFrame:
    """One row of (n, mean, m2) from several: means by weight, and squared deviations with those of the means."""

    def both(a: Column, b: Column) -> Column:
        n, off = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"),
            (a["mean"] + off * b["n"] / n).alias("mean"),
            (a["m2"] + b["m2"] + off * off * a["n"] * b["n"] / n).alias("m2"),
        )

    # The rows are those of a table's runs: a few per level.
    parts = F.array_sort(F.collect_list(F.struct("n", "mean", "m2")))
    whole = rows.filter("n > 0").agg(parts.alias("p")).filter(F.size("p") > 0)
    merged = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0], both)
    return whole.select(merged.alias("m")).select("m.*")


def moments(df: DataFrame) -> DataFrame:
    amount = zero_filled(F.col("amount"))
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), F.avg(amount).alias("mean"), (F.var_pop(amount) * n).alias("m2"))


TABLES = {
    "amounts": Table("n bigint, mean double, m2 double", merged_moments, ("n",)),
    "receivers": Table("receiver_first string, receiver_last string, n bigint", summed(RECEIVER_KEYS, "n"), tuple(RECEIVER_KEYS)),
    "cards": Table("card_key string, n bigint", summed(CARD_KEYS, "n"), tuple(CARD_KEYS)),
}


@dataclass(frozen=True)
class RollingScores:
    """Where the state and the scored rows lie."""

    folder: str
    fan: int = 4

    @property
    def store(self) -> RunStore:
        return RunStore(f"{self.folder}/state", TABLES, self.fan)

    def snapshots(self, spark: SparkSession, before: int | None = None) -> Snapshots:
        """Everything before a micro-batch, or everything so far."""
        runs = self.store.manifest(spark, before)
        tables = {name: TABLES[name].merge(self.store.read(spark, name, runs)) for name in TABLES}
        row = tables["amounts"].first()
        stats = AmountStats(0)
        if row is not None:
            spread = (row["m2"] / (row["n"] - 1)) ** 0.5 if row["n"] > 1 else None
            stats = AmountStats(row["n"], row["mean"], spread)
        return Snapshots(stats, tables["receivers"], tables["cards"])

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            scored = score_rules(batch, C.V3, self.snapshots(spark, batch_id))
            scored.write.mode("overwrite").parquet(f"{self.folder}/scored/batch_id={batch_id}")
            added = {"amounts": moments(batch), "receivers": receiver_totals(batch), "cards": card_totals(batch)}
            self.store.commit(spark, batch_id, added)
        finally:
            batch.unpersist()

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Processes what is available."""
        return (
            rows.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/scored")
