"""Scoring of incoming transactions against stored snapshots.

Every step is a projection or a stream-static join, so the query keeps no state: a lost executor
costs a re-read of the micro-batch. Rules that need the whole batch read a stored one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywatch import constants as C
from tallywatch.operators.features import build_features
from tallywatch.operators.hybrid import without_models
from tallywatch.operators.rules import SINGLE_RECORD, AmountStats, Snapshots, score_rules
from tallywatch.plans.models import Models, blend, with_model_columns
from tallywatch.sources.files import JSON_RECORD, JSON_SCHEMA, from_json_rows, named_rejects


def save_snapshots(snapshots: Snapshots, folder: str) -> None:
    """Statistics and frequencies of a batch, as tables for streams to read."""
    tables = {"receivers": snapshots.receivers, "cards": snapshots.cards}
    spark = next(t for t in tables.values() if t is not None).sparkSession
    stats = snapshots.stats
    row = [(stats.rows, stats.mean, stats.std)]
    spark.createDataFrame(row, "rows bigint, mean double, std double").write.mode("overwrite").parquet(f"{folder}/stats")
    for name, table in tables.items():
        if table is not None:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_snapshots(spark: SparkSession, folder: str) -> Snapshots:
    stats = AmountStats(*spark.read.parquet(f"{folder}/stats").first())
    return Snapshots(stats, spark.read.parquet(f"{folder}/receivers"), spark.read.parquet(f"{folder}/cards"))


def read_transaction_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """JSON-lines transactions arriving in a folder, in canonical form; ``read_reject_stream`` has those without an amount."""
    rows = spark.readStream.schema(JSON_SCHEMA).options(**options).json(folder)
    return from_json_rows(rows.filter(F.col("amount").isNotNull()))


def read_reject_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The records of the same stream that cannot be scored, with the reason, for a table of their own."""
    return named_rejects(spark.readStream.schema(JSON_RECORD).options(**options).json(folder), "stream")


def score_stream(
    rows: DataFrame, snapshots: Snapshots = SINGLE_RECORD, models: Models | None = None
) -> DataFrame:
    """Rule scores (v3) of each row, blended with the models when given.

    Without snapshots a row stands alone: its keys count once and it has no z. The anomaly is
    rescaled by the range stored with the models.
    """
    scored = score_rules(rows, C.V3, snapshots)
    if models is None:
        return without_models(scored)
    carried = tuple(c for c in scored.columns if c != "txn_id")
    featured = build_features(scored, snapshots.stats, models.codes, keep=carried, stateless=True)
    rated = with_model_columns(featured, models).drop(*(c for c in C.FEATURE_COLUMNS if c not in scored.columns))
    return blend(rated, models.raw_low, models.raw_high)


def write_stream(scored: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, each row exactly once, and stops when the input is used up."""
    return (
        scored.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(folder)
    )
