"""Splits, weak labels and classifier metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators.ranking import order_statistics

UNIT = 1 << 30


def uniform(*keys: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) per key: the same row always falls the same way."""
    return F.pmod(F.xxhash64(*keys), F.lit(UNIT)) / float(UNIT)


def stratified_split(df: DataFrame, share: float = C.HOLDOUT_SHARE, seed: int = C.SPLIT_SEED) -> DataFrame:
    """Adds ``is_test``. A hash of the row id takes the same share of every label, without a shuffle."""
    digest = F.md5(F.concat_ws(":", F.col("txn_id").cast("string"), F.lit(str(seed))).cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)
    return df.withColumn("is_test", place < share)


def weak_label_threshold(df: DataFrame, raw: str = "anomaly_raw", share: float = C.WEAK_LABEL_SHARE) -> float:
    """The exact quantile of the raw anomaly score, interpolated between its two neighbours."""
    total = df.count()
    position = share * (total - 1)
    low = math.floor(position)
    high = min(low + 1, total - 1)
    values = order_statistics(df.select(raw, "txn_id"), raw, [low, high], total, tie="txn_id")
    return values[0] + (values[-1] - values[0]) * (position - low)


def weak_labels(df: DataFrame, raw: str = "anomaly_raw", share: float = C.WEAK_LABEL_SHARE) -> DataFrame:
    """The most anomalous share of the rows becomes the positive class."""
    threshold = weak_label_threshold(df, raw, share)
    return df.withColumn("label", (F.col(raw) < F.lit(threshold)).cast("int"))


def class_counts(df: DataFrame) -> tuple[int, int, float]:
    """(positives, negatives, weight of a positive row)."""
    positive, negative = df.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    return positive, negative, (negative / positive if positive else 1.0)


def classifier_metrics(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Precision, recall and F1 of class 1 (0 where undefined) and the class balance, in one pass."""
    said, truly = F.col(prediction) == 1, F.col("label") == 1
    counts = df.agg(
        F.count_if(said & truly).alias("true_positives"),
        F.count_if(said).alias("predicted"),
        F.count_if(truly).alias("positives"),
        F.count_if(~truly).alias("negatives"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    precision = ratio(F.col("true_positives"), F.col("predicted"))
    recall = ratio(F.col("true_positives"), F.col("positives"))
    return counts.select(
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        "positives",
        "negatives",
        F.coalesce(F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")), F.lit(1.0)).alias("positive_weight"),
    )
