"""A stored layout in which a lookup by id, reference or account reads few files.

Rows lie in files of disjoint id ranges, sorted inside, with Bloom filters on the keys of a lookup. For
every other key a narrow table (key, txn_id) is laid out the same way by the key. Beside each table lies
its *directory*: one row per file with the least and greatest key. A lookup asks the directory, opens only files
whose range holds the key, and inside a file statistics and Bloom filters leave out row groups.
A key with very many rows lies in many files, none of which holds more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_KEY = "txn_id"
LOOKUP_KEYS = ("reference", "sender_account")


def save_lookup(
    rows: DataFrame, folder: str, keys: Sequence[str] = LOOKUP_KEYS, files: int | None = None, distinct: int = 1_000_000, **options: str
) -> None:
    """Writes the layout in ``files`` files a table, by default as many as adaptive execution makes; ``distinct`` is
    how many keys a file's Bloom filters are made for."""
    present = [k for k in keys if k in rows.columns]
    _save(rows, f"{folder}/rows", [ROW_KEY], [ROW_KEY, *present], files, distinct, options)
    for key in present:
        pairs = rows.filter(F.col(key).isNotNull()).select(key, ROW_KEY)
        _save(pairs, f"{folder}/by_{key}", [key, ROW_KEY], [key], files, distinct, options)


def _save(
    rows: DataFrame, folder: str, order: list[str], filtered: list[str], files: int | None, distinct: int, options: dict[str, str]
) -> None:
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    writer = dealt.sortWithinPartitions(*order).write.mode("overwrite").options(**options)
    for key in filtered:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct))
    writer.parquet(f"{folder}/data")
    spark, key = rows.sparkSession, order[0]
    written = spark.read.schema(rows.schema).parquet(f"{folder}/data").select(key, F.input_file_name().alias("file"))
    spans = written.groupBy("file").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    spans.repartitionByRange("low").sortWithinPartitions("low").write.mode("overwrite").parquet(f"{folder}/directory")


def _between(spark: SparkSession, folder: str, low: Column, high: Column) -> DataFrame | None:
    """The files whose range meets the given one, as a table; None where there is none."""
    spans = spark.read.parquet(f"{folder}/directory").filter((F.col("low") <= high) & (F.col("high") >= low))
    files = [r["file"] for r in spans.select("file").collect()]  # one row per file that is opened
    return spark.read.schema(spark.read.parquet(f"{folder}/data").schema).parquet(*files) if files else None


def _none(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([], spark.read.parquet(f"{folder}/data").schema)


def find(spark: SparkSession, folder: str, key: str, value) -> DataFrame:
    """All rows with ``key`` equal to ``value``: the id itself, or one of the other keys."""
    rows, wanted = f"{folder}/rows", F.lit(value)
    if value is None:
        return _none(spark, rows)
    if key == ROW_KEY:
        near = _between(spark, rows, wanted, wanted)
        return _none(spark, rows) if near is None else near.filter(F.col(key) == wanted)
    pairs = _between(spark, f"{folder}/by_{key}", wanted, wanted)
    if pairs is None:
        return _none(spark, rows)
    low, high = pairs.filter(F.col(key) == wanted).agg(F.min(ROW_KEY), F.max(ROW_KEY)).first()
    near = None if low is None else _between(spark, rows, F.lit(low), F.lit(high))
    if near is None:
        return _none(spark, rows)
    inside = F.col(ROW_KEY).between(low, high)  # reaches the scan, beside the key itself
    return near.filter(inside & (F.col(key) == wanted))

