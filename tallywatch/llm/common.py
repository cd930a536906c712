"""Shared helpers: the words of a text, stored intermediate tables, and a bound on broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 256


def documents(spark: SparkSession, folder: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared checkpoint folder and reads it back.

    This cuts the lineage: a lost executor costs tasks of the current stage, never the steps
    before it, and a value drawn once (an order, a row number) stays what it is.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows per Arrow batch, so that a Python worker holds a few MB of whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that the caller needs on the driver, refused beyond ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def word_count(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus
