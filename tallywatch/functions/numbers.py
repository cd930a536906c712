"""Parsing and shaping of numbers and timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number: decimal or scientific notation, or an infinity, with outer blanks.
# Spark alone would also take a type suffix such as "1d".
NUMBER_PATTERN = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\s*$"

TIMESTAMP_FORMATS = (
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
)


def parse_number(value: Column, dtype: T.DataType) -> Column:
    """A double, or null where the value is missing, NaN or not a number."""
    if isinstance(dtype, T.StringType):
        text = F.trim(value)
        parsed = F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
    else:
        parsed = value.cast("double")
    return F.when(~F.isnan(parsed), parsed)


def parse_timestamp(value: Column, dtype: T.DataType, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """A timestamp in the session zone, or null where the text is no timestamp."""
    if isinstance(dtype, T.StringType):
        text = F.trim(value)
        return F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return value.cast("timestamp")
    return F.lit(None).cast("timestamp")


def zero_filled(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0.0))


def finite(value: Column) -> Column:
    """Null in place of NaN and the infinities."""
    infinity = F.lit(float("inf"))
    return F.when(~F.isnan(value) & (F.abs(value) != infinity), value)


def clipped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def json_safe(df: DataFrame) -> list[Column]:
    """The columns of ``df`` with NaN/infinite numbers nulled and timestamps as text."""
    safe = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = finite(column)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            column = column.cast("string")
        safe.append(column.alias(field.name))
    return safe


def row_json(df: DataFrame) -> Column:
    """One JSON object per row, safe for consumers without NaN."""
    return F.to_json(F.struct(*json_safe(df)))
