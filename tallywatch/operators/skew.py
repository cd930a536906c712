"""Lookups of per-key values for every row.

One plain left join serves every size. The per-key table has one row per key, and adaptive execution
broadcasts it below its size limit or splits the partitions of hot keys on the row side (skew
joins), so no key's rows have to pass through one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_totals(df: DataFrame, keys: Sequence[str], *extra: Column) -> DataFrame:
    """Rows per key (map-side combined), plus any further aggregates."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *extra)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def attach_by_key(df: DataFrame, totals: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Left-joins columns of a per-key table to every row; rows without a key get nulls.

    ``values`` maps a column of ``totals`` to its name in the result.
    """
    renamed = totals.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(v).alias(out) for v, out in values.items())
    )
    on_key = all_of(F.col(k) == F.col(f"_k_{k}") for k in keys)
    return df.join(renamed, on_key, "left").drop(*(f"_k_{k}" for k in keys))
