"""Positions in a global order without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.session import ensure_checkpoint_dir


def ordered_index(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds the 0-based position of each row in the order of ``order`` (unique per row).

    The table is range-partitioned by a global sort and checkpointed, so that every partition's rows
    and numbers are fixed; the position is then the rows in earlier partitions plus the position
    within the partition.
    """
    ensure_checkpoint_dir(df.sparkSession)
    numbered = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint()
    numbered = numbered.withColumn("_part", F.shiftright("_mid", 33))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per sort partition: a window over this table is as small as the partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_mid") - F.shiftleft("_part", 33)
    placed = numbered.join(F.broadcast(offsets), "_part")
    return placed.select(*df.columns, (F.col("_offset") + within).alias(out))


def order_statistics(
    df: DataFrame, key: str, ranks: Sequence[int], total: int, tie: str | None = None, error: float = 1e-3
) -> list:
    """The exact values of a numeric column at the given 0-based ranks.

    Approximate quantiles bracket every rank; one aggregate counts the rows below each bracket,
    and only the rows inside the brackets (a share of about ``4 * error`` each) are ordered, all
    brackets in one sort, by ``key`` and then ``tie``, which together must be unique.
    """
    ranks = sorted(set(ranks))
    if not ranks:
        return []
    order = [key, tie] if tie else [key]
    least, most = df.agg(F.min(key), F.max(key)).first()
    probes = [min(1.0, max(0.0, rank / total + side * 2 * error)) for rank in ranks for side in (-1, 1)]
    bounds = df.approxQuantile(key, probes, error)
    brackets = [_bracket(bounds[2 * i], bounds[2 * i + 1], least, most) for i in range(len(ranks))]
    inside = [F.col(key).between(low, high) for low, high in brackets]
    counts = [F.count_if(F.col(key) < low).alias(f"b{i}") for i, (low, _) in enumerate(brackets)]
    counts += [F.count_if(within).alias(f"n{i}") for i, within in enumerate(inside)]
    row = df.agg(*counts).first()
    wanted, start = [], 0
    for i, rank in enumerate(ranks):
        wanted.append(start + rank - row[f"b{i}"])
        start += row[f"n{i}"]
    numbers = F.array_compact(F.array(*(F.when(within, F.lit(i)) for i, within in enumerate(inside))))
    members = df.select(*order, F.explode(numbers).alias("_bracket"))
    placed = ordered_index(members, ["_bracket", *order], "_place").filter(F.col("_place").isin(wanted))
    found = {r["_bracket"]: r[key] for r in placed.collect() if r["_place"] == wanted[r["_bracket"]]}
    if len(found) < len(ranks):
        raise ArithmeticError(f"ranks {ranks} of {key} are not all inside their brackets")
    return [found[i] for i in range(len(ranks))]


def _bracket(low: float, high: float, least, most):
    """Quantiles come as doubles, which cannot hold every bigint: widen by more than their spacing."""
    if not isinstance(least, int):
        return low, high
    low, high = int(low), int(high)
    return max(least, low - 1 - abs(low) // 2**50), min(most, high + 1 + abs(high) // 2**50)


def block_of(value: Column, starts: Sequence[int]) -> Column:
    """Index of the last block whose first value is not above ``value``."""
    index = F.lit(None).cast("int")
    for i, start in enumerate(starts):
        index = F.when(value >= start, i).otherwise(index)
    return index
