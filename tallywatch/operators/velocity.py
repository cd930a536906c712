"""Trailing counts per sender and first sight of a payee, in linear time and exact under any skew.

A sender's rows in (t - w, t] are the rows up to t less those up to t - w. So every distinct time of a
sender asks for running counts at t and at each t - w, and a running count has two parts: whole
minutes before, summed over one row per sender and minute, and the running sum within the minute.
No window frame moves, no task holds more of a sender than one of its minutes or one row per minute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywatch.constants import VELOCITY_HOURS
from tallywatch.operators.skew import attach_by_key, key_totals

HOUR = 3_600_000_000
CELL = 60_000_000
SENDER, PAYEE, MICROS = "_sender", "_payee", "_us"


def account_key(column: Column) -> Column:
    """Missing accounts form one nameless account."""
    return F.coalesce(column, F.lit(""))


def with_velocity(df: DataFrame, sender: str | None, receiver: str | None, source: DataFrame | None = None) -> DataFrame:
    """Adds ``velocity_*`` (rows of the sender in (t-w, t], equal times included; 1 without a
    time) and ``is_new_payee`` (first row of the pair by time and then ``txn_id``; rows without a
    time come last).

    All of it is worked out on id, accounts and time; the whole rows are shuffled once, by their id. These
    columns are read from ``source``, the rows before joins that made them wide, when it is given.
    """
    if sender is None:
        return df.withColumns({**{c: F.lit(1).cast("bigint") for c in VELOCITY_HOURS}, "is_new_payee": F.lit(0)})
    narrow = source if source is not None else df
    own = [c for c in dict.fromkeys(("txn_id", "ts", sender, receiver)) if c in narrow.columns]
    flagged = velocities(narrow.select(*own), sender, receiver)
    added = [*VELOCITY_HOURS, "is_new_payee"]
    if set(df.columns) <= set(own):
        return flagged.select(*df.columns, *added)
    found = flagged.select(F.col("txn_id").alias("_of"), *added)
    return df.join(found, F.col("txn_id") == F.col("_of"), "left").select(*df.columns, *added)


def velocities(df: DataFrame, sender: str, receiver: str | None) -> DataFrame:
    """The rows with their velocities and whether they are the first of their pair."""
    micros = F.unix_micros("ts") if "ts" in df.columns else F.lit(None).cast("bigint")
    payee = account_key(F.col(receiver)) if receiver else F.lit(None).cast("string")
    rows = df.select("*", account_key(F.col(sender)).alias(SENDER), payee.alias(PAYEE), micros.alias(MICROS))
    counted = attach_by_key(rows, trailing_counts(rows), [SENDER, MICROS], {c: c for c in VELOCITY_HOURS})
    counted = counted.withColumns({c: F.coalesce(F.col(c), F.lit(1)).cast("bigint") for c in VELOCITY_HOURS})
    if receiver is None:
        return counted.withColumn("is_new_payee", F.lit(0))
    firsts = first_rows(rows, [SENDER, PAYEE]).select(F.col("txn_id").alias("_first"))
    met = counted.join(firsts, F.col("txn_id") == F.col("_first"), "left")
    return met.withColumn("is_new_payee", F.col("_first").isNotNull().cast("int"))


def trailing_counts(rows: DataFrame) -> DataFrame:
    """One row per sender and distinct time, with the sender's rows in each trailing range."""
    return trailing_counts_of(key_totals(rows.filter(F.col(MICROS).isNotNull()), [SENDER, MICROS]))


def trailing_counts_of(slots: DataFrame) -> DataFrame:
    """The same from the number ``n`` of rows per sender and distinct time."""
    asked = F.array(
        F.struct(F.lit(0).alias("hours"), F.col(MICROS).alias("at"), F.col("n")),
        *(
            F.struct(F.lit(h).alias("hours"), (F.col(MICROS) - h * HOUR).alias("at"), F.lit(0).cast("bigint").alias("n"))
            for h in VELOCITY_HOURS.values()
        ),
    )
    events = slots.select(SENDER, MICROS, F.inline(asked)).withColumn("cell", F.floor(F.col("at") / CELL))
    so_far = Window.partitionBy(SENDER, "cell").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = events.withColumn("within", F.sum("n").over(so_far))
    cells = events.groupBy(SENDER, "cell").agg(F.sum("n").alias("cell_n"))
    earlier = Window.partitionBy(SENDER).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(
        F.col(SENDER).alias("_of"), F.col("cell").alias("_cell"), F.coalesce(F.sum("cell_n").over(earlier), F.lit(0)).alias("before")
    )
    met = within.join(before, (F.col(SENDER) == F.col("_of")) & (F.col("cell") == F.col("_cell")))
    up_to = F.col("before") + F.col("within")

    def count_at(hours: int) -> Column:
        return F.sum(F.when(F.col("hours") == hours, up_to))

    return met.groupBy(SENDER, MICROS).agg(*((count_at(0) - count_at(h)).alias(name) for name, h in VELOCITY_HOURS.items()))


def first_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the ``txn_id`` of each group's first row by time and then id; no time is last."""
    place = F.struct(F.col(MICROS).isNull().alias("untimed"), F.col(MICROS).alias("us"), "txn_id")
    return rows.groupBy(*keys).agg(F.min(place).alias("first")).select(*keys, "first.txn_id", "first.us")
