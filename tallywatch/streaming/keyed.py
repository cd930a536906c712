"""Velocities as keyed state: event time, a watermark and timers, without reading stored rows again.

The senders' times of the last 24 hours lie in the state store, by cells of six hours and packed. A transaction is an
*entry* under one of ``salts`` keys of its sender and a *question* under all of them, so a sender with
a third of all rows is spread over several tasks; the partial counts of a transaction are added
up when results are read. Senders share ``buckets`` keys, so that a call handles the rows of many senders at once. A question
waits until the watermark passes its time and is answered by a
timer, so results are exact for any order of arrival within ``delay``. A row later than that is not
counted: it comes out as late. A cell leaves the state when no question can reach it any more, so the state of
a key is bounded by its entries of 30 hours and the delay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallywatch.constants import VELOCITY_HOURS
from tallywatch.operators.velocity import HOUR, account_key

REACH = max(VELOCITY_HOURS.values())
PARTIAL = "txn_id bigint, sender string, us bigint, late boolean, " + ", ".join(f"{c} bigint" for c in VELOCITY_HOURS)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOURS = list(VELOCITY_HOURS.values())
CELL = 6 * HOUR  # of stored rows: every cell is a call to the state store


ENTRY = pa.schema([("sender", pa.string()), ("us", pa.int64())])
QUESTION = pa.schema([("sender", pa.string()), ("us", pa.int64()), ("txn_id", pa.int64())])


class TrailingCounts(StatefulProcessor):
    """State of one (bucket of senders, salt): times by cell, and the questions that are not answered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "cell bigint", "rows binary")
        self.open = handle.getMapState("questions", "cell bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new = pd.concat(list(rows), ignore_index=True)
        new = new[new["counts"]]  # a heartbeat only moves the watermark
        late = new[new["us"] <= passed]
        if len(late):
            own = late[late["entry"]]  # the salt that would have counted the row lists it
            yield _answers(own, True, np.zeros((len(own), len(HOURS)), np.int64))
        new = new[new["us"] > passed]
        if not len(new):
            return
        for state, rows, schema in ((self.times, new[new["entry"]], ENTRY), (self.open, new, QUESTION)):
            for cell, added in _by_cell(rows, schema):
                before = state.getValue((cell,))
                whole = pa.concat_batches([_unpacked(before, schema), added]) if before else added
                state.updateValue((cell,), (_packed(whole),))
        # Answered when the watermark has passed the last question of an hour so far; later hours have their timer then.
        self.handle.registerTimer(_due(new["us"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        questions = _rows((packed for _, packed in list(self.open.iterator())), QUESTION)
        stored = list(self.times.iterator())
        ready = questions["us"] <= passed
        if ready.any():
            answered, waiting = questions[ready], dict(_by_cell(questions[~ready], QUESTION))
            yield _answers(answered, False, trailing(_rows((packed for _, packed in stored), ENTRY), answered))
            for cell in np.unique(answered["us"] // CELL).tolist():
                if cell in waiting:
                    self.open.updateValue((cell,), (_packed(waiting[cell]),))
                else:
                    self.open.removeKey((cell,))
        least = passed
        if not ready.all():
            self.handle.registerTimer(_due(questions.loc[~ready, "us"]))
            least = min(passed, int(questions.loc[~ready, "us"].min()))
        # A question in the future is above the watermark, so it reaches back to least - REACH at most.
        cells = [int(cell) for (cell,), _ in stored]
        for cell in cells:
            if (cell + 1) * CELL <= least - REACH * HOUR:
                self.times.removeKey((cell,))
        if any((cell + 1) * CELL > least - REACH * HOUR for cell in cells):
            self._once(max(cells), timerValues)

    def _once(self, cell: int, timerValues) -> None:
        """One timer for the time at which the newest cell can go."""
        at = ((cell + 1) * CELL + REACH * HOUR) // 1000 + 1
        if at > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _due(us: pd.Series) -> int:
    """The time after the last question of the first hour, in milliseconds."""
    return int(us[us // HOUR == us.min() // HOUR].max()) // 1000 + 1


def _by_cell(rows: pd.DataFrame, schema: pa.Schema) -> Iterator[tuple[int, pa.RecordBatch]]:
    ordered = rows[schema.names].sort_values("us", kind="stable")
    cells, starts = np.unique(ordered["us"].to_numpy(np.int64) // CELL, return_index=True)
    whole = pa.RecordBatch.from_pandas(ordered, schema, preserve_index=False)
    for cell, start, end in zip(cells.tolist(), starts.tolist(), [*starts.tolist()[1:], len(ordered)]):
        yield cell, whole.slice(start, end - start)


def _packed(rows: pa.RecordBatch) -> bytes:
    return rows.serialize().to_pybytes()


def _unpacked(packed: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(packed[0])), schema)


def _rows(packed: Iterable[tuple], schema: pa.Schema) -> pd.DataFrame:
    return pa.Table.from_batches((_unpacked(p, schema) for p in packed), schema).to_pandas()


def trailing(entries: pd.DataFrame, questions: pd.DataFrame) -> np.ndarray:
    """Per question the entries of its sender in each trailing range, the question's own time included."""
    code, _ = pd.factorize(np.concatenate([entries["sender"], questions["sender"]]))
    own, asked = code[: len(entries)], code[len(entries) :]
    times = np.unique(entries["us"].to_numpy(np.int64))
    # A sender and a time as one number: times count by their place among all entries' times.
    places = len(times) + 1
    every = np.sort(own * places + np.searchsorted(times, entries["us"].to_numpy(np.int64), side="right"))
    us = questions["us"].to_numpy(np.int64)

    def upto(at: np.ndarray) -> np.ndarray:
        return np.searchsorted(every, asked * places + np.searchsorted(times, at, side="right"), side="right")

    return np.stack([upto(us) - upto(us - h * HOUR) for h in HOURS], axis=1)


def _answers(rows: pd.DataFrame, late: bool, counts: np.ndarray) -> pd.DataFrame:
    frame = rows[["txn_id", "sender", "us"]].astype({"txn_id": np.int64, "us": np.int64}).reset_index(drop=True)
    frame["late"] = late
    for i, name in enumerate(VELOCITY_HOURS):
        frame[name] = counts[:, i]
    return frame


@dataclass(frozen=True)
class KeyedVelocity:
    """``folder`` holds the partial counts; ``delay`` is how late a row may come."""

    folder: str
    delay: str = "1 hour"
    salts: int = 4
    buckets: int = 64

    def partials(self, rows: DataFrame) -> DataFrame:
        """The stream of partial counts of rows with txn_id, ts and sender_account; a row without a time is left out,
        one without an id only moves the watermark."""
        salt = F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1)))
        own = F.pmod(F.xxhash64("txn_id"), F.lit(self.salts))
        keyed = (
            rows.filter(F.col("ts").isNotNull())
            .withWatermark("ts", self.delay)
            .select("txn_id", account_key(F.col("sender_account")).alias("sender"), F.unix_micros("ts").alias("us"), salt.alias("salt"))
            .withColumn("entry", F.col("salt") == own)
            # An id beside a missing one would pass through a double.
            .withColumns({"counts": F.col("txn_id").isNotNull(), "txn_id": F.coalesce("txn_id", F.lit(0).cast("bigint"))})
            .withColumn("bucket", F.pmod(F.xxhash64("sender"), F.lit(self.buckets)))
        )
        return keyed.groupBy("bucket", "salt").transformWithStateInPandas(
            statefulProcessor=TrailingCounts(), outputStructType=PARTIAL, outputMode="append", timeMode="eventTime"
        )

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        """Processes what is available; a micro-batch that runs again replaces its own files."""
        rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        return (
            self.partials(rows)
            .writeStream.foreachBatch(partial(_replace, f"{self.folder}/partials"))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def _read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{PARTIAL}, batch_id bigint").parquet(f"{self.folder}/partials")

    def results(self, spark: SparkSession) -> DataFrame:
        """txn_id and velocities of all rows that the watermark has passed."""
        return self._read(spark).filter(~F.col("late")).groupBy("txn_id").agg(*(F.sum(c).alias(c) for c in VELOCITY_HOURS))

    def late(self, spark: SparkSession) -> DataFrame:
        """txn_id, sender and us of rows that came after the watermark had passed their time."""
        return self._read(spark).filter("late").select("txn_id", "sender", "us")


def _replace(folder: str, batch: DataFrame, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
