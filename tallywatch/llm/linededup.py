"""Line dedup against levelled sorted runs of line hashes; DataFrame functions only.

The lines seen so far live in a few *runs*: tables of 128-bit line hashes, bucketed and sorted by
hash. Documents come in batches of ascending ids. A batch's line hashes are merge-anti-joined
with every run; those found in a run were in a document with a smaller id, and go. The others are
new: within the batch the smallest id holding one keeps it, and the new hashes become a run of
level 0. ``FAN_IN`` runs of a level are merged into one run of the next, so a batch meets a
number of runs that is logarithmic in the number of batches.

Defined results: a null text is one empty line; rows with the same id are one document (its rows
keep a line that none with a smaller id has); a null id counts as the largest; equal rows give
equal results; an empty table gives no rows; extra columns are kept by ``drop_lines`` and ignored by
the query, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywatch.llm.common import documents, lower_ascii, stored
from tallywatch.session import ensure_checkpoint_dir

BATCHES = 4
FAN_IN = 3
LEAST_LENGTH = 10
BLANK = " \t\n\x0b\f\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


class LineRuns:
    """Levelled runs of line hashes; the state between batches, all of it in shared tables."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN):
        """By default a run has as many buckets as a shuffle has partitions: a task then writes one
        file of a run, and the joins with a batch need no further shuffle of the run."""
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[str]] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, hashes: DataFrame) -> None:
        """Adds distinct, new hashes as a run of level 0 and compacts full levels."""
        self._put(0, hashes)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
            old = self.levels[level]
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.levels[level] = []
            self._put(level + 1, merged)
            for name in old:
                self._drop(name)
            level += 1

    def _put(self, level: int, hashes: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"line_run_{level}_{uuid.uuid4().hex}"
        (
            hashes.select(*HASH)
            .repartition(self.buckets, *HASH)
            .write.option("path", self._path(name))
            .bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .saveAsTable(name)
        )
        self.levels[level].append(name)

    def drop(self) -> None:
        """Forgets all runs and deletes their files."""
        for name in self.runs():
            self._drop(name)
        self.levels = []

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _path(self, name: str) -> str:
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{name}"

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Those rows whose hash is in no run."""
        for name in self.runs():
            hashes = hashes.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
        return hashes


def _batch_of(doc_id: Column, bounds: list) -> Column:
    batch = F.lit(0)
    for bound in bounds:
        batch = batch + (doc_id > F.lit(bound)).cast("int")
    return F.coalesce(batch, F.lit(len(bounds))).cast("int")


def _ranges(docs: DataFrame, batches: int) -> list:
    """Ids that split the documents into batches of about equal numbers; any bounds are right."""
    if batches < 2:
        return []
    parts = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", parts, 1000).alias("p")).first()["p"]
    return sorted(set(found or []))


def dropped_lines(docs: DataFrame, batches: int = BATCHES, state: LineRuns | None = None) -> DataFrame:
    """doc_id, text_hash and gone: the 1-based numbers, ascending, of the lines a document loses.

    ``docs`` has doc_id, text and text_hash. Only rows of hashes are shuffled here.
    """
    spark = docs.sparkSession
    bounds = _ranges(docs, batches)
    lines = docs.select(
        "doc_id", "text_hash", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line")
    ).select("doc_id", "text_hash", (F.col("at") + 1).alias("at"), line_key(F.col("line")).alias("key"))
    hashed = (
        lines.filter(F.char_length("key") >= LEAST_LENGTH)
        .select(
            "doc_id",
            "text_hash",
            "at",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit("second"), "key").alias("h2"),
            _batch_of(F.col("doc_id"), bounds).alias("batch"),
        )
    )
    hashed = stored(hashed, "line-hashes")
    runs = state or LineRuns(spark)
    gone = None
    for batch in range(len(bounds) + 1):
        own = hashed.filter(F.col("batch") == batch)
        # Counted per hash before the shuffle: a line in a third of all documents is a few rows here.
        held = own.groupBy(*HASH).agg(F.min("doc_id").alias("holder"))
        new = stored(runs.unseen(held), "line-new")
        # Lines whose hash is not new, or is held by a smaller id of this batch.
        lost = own.join(new.withColumn("is_new", F.lit(True)), HASH, "left").filter(
            F.col("is_new").isNull() | ~F.col("holder").eqNullSafe(F.col("doc_id"))
        )
        lost = stored(lost.select("doc_id", "text_hash", "at"), "line-lost")
        gone = lost if gone is None else gone.unionByName(lost)
        runs.add(new)
    if state is None:  # what the batches lose is stored
        runs.drop()
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("at")).alias("gone"))


def drop_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Every row with its kept text, n_lines and n_dropped, as columns ``whole`` (a struct of the
    row's own columns, named c0, c1, ...), ``kept``, ``n_lines`` and ``n_dropped``."""
    whole = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    text_hash = F.xxhash64("text").alias("text_hash")
    gone = dropped_lines(docs.select("doc_id", "text", text_hash), batches).select(
        F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone"
    )
    # A text crosses the shuffle once, inside ``whole``.
    rows = docs.select(whole.alias("whole"), F.col("doc_id").alias("own_id"), text_hash)
    met = rows.join(
        gone, (F.col("text_hash") == F.col("gone_hash")) & F.col("own_id").eqNullSafe(F.col("gone_id")), "left"
    )
    text = F.coalesce(F.col(f"whole.c{docs.columns.index('text')}"), F.lit(""))
    lines = F.split(text, "\n", -1)
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.col("gone")),
        F.concat(F.col("gone"), F.array(F.col("n_lines") + 1)),
        lambda a, b: F.slice(F.col("lines"), a + 1, b - a - 1),
    )
    return (
        met.withColumn("lines", lines)
        .withColumn("n_lines", F.size("lines"))
        .select(
            "whole",
            F.when(F.col("gone").isNull(), text)
            .otherwise(F.array_join(F.flatten(gaps), "\n"))
            .alias("kept"),
            F.col("n_lines").cast("bigint").alias("n_lines"),
            F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
            F.col("gone").isNotNull().alias("changed"),
        )
    )


def without_repeated_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents with their repeated lines gone; an n_chars column follows the text."""
    kept = drop_lines(docs, batches)
    out = []
    for i, c in enumerate(docs.columns):
        own = F.col(f"whole.c{i}")
        if c == "text":
            own = F.when(F.col("changed"), F.col("kept")).otherwise(own)
        elif c == "n_chars":
            own = F.when(F.col("changed"), F.char_length("kept").cast(docs.schema[c].dataType)).otherwise(own)
        out.append(own.alias(c))
    return kept.select(*out)


def op6_line_dedup(spark, folder: str) -> DataFrame:
    kept = drop_lines(documents(spark, folder).select("doc_id", "text"))
    return kept.select(
        F.col("whole.c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


OP6_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, h.key IS NOT NULL AND h.holder <> k.doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
