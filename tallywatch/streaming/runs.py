"""State tables of a stream as levelled runs with a manifest.

A micro-batch adds one run per table. When a level has ``fan`` runs they are merged into one run of the
next level, so a table of n micro-batches has at most ``fan`` runs per level and log n levels, and every row is
rewritten log n times. Which runs are live is written last, as one small table per micro-batch: until
it is there, readers see the state before. A micro-batch that runs again starts from the manifest
before it and writes the same runs over; runs that neither this nor the manifest before names are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, level int, path string"


@dataclass(frozen=True)
class Table:
    """``merge`` turns the rows of several runs into those of one; ``order`` sorts a merged run, and
    ``partitions`` are columns of folders."""

    schema: str
    merge: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...]
    partitions: tuple[str, ...] = ()


@dataclass(frozen=True)
class RunStore:
    folder: str
    tables: dict[str, Table]
    fan: int = 4

    def manifest(self, spark: SparkSession, before: int | None = None) -> list[tuple[str, int, str]]:
        """(table, level, path) of the live runs of the newest manifest, or the newest before a micro-batch."""
        versions = [v for v in self._versions(spark) if before is None or v < before]
        if not versions:
            return []
        rows = spark.read.schema(MANIFEST).parquet(self._manifest_path(max(versions))).collect()
        return [(r["name"], r["level"], r["path"]) for r in rows]

    def read(self, spark: SparkSession, name: str, runs: list[tuple[str, int, str]]) -> DataFrame:
        """The rows of all given runs of a table, not merged."""
        paths = [path for table, _, path in runs if table == name]
        if not paths:
            return spark.createDataFrame([], self.tables[name].schema)
        frames = (spark.read.schema(self.tables[name].schema).option("basePath", p).parquet(p) for p in paths)
        whole = next(frames)
        for frame in frames:
            whole = whole.unionByName(frame)
        return whole

    def current(self, spark: SparkSession, name: str) -> DataFrame:
        """The table as of the newest manifest, merged."""
        return self.tables[name].merge(self.read(spark, name, self.manifest(spark)))

    def commit(self, spark: SparkSession, batch_id: int, added: dict[str, DataFrame]) -> None:
        """Writes the runs of a micro-batch, merges full levels, and swaps the manifest."""
        before = self.manifest(spark, batch_id)
        live = list(before)
        for name, rows in added.items():
            live.append((name, 0, self._write(rows, name, 0, batch_id)))
            level = 0
            while len(full := [run for run in live if run[:2] == (name, level)]) >= self.fan:
                merged = self.tables[name].merge(self.read(spark, name, full))
                live = [run for run in live if run not in full]
                live.append((name, level + 1, self._write(merged, name, level + 1, batch_id)))
                level += 1
        manifest = spark.createDataFrame(live, MANIFEST)
        manifest.coalesce(1).write.mode("overwrite").parquet(self._manifest_path(batch_id))
        self._forget(spark, batch_id, {path for *_, path in live} | {path for *_, path in before})

    def _write(self, rows: DataFrame, name: str, level: int, batch_id: int) -> str:
        """A run of one micro-batch has few files per folder, a large folder several; merged ones are sorted by key as
        well, so that the statistics of a file say which keys it can hold."""
        table, path = self.tables[name], f"{self.folder}/{name}/{level}-{batch_id}"
        if level:
            rows = rows.repartitionByRange(*table.order).sortWithinPartitions(*table.order)
        elif table.partitions:
            rows = rows.hint("rebalance", *table.partitions)
        rows.write.mode("overwrite").partitionBy(*table.partitions).parquet(path)
        return path

    def _manifest_path(self, version: int) -> str:
        return f"{self.folder}/manifest/{version:020d}"

    def _files(self, spark: SparkSession, folder: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        files, path = self._files(spark, folder)
        return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []

    def _versions(self, spark: SparkSession) -> list[int]:
        """Manifests that were written to their end."""
        folder = f"{self.folder}/manifest"
        return [int(v) for v in self._names(spark, folder) if "_SUCCESS" in self._names(spark, f"{folder}/{v}")]

    def _forget(self, spark: SparkSession, batch_id: int, needed: set[str]) -> None:
        for version in sorted(self._versions(spark))[:-2]:
            if version < batch_id:
                self._delete(spark, self._manifest_path(version))
        for name in self.tables:
            for run in self._names(spark, f"{self.folder}/{name}"):
                path = f"{self.folder}/{name}/{run}"
                if path not in needed and int(run.split("-")[1]) < batch_id:
                    self._delete(spark, path)

    def _delete(self, spark: SparkSession, folder: str) -> None:
        files, path = self._files(spark, folder)
        files.delete(path, True)


def as_they_are(rows: DataFrame) -> DataFrame:
    return rows


def summed(key: list[str], value: str) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.groupBy(*key).agg(F.sum(value).alias(value))
