"""Keyed tables whose newest version of a key wins, over Parquet in a shared folder.

A micro-batch is reduced to its newest row per key and stored as a run of its own, so storing a batch costs no more than
the batch, and storing it again replaces it. Reading merges the runs: the row with the newest version wins. So that reads
stay short, FAN runs of one level are folded into one run of the next when a later batch is stored: a row is rewritten once
a level, and a table of any number of batches has less than FAN runs on each of a few levels. Runs that a longer one
holds too are removed after ``retain`` more batches, when no reader that began before can still want them.

A run is a folder of its own, and counts when its job has marked it as complete; a job that dies leaves a readable table.
Rows are sorted by key within a run, so that a filter on the key skips what it can.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAN = 8
COMPLETE = "_SUCCESS"
BATCH = "_batch"


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The newest row of every key; each map task keeps one row per key before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in version])
    return df.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")


def as_documents(df: DataFrame, key: str) -> DataFrame:
    """Rows as documents: ``_id`` and the whole row as JSON."""
    return df.select(F.col(key).cast("string").alias("_id"), F.to_json(F.struct("*")).alias("document"))


@dataclass(frozen=True, order=True)
class Run:
    """Batches ``first`` to ``last``; level 0 is one batch as it came."""

    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}"

    @classmethod
    def named(cls, name: str) -> Run | None:
        parts = name.split("-")
        if len(parts) != 4 or parts[0] != "run" or not all(part.isdigit() for part in parts[1:]):
            return None
        return cls(int(parts[2]), int(parts[3]), int(parts[1]))

    def holds(self, other: Run) -> bool:
        return self != other and self.first <= other.first and other.last <= self.last and self.level > other.level


@dataclass(frozen=True)
class KeyedTable:
    """A table of ``schema`` with unique ``keys``; of two rows the one higher in ``version`` stays.

    ``partitions`` names columns the files are laid out by (a day, say), which readers can prune on. They must be
    part of the key or depend on it. Rows of a later batch win when versions are equal. Batches are numbered and stored one
    after the other by a single writer; readers may come at any time.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...]
    version: tuple[str, ...]
    partitions: tuple[str, ...] = ()
    fan: int = FAN
    retain: int = 2 * FAN

    def create(self) -> None:
        """Make the folder if it is missing."""
        store, folder = self._store()
        store.mkdirs(folder)

    def apply(self, df: DataFrame, batch_id: int) -> None:
        """Store a micro-batch, after folding what earlier ones have left."""
        self._fold(batch_id)
        columns = self.spark.createDataFrame([], self.schema).columns
        newest = latest_per_key(df.select(columns), self.keys, self.version).withColumn(BATCH, F.lit(batch_id).cast("long"))
        self._write(newest, Run(batch_id, batch_id, 0))
        self._forget(batch_id)

    def read(self, where: Column | None = None) -> DataFrame:
        """The newest row of every key; ``where``, on key and partition columns only, is answered before versions are compared."""
        return self._newest(self.runs(), where).drop(BATCH)

    def compact(self) -> None:
        """Fold all that is stored into one run, if there are several."""
        runs = self.runs()
        if len(runs) > 1:
            self._merge(runs)

    def runs(self) -> list[Run]:
        """The runs that together hold every batch once, oldest first."""
        known = self._complete()
        return sorted(run for run in known if not any(other.holds(run) for other in known))

    def _merge(self, runs: list[Run]) -> None:
        level = 1 + max(run.level for run in runs)
        self._write(self._newest(runs, None), Run(runs[0].first, max(run.last for run in runs), level))

    def _fold(self, batch_id: int) -> None:
        """Runs of batches before this one: whenever a level has FAN neighbours, they become one of the next."""
        while True:
            runs = [run for run in self.runs() if run.last < batch_id]
            for level in sorted({run.level for run in runs}):
                same = [run for run in runs if run.level == level]
                if len(same) >= self.fan:
                    self._merge(same)
                    break
            else:
                return

    def _forget(self, batch_id: int) -> None:
        store, folder = self._store()
        known = self._complete()
        for run in known:
            longer = [other.last for other in known if other.holds(run)]
            if longer and min(longer) + self.retain <= batch_id:
                store.delete(self._path(run.name), True)

    def _newest(self, runs: list[Run], where: Column | None) -> DataFrame:
        columns = f"{self.schema}, {BATCH} long"
        if not runs:
            return self.spark.createDataFrame([], columns)
        # The folders of the runs differ, but below them lie the same partitions.
        parts = [self.spark.read.schema(columns).parquet(f"{self.path}/{run.name}") for run in runs]
        names = parts[0].columns if not self.partitions else self.spark.createDataFrame([], columns).columns
        rows = parts[0].select(names)
        for part in parts[1:]:
            rows = rows.unionByName(part.select(names))
        rows = rows if where is None else rows.filter(where)
        return latest_per_key(rows, self.keys, (*self.version, BATCH)) if len(runs) > 1 else rows

    def _write(self, df: DataFrame, run: Run) -> None:
        sorted_rows = df.sortWithinPartitions(*self.partitions, *[key for key in self.keys if key not in self.partitions])
        writer = sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer = writer.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        (writer.partitionBy(*self.partitions) if self.partitions else writer).parquet(f"{self.path}/{run.name}")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _store(self):
        folder = self._path()
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _complete(self) -> list[Run]:
        store, folder = self._store()
        if not store.exists(folder):
            return []
        found = [Run.named(entry.getPath().getName()) for entry in store.listStatus(folder)]
        return [run for run in found if run is not None and store.exists(self._path(f"{run.name}/{COMPLETE}"))]
