"""Running sums as a log of runs: a batch writes its own keys only, runs of equal size are merged as the log grows.

Batch ``n`` is run ``n`` of level 0. As soon as ``FAN`` neighbours of a level are complete they are merged into one run of the
next level, so a key is rewritten once per level, a logarithm of the number of batches. A run is written once and counts once
its manifest is there; a batch that is replayed finds its run and changes nothing. Readers add up the fewest complete runs
that cover all batches; the runs these were made from stay for readers that began earlier, until :meth:`RunLog.vacuum`.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.keys import class_columns, key_label_counts
from keyloom.operators.terms import term_statistics
from keyloom.sources.sinks import write_once

FAN = 4


class RunLog:
    """A table of sums of ``values`` by ``keys`` below ``folder``, to which batches are added in order of their numbers."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], values: Sequence[str], fan: int = FAN):
        self.spark, self.folder, self.keys, self.values, self.fan = spark, folder.rstrip("/"), list(keys), list(values), fan
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, level: int, index: int) -> str:
        return f"{self.folder}/level={level}/run-{index:010d}"

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def complete(self, level: int, index: int) -> bool:
        return self.files.exists(self._hadoop(f"{self._path(level, index)}.manifest/_SUCCESS"))

    def _read(self, level: int, index: int) -> DataFrame:
        return self.spark.read.parquet(self._path(level, index))

    def merged(self, runs: Sequence[DataFrame]) -> DataFrame:
        """Sums over runs of disjoint batches; they equal the sums over all their rows."""
        whole = reduce(DataFrame.unionByName, runs)
        kinds = dict(whole.dtypes)
        return whole.groupBy(*self.keys).agg(*[F.sum(v).cast(kinds[v]).alias(v) for v in self.values])

    def add(self, sums: DataFrame, number: int) -> None:
        """Writes the sums of batch ``number`` and what it completes. A batch that is there, alone or merged, is not computed again."""
        covered = [level for level in range(self.levels()) if self.complete(level, number // self.fan**level)]
        if any(covered):
            return
        if not covered:
            write_once(sums.select(*self.keys, *self.values), self._path(0, number))
        level, index = 0, number
        while (index + 1) % self.fan == 0:
            below = [(level, k) for k in range(index + 1 - self.fan, index + 1)]
            level, index = level + 1, index // self.fan
            if not self.complete(level, index):
                if not all(self.complete(*run) for run in below):
                    raise RuntimeError(f"{self.folder}: batches up to {number} are not all there")
                write_once(self.merged([self._read(*run) for run in below]), self._path(level, index))

    def levels(self) -> int:
        """How many levels the log has; a logarithm of the number of batches."""
        level = 0
        while self.files.exists(self._hadoop(f"{self.folder}/level={level}")):
            level += 1
        return level

    def runs(self) -> list[tuple[int, int]]:
        """The fewest complete runs that cover all batches from the first to the last without a gap."""
        found, start, levels = [], 0, self.levels()
        while True:
            fitting = (k for k in range(levels - 1, -1, -1) if start % self.fan**k == 0 and self.complete(k, start // self.fan**k))
            level = next(fitting, None)
            if level is None:
                return found
            found.append((level, start // self.fan**level))
            start += self.fan**level

    def table(self) -> DataFrame | None:
        """All sums so far; None if there is no batch."""
        runs = self.runs()
        return self.merged([self._read(*run) for run in runs]) if runs else None

    def vacuum(self) -> list[str]:
        """Deletes the runs that larger ones have replaced, and names them."""
        gone = []
        for level, index in self.runs():
            for k in range(level):
                size = self.fan ** (level - k)
                for below in range(index * size, (index + 1) * size):
                    if self.complete(k, below):
                        self.files.delete(self._hadoop(f"{self._path(k, below)}.manifest"), True)
                        self.files.delete(self._hadoop(self._path(k, below)), True)
                        gone.append(self._path(k, below))
        return gone


def running_sums(stream: DataFrame, sums: Callable[[DataFrame], DataFrame], log: RunLog, checkpoint: str) -> StreamingQuery:
    """Adds every micro-batch of ``stream`` to ``log``; all input there is now, then the query ends. No state is kept."""

    def add(batch: DataFrame, number: int) -> None:
        log.add(sums(batch), number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_term_statistics(documents: DataFrame, text: str, folder: str, checkpoint: str, low: int = 1, high: int = 1) -> tuple[RunLog, StreamingQuery]:
    """Term and document frequencies: a batch writes the terms it has."""
    log = RunLog(documents.sparkSession, folder, ["term"], ["tf", "df"])
    return log, running_sums(documents, lambda batch: term_statistics(batch, text, low, high), log, checkpoint)


def running_key_label_counts(records: DataFrame, key: str, label: str, classes: int, folder: str, checkpoint: str) -> tuple[RunLog, StreamingQuery]:
    """Label counts of every key: a batch writes the keys it has."""
    log = RunLog(records.sparkSession, folder, [key], ["size", *class_columns(classes)])
    return log, running_sums(records, lambda batch: key_label_counts(batch, key, label, classes), log, checkpoint)
