"""The additive operators on unbounded input. Each equals its batch form once the input is drained."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.cleaning import classify_record, duplicate_key, valid_records
from keyloom.operators.keys import key_label_counts
from keyloom.operators.ledger import round_sums
from keyloom.operators.terms import term_statistics
from keyloom.session import ensure_checkpoint_dir
from keyloom.sources.reviews import parse_lines


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a growing directory of JSONL files; ``seq`` names the file."""
    lines = spark.readStream.text(path)
    return lines.select(F.col("_metadata.file_path").alias("seq"), "value")


def stream_classify(lines: DataFrame) -> DataFrame:
    """Status of every arriving line; no state."""
    return classify_record(parse_lines(lines))


def stream_clean(lines: DataFrame) -> DataFrame:
    """Valid records of the arriving lines, duplicates included."""
    return valid_records(stream_classify(lines))


def stream_cleaning_report(lines: DataFrame) -> DataFrame:
    """Lines of each status so far; one row of state per status."""
    return stream_classify(lines).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stream_dedup(records: DataFrame, columns: Sequence[str], time: str | None = None, horizon: str | None = None) -> DataFrame:
    """First arrival of each group of equal ``columns``.

    State holds one digest per group: with ``time`` and ``horizon`` as long as that column's watermark says; with
    ``horizon`` alone that long after the group's first arrival, by the time of the batch, so that the state is bounded
    by what arrives within the horizon whatever the records say; without both for ever. Keep such state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``): it then lies on disk, and a restart reads it from the checkpoint.
    """
    keyed = records.withColumn("__key", duplicate_key(columns))
    if time is None and horizon is None:
        return keyed.dropDuplicates(["__key"]).drop("__key")
    if time is None:
        arrived = keyed.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", horizon)
        return arrived.dropDuplicatesWithinWatermark(["__key"]).drop("__key", "__arrived")
    return keyed.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def stream_term_statistics(documents: DataFrame, text: str, low: int = 1, high: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Running term and document frequencies; one row of state per term."""
    return term_statistics(documents, text, low, high, by)


def append_term_statistics(documents: DataFrame, text: str, path: str, checkpoint: str, low: int = 1, high: int = 1):
    """Writes the statistics of every micro-batch beside the earlier ones; merged when read.

    Keeps no state, and a batch that runs twice overwrites its own folder. Read with
    ``merge_term_statistics(spark.read.parquet(path))``.
    """

    def add(batch: DataFrame, number: int) -> None:
        term_statistics(batch, text, low, high).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_round_sums(messages: DataFrame, time: str, width: str = "1 day", lateness: str = "1 day") -> DataFrame:
    """Participants and bytes of each time window, final once the watermark passes; later messages are dropped."""
    timed = messages.withWatermark(time, lateness).withColumn("round", F.window(time, width))
    return round_sums(timed, [], "round").withColumn("round", F.col("round.start"))


def stream_key_label_counts(records: DataFrame, key: str, label: str, classes: int) -> DataFrame:
    """Running label counts of every key; one row of state per key."""
    return key_label_counts(records, key, label, classes)


def drain(stream: DataFrame, mode: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, some: bool = False) -> DataFrame:
    """Processes all input there is now and returns the result table, kept in the shared checkpoint folder.

    ``complete`` keeps the last result, ``append`` the union of all. ``some``: it is an error if no batch arrives.
    """
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    written: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{folder}/result/batch={number}")
        written.append(number)

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not written:
        if some:
            raise RuntimeError("no batch arrived, although the input is not empty")
        return prepare(spark.createDataFrame([], stream.schema))
    if mode == "complete":
        return spark.read.parquet(f"{folder}/result/batch={max(written)}")
    return spark.read.parquet(f"{folder}/result").drop("batch")
