"""Streaming forms over the given tables, drained; the SQL is that of the batch operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import query
from keyloom.catalog.keys import C, EVENT_COUNTS
from keyloom.catalog.records import FIELDS, RAW, STATUS, VALID, document_lines
from keyloom.catalog.statistics import SUMS, per
from keyloom.catalog.tables import ALL_WORDS, EVENT_TYPES, MESSAGES, position, rounded, table, with_
from keyloom.operators import terms
from keyloom.operators.ledger import with_cumulative
from keyloom.session import ensure_checkpoint_dir
from keyloom.streaming import incremental, running

STATS = with_([ALL_WORDS, "tokens AS (SELECT doc_id, unnest(w) AS term FROM words)"],
              "SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tokens GROUP BY term")


# Micro-batches in which a table arrives, and rows of a file of a written copy.
BATCHES, FILE_ROWS = 4, 1_000_000


def stream(spark: SparkSession, sf: str, name: str, time: str | None = None) -> DataFrame:
    """A given table as a stream of files in about ``BATCHES`` micro-batches.

    A folder of part files is streamed itself, a single file from a copy of several files. With ``time`` it is a copy that
    arrives in order of that column, since rows older than the watermark would be dropped; nulls come first.
    """
    given = table(spark, sf, name)
    files = given.inputFiles()
    if time is None and len(files) >= BATCHES:
        return spark.readStream.schema(given.schema).option("maxFilesPerTrigger", -(-len(files) // BATCHES)).parquet(f"{sf}/{name}.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    each = max(1, given.count() // (BATCHES * FILE_ROWS))
    if time is None:
        given.repartition(BATCHES * each).write.parquet(folder)
        return spark.readStream.schema(given.schema).option("maxFilesPerTrigger", each).parquet(folder)
    at = F.unix_micros(utc(time))
    shares = F.array(*[F.lit(k / BATCHES) for k in range(1, BATCHES)])
    cuts = sorted(set(given.agg(F.percentile_approx(at, shares)).first()[0] or []))
    place = sum((F.coalesce(at > c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    written = 0
    whole = True
    for k in range(len(cuts) + 1):  # one after another: a file stream reads files in order of the time they were written
        given.where(place == k).repartition(each).write.mode("append").parquet(folder)
        now = len(spark.read.schema(given.schema).parquet(folder).inputFiles())
        whole, written = whole and now - written in (0, each), now
    ordered = spark.readStream.schema(given.schema)
    # files that do not part at the cuts arrive at once
    return (ordered.option("maxFilesPerTrigger", each) if whole else ordered).parquet(folder)


def drained(spark: SparkSession, sf: str, name: str, result: DataFrame, mode: str) -> DataFrame:
    """The drained result of a stream over a given table; an error if the table has rows and none arrived."""
    return incremental.drain(result, mode, some=not table(spark, sf, name).isEmpty())


def utc(column: str):
    """The tables' zone-less times as UTC instants, whatever the session's time zone."""
    return F.to_timestamp(F.concat(F.col(column).cast("string"), F.lit("Z")))


def stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(stream(spark, sf, "documents"), table(spark, sf, "labels"))


@query(with_([RAW, FIELDS, STATUS], "SELECT status, count(*) AS n FROM classified WHERE is_object GROUP BY status"))
def stream_cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    return drained(spark, sf, "documents", incremental.stream_cleaning_report(stream_lines(spark, sf)), "complete")


@query(with_([RAW, FIELDS, STATUS, VALID], "SELECT seq, label, md5(text) AS digest FROM valid"))
def stream_clean(spark: SparkSession, sf: str) -> DataFrame:
    clean = incremental.stream_clean(stream_lines(spark, sf)).select("seq", "label", F.md5("text").alias("digest"))
    return drained(spark, sf, "documents", clean, "append")


@query("SELECT DISTINCT lang, md5(text) AS digest FROM documents")
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    first = incremental.stream_dedup(stream(spark, sf, "documents"), ["lang", "text"])
    return drained(spark, sf, "documents", first.select("lang", F.md5("text").alias("digest")), "append")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_within_watermark(spark: SparkSession, sf: str) -> DataFrame:
    """First event of each user and type; the horizon spans the whole table."""
    events = stream(spark, sf, "events", "ts").withColumn("ts", utc("ts"))
    first = incremental.stream_dedup(events, ["user_id", "event_type"], "ts", "60 days")
    return drained(spark, sf, "events", first.select("user_id", "event_type"), "append")


@query(STATS)
def stream_term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return drained(spark, sf, "documents", incremental.stream_term_statistics(stream(spark, sf, "documents"), "text"), "complete")


@query(STATS)
def append_term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    running = incremental.append_term_statistics(stream(spark, sf, "documents"), "text", f"{folder}/rows", f"{folder}/state")
    running.awaitTermination()
    return terms.merge_term_statistics(spark.read.parquet(f"{folder}/rows"))


@query(STATS)
def running_term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Every batch writes its own terms, runs are merged as the log grows."""
    folder = f"{ensure_checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"
    log, query = running.running_term_statistics(stream(spark, sf, "documents"), "text", f"{folder}/log", f"{folder}/state")
    query.awaitTermination()
    return log.table()


@query(with_(EVENT_COUNTS, "SELECT * FROM counts"))
def running_key_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every batch writes its own keys, runs are merged as the log grows."""
    folder = f"{ensure_checkpoint_dir(spark)}/keys-{uuid.uuid4().hex}"
    events = stream(spark, sf, "events").select(F.col("user_id").alias("key"), position("event_type", EVENT_TYPES).alias("label"))
    log, query = running.running_key_label_counts(events, "key", "label", C, f"{folder}/log", f"{folder}/state")
    query.awaitTermination()
    return log.table()


@query("SELECT DISTINCT lang, md5(text) AS digest FROM documents")
def stream_dedup_for_a_day(spark: SparkSession, sf: str) -> DataFrame:
    """State of a group ends a day after its first arrival."""
    first = incremental.stream_dedup(stream(spark, sf, "documents"), ["lang", "text"], horizon="1 day")
    return drained(spark, sf, "documents", first.select("lang", F.md5("text").alias("digest")), "append")


@query(with_([MESSAGES,
              f"sums AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, {SUMS} FROM messages GROUP BY day)",
              "closed AS (SELECT * FROM sums WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM messages))"], f"""
SELECT date_diff('day', TIMESTAMP '2024-01-01', day)::INTEGER AS round, * EXCLUDE (day), {per('down')}, {per('up')},
       (sum(downlink_bytes) OVER (ORDER BY day))::BIGINT AS cum_downlink_bytes,
       (sum(uplink_bytes) OVER (ORDER BY day))::BIGINT AS cum_uplink_bytes,
       (sum(downlink_bytes + uplink_bytes) OVER (ORDER BY day))::BIGINT AS cum_total_bytes FROM closed"""))
def stream_round_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows that the watermark has closed, with running totals added in batch."""
    sent = stream(spark, sf, "events", "ts").select(
        utc("ts").alias("ts"), F.when(F.col("event_type") == "purchase", "up").otherwise("down").alias("direction"),
        F.rint(F.col("value") * 100).cast("long").alias("bytes"),
    )
    days = drained(spark, sf, "events", incremental.stream_round_sums(sent, "ts"), "append")
    first_day = 19723  # 2024-01-01 in days since 1970-01-01
    days = days.withColumn("round", (F.floor(F.unix_seconds("round") / 86400) - first_day).cast("int"))
    return rounded(with_cumulative(days, [], "round"), "downlink_bytes_per_client", "uplink_bytes_per_client")


@query(with_(EVENT_COUNTS, "SELECT * FROM counts"))
def stream_key_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = stream(spark, sf, "events").select(F.col("user_id").alias("key"), position("event_type", EVENT_TYPES).alias("label"))
    return drained(spark, sf, "events", incremental.stream_key_label_counts(events, "key", "label", C), "complete")
