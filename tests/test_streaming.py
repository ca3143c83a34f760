"""Streams over files that arrive in several batches equal the batch operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from keyloom.operators import terms
from keyloom.operators.cleaning import classify_record
from keyloom.operators.keys import key_label_counts
from keyloom.sources.reviews import parse_lines, read_review_lines
from keyloom.streaming import incremental


@pytest.fixture
def folder(tmp_path):
    source = tmp_path / "lines"
    source.mkdir()
    for part in range(3):
        lines = [json.dumps({"rating": float(i % 6), "title": "", "text": f"word{i % 4} common", "user_id": f"u{i % 5}", "parent_asin": "p"})
                 for i in range(part, 30 + part)]
        (source / f"{part}.jsonl").write_text("\n".join([*lines, "{broken"]) + "\n")
    return str(source)


def one_file_at_a_time(spark, folder):
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    return lines.select(F.col("_metadata.file_path").alias("seq"), "value")


def test_cleaning_report(spark, folder):
    got = incremental.drain(incremental.stream_cleaning_report(one_file_at_a_time(spark, folder)), "complete")
    batch = classify_record(parse_lines(read_review_lines(spark, folder))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_dedup_keeps_one_of_each(spark, folder):
    clean = incremental.stream_clean(one_file_at_a_time(spark, folder))
    columns = ["user_id", "parent_asin", "body"]
    got = incremental.drain(incremental.stream_dedup(clean, columns), "append").select(*columns)
    batch = classify_record(parse_lines(read_review_lines(spark, folder))).where("status = 'ok'").select(*columns).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_term_statistics_both_ways(spark, folder, tmp_path):
    texts = one_file_at_a_time(spark, folder).select(F.col("value").alias("text"))
    batch = sorted(map(tuple, terms.term_statistics(spark.read.text(folder).withColumnRenamed("value", "text"), "text").collect()))
    running = incremental.drain(incremental.stream_term_statistics(texts, "text"), "complete")
    assert sorted(map(tuple, running.collect())) == batch
    incremental.append_term_statistics(texts, "text", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    parts = spark.read.parquet(str(tmp_path / "t"))
    assert parts.select("batch").distinct().count() == 3
    assert sorted(map(tuple, terms.merge_term_statistics(parts).collect())) == batch


def test_key_label_counts(spark, folder):
    records = incremental.stream_clean(one_file_at_a_time(spark, folder))
    got = incremental.drain(incremental.stream_key_label_counts(records, "user_id", "label", 5), "complete")
    lines = classify_record(parse_lines(read_review_lines(spark, folder))).where("status = 'ok'")
    batch = key_label_counts(lines.withColumn("label", F.col("rating").cast("int") - 1), "user_id", "label", 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_an_empty_source_gives_an_empty_table(spark, tmp_path):
    assert incremental.drain(incremental.stream_clean(incremental.stream_lines(spark, str(tmp_path))), "append").count() == 0


@pytest.mark.parametrize("parts", [1, 6])
def test_given_tables_stream_whole_in_several_batches(spark, tmp_path, monkeypatch, parts):
    """A folder of part files, or one file; days in order although files are not."""
    from keyloom.catalog import streams

    events = spark.range(400).selectExpr(
        "id % 7 as user_id", "if(id % 3 = 0, 'purchase', 'view') as event_type", "cast(id as double) as value",
        "cast(timestamp'2024-01-01' + make_dt_interval(0, cast((id * 37) % 400 as int)) as timestamp_ntz) as ts",
    )
    events.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    batches = []
    monkeypatch.setattr(incremental, "drain", lambda df, mode, some=False, drain=incremental.drain: drain(df, mode, lambda b: batches.append(b) or b, some=some))
    counts = streams.stream_key_label_counts(spark, str(tmp_path))
    assert counts.count() > 0 and len(batches) > 1
    days = streams.stream_round_ledger(spark, str(tmp_path)).agg(F.count("*"), F.max("cum_total_bytes")).first()
    closed = events.where("ts < date_trunc('day', timestamp_ntz'2024-01-17 15:00:00' - interval 1 day)")
    want = closed.agg(F.count_distinct(F.to_date("ts")), F.sum(F.col("value") * 100).cast("long")).first()
    assert tuple(days) == tuple(want)
