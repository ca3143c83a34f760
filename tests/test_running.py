"""Logs of runs: replay, merging, restarts; state that ends; the first records of files."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyloom.operators import terms
from keyloom.sources.reviews import head_records, read_review_lines
from keyloom.streaming import incremental, running
from keyloom.streaming.running import RunLog


def batches(n):
    return [[(f"k{(i * k) % 7}", i, 1) for k in range(3)] for i in range(n)]


def total(rows):
    out = {}
    for key, a, b in rows:
        x = out.setdefault(key, [0, 0])
        x[0] += a
        x[1] += b
    return {k: tuple(v) for k, v in out.items()}


def stored(log):
    return {r["key"]: (r["a"], r["b"]) for r in log.table().collect()}


def test_runs_are_merged_and_replays_change_nothing(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), ["key"], ["a", "b"], fan=3)
    assert log.table() is None
    frames = [spark.createDataFrame(rows, "key string, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")) for rows in batches(11)]
    for n, frame in enumerate(frames):
        log.add(frame, n)
    assert log.runs() == [(2, 0), (0, 9), (0, 10)]
    want = total(r for rows in batches(11) for r in rows)
    assert stored(log) == want
    log.add(frames[3].withColumn("a", F.col("a") + 1000), 3)  # a replay is not even computed
    assert stored(log) == want
    assert spark.read.parquet(log._path(0, 10)).count() == len(total(batches(11)[10]))  # a batch writes its own keys
    gone = log.vacuum()
    assert len(gone) == 9 + 3 and stored(log) == want and log.vacuum() == []
    log.add(frames[3], 3)  # a replay of a batch that is merged, and whose own run is gone
    assert stored(log) == want and log.runs() == [(2, 0), (0, 9), (0, 10)]
    again = RunLog(spark, str(tmp_path / "log"), ["key"], ["a", "b"], fan=3)
    again.add(frames[0], 11)
    assert again.runs() == [(2, 0), (1, 3)]
    with pytest.raises(RuntimeError, match="not all there"):
        RunLog(spark, str(tmp_path / "other"), ["key"], ["a", "b"], fan=3).add(frames[0], 5)


def test_a_batch_without_a_manifest_is_written_again(spark, tmp_path):
    log = RunLog(spark, str(tmp_path / "log"), ["key"], ["a", "b"])
    frame = spark.createDataFrame([("x", 1, 1)], "key string, a long, b long")
    frame.withColumn("a", F.lit(7).cast("long")).write.parquet(log._path(0, 0))  # its task was lost before the manifest
    log.add(frame, 0)
    assert stored(log) == {"x": (1, 1)}


def test_ten_batches_and_a_restart(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    texts = [f"word{i % 3} common word{i % 4}" for i in range(10)]
    for i, text in enumerate(texts[:6]):
        (folder / f"{i}.txt").write_text(text)

    def run():
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)).withColumnRenamed("value", "text")
        log, query = running.running_term_statistics(stream, "text", str(tmp_path / "log"), str(tmp_path / "state"))
        query.awaitTermination()
        return log

    run()
    for i, text in enumerate(texts[6:]):
        (folder / f"later{i}.txt").write_text(text)
    log = run()
    assert len([1 for level, _ in log.runs() if level == 0]) == 2 and log.complete(0, 9)
    batch = terms.term_statistics(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    assert Counter(map(tuple, log.table().select("term", "tf", "df").collect())) == Counter(map(tuple, batch.collect()))


def test_state_of_duplicates_ends_after_the_horizon(spark, tmp_path):
    folder = tmp_path / "rows"
    folder.mkdir()
    state = []

    def arrive(name, values):
        (folder / f"{name}.txt").write_text("\n".join(values))
        stream = incremental.stream_dedup(spark.readStream.text(str(folder)), ["value"], horizon="1 second")
        out = str(tmp_path / "out")
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out)
        query.awaitTermination()
        state.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]))
        return Counter(r["value"] for r in spark.read.parquet(out).collect())

    assert arrive("a", ["x", "x", "y"]) == Counter("xy")
    assert arrive("b", ["x", "z"]) in (Counter("xyz"), Counter("xxyz"))  # a restart; x is known unless a second has passed
    for n in range(8):
        time.sleep(1.2)
        seen = arrive(f"c{n}", [f"v{n}", f"v{n}"])
    assert all(seen[f"v{n}"] == 1 for n in range(8))
    assert max(state[-4:]) <= 4  # rows of earlier batches have left


@pytest.mark.parametrize("n", [0, 1, 7, 25, 1000])
def test_first_lines_of_files(spark, tmp_path, n):
    folder = tmp_path / "lines"
    folder.mkdir()
    lines = []
    for part in range(4):
        mine = [f"{part}-{i}" for i in range(part * 5)]
        (folder / f"{part}.jsonl").write_text("\n".join(mine))
        lines += mine
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30b")
    try:
        got = [r["value"] for r in read_review_lines(spark, str(folder), n).collect()]
        plan = read_review_lines(spark, str(folder), n)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert Counter(got) == Counter(lines[:n])
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_first_records_by_a_column(frame, kind):
    rows = frame([(i * 37 % 101,) for i in range(101)], "seq long").withColumn("seq", F.lpad(F.col("seq").cast("string"), 3, "0") if kind == "string" else F.col("seq").cast(kind))
    for n in (0, 1, 10, 101, 500):
        assert sorted(int(r["seq"]) for r in head_records(rows, n).collect()) == list(range(min(n, 101)))
