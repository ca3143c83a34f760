from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions.text import tokens
from keyloom.operators.cleaning import classify_record, clean_reviews, cleaning_report
from keyloom.sources import labelled
from keyloom.sources.reviews import parse_lines, read_review_lines, source_fingerprint
from keyloom.sources.sinks import printable, table_fingerprint, union_rows, write_bucketed_once, write_once, write_table


def review(**changes):
    base = {"rating": 4.0, "title": "a title", "text": "a body", "parent_asin": "P1", "user_id": "U1", "timestamp": 1}
    return json.dumps({**base, **changes}, ensure_ascii=False)


LINES = [
    (review(), "ok"),
    (review(text="  a body\n"), "duplicate"),
    (review(title="another"), "duplicate"),
    (review(user_id="U2"), "ok"),
    (review(rating=0.0, text="b"), "bad_rating"),
    (review(rating=4.5, text="b"), "bad_rating"),
    (review(rating="5", text="b"), "bad_rating"),
    (review(rating=None, text="b"), "bad_rating"),
    (review(rating=True, text="one star"), "ok"),
    (review(rating=5, text="integer"), "ok"),
    (review(user_id="", text="b"), "missing_id"),
    (review(parent_asin=None, text="b"), "missing_id"),
    (review(text="    \t\n"), "empty_text"),
    (review(text=None), "empty_text"),
    ("{not json", "bad_json"),
    ("", "bad_json"),
    ("[1, 2]", "bad_json"),
    (review(text="no title", title="  "), "ok"),
]


@pytest.fixture
def path(tmp_path):
    for number, part in enumerate((LINES[:7], LINES[7:])):
        (tmp_path / f"part{number}.jsonl").write_text("\n".join(line for line, _ in part) + "\n", encoding="utf-8")
    return str(tmp_path)


def test_every_rule_is_counted_once(spark, path):
    parsed = parse_lines(read_review_lines(spark, path))
    report = cleaning_report(classify_record(parsed)).first()
    for status in ("bad_json", "bad_rating", "missing_id", "empty_text", "duplicate"):
        assert report[status] == sum(s == status for _, s in LINES), status
    assert report.lines == len(LINES) and report.kept == sum(s == "ok" for _, s in LINES)
    assert (report.n_0, report.n_3, report.n_4) == (1, 3, 1)


def test_first_of_the_duplicates_is_kept_and_text_is_composed(spark, path):
    rows = clean_reviews(parse_lines(read_review_lines(spark, path))).orderBy("seq").collect()
    assert [(r.user_id, r.label, r.text) for r in rows] == [
        ("U1", 3, "a title\na body"), ("U2", 3, "a title\na body"), ("U1", 0, "a title\none star"), ("U1", 4, "a title\ninteger"),
        ("U1", 3, "no title"),
    ]


def test_head_follows_file_order(spark, path):
    head = read_review_lines(spark, path, 9).collect()
    assert [r.value for r in head] == [line for line, _ in LINES[:9]]


def test_positions_follow_the_file_over_many_splits(spark, tmp_path):
    lines = [f"{i:06d} {'x' * (i % 50)}" for i in range(5000)]
    (tmp_path / "big.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = read_review_lines(spark, str(tmp_path / "big.txt"))
        assert read.rdd.getNumPartitions() > 5
        assert [r.value for r in read.orderBy("seq").collect()] == lines
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")


def test_fingerprints_see_content_not_layout(spark, frame, path):
    rows = [(i, f"v{i % 5}", None if i % 7 else i) for i in range(50)]
    mark = lambda data, parts: table_fingerprint(frame(data, "a int, b string, c int", parts)).first().fingerprint
    assert mark(rows, 1) == mark(rows[::-1], 9)
    assert mark(rows, 1) != mark(rows + rows[:1], 1)
    assert mark(rows, 1) != mark([(0, "v0", None), *rows[1:]], 1)
    assert source_fingerprint(spark, path).first().rows == len(LINES)


def test_write_once_reuses_and_sets_incomplete_output_aside(frame, tmp_path):
    path = str(tmp_path / "table")
    assert write_once(frame([(1,)], "a int"), path).collect()[0].a == 1
    assert write_once(frame([(2,)], "a int"), path).collect()[0].a == 1
    (tmp_path / "table" / "_SUCCESS").unlink()
    assert write_once(frame([(3,)], "a int"), path).collect()[0].a == 3
    assert len(list(tmp_path.glob("table.incomplete-*"))) == 1
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_table(frame([(4,)], "a int"), path)


def test_bucketed_tables_join_without_a_shuffle(spark, frame):
    import uuid

    names = [f"b_{uuid.uuid4().hex}" for _ in range(2)]
    rows = frame([(i % 20, i) for i in range(200)], "k int, v int")
    a, b = (write_bucketed_once(rows, name, "k", 4) for name in names)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE {name}")
    assert "Exchange" not in plan


def test_cells_are_printed_like_python(frame):
    values = [0.1 + 0.2, 1e-7, 123456789.123, 1 / 3, -2.5, 0.0, 1e20, float("nan"), 8086413.85]
    rows = printable(frame([(i, v, i % 2 == 0, [1, 2]) for i, v in enumerate(values)], "i int, v double, b boolean, n array<int>"))
    got = {r.i: r for r in rows.collect()}
    for i, v in enumerate(values):
        assert got[i].v == (None if v != v else f"{v:.8g}")
        assert got[i].b == int(i % 2 == 0) and got[i].n == "[1,2]"


def test_csv_has_the_union_of_the_columns(spark, frame, tmp_path):
    rows = union_rows([frame([(1, 0.5)], "a int, b double"), frame([(2, True)], "a int, c boolean")])
    write_table(rows, str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("a").collect()
    assert [tuple(r) for r in back] == [("1", "0.5", None), ("2", None, "1")]


def test_labelled_splits(spark, frame, tmp_path):
    for name, n in (("train", 6), ("test", 3)):
        frame([(f"t{i}", i % 3 + 1) for i in range(n)], "body string, stars int").write.parquet(str(tmp_path / name))
    loaded = labelled.load_labelled_text(spark, {n: str(tmp_path / n) for n in ("train", "test")}, "body", "stars", offset=1)
    counts = {(r.split, r.label): r.n for r in labelled.split_class_counts(loaded).collect()}
    assert counts == {("train", c): 2 for c in range(3)} | {("test", c): 1 for c in range(3)}
    with pytest.raises(ValueError):
        labelled.load_labelled_text(spark, {}, "a", "b")


def test_tokens_equal_the_public_word_pattern(frame):
    import re

    texts = ["Été der_x a Über 42 don't", "", "x", "Ünïcödé—dash ½ ² naïve_2", "日本語 テキスト", "a-b cd ef"]
    got = frame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    for row in got:
        assert row.w == re.findall(r"(?u)\b\w\w+\b", row.t.lower())
    assert np.all([isinstance(r.w, list) for r in got])
