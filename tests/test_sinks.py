"""Hash trees, file digests and bucketed tables."""

from __future__ import annotations

import gzip
import hashlib
import uuid

from keyloom.sources import sinks


def test_a_changed_row_is_found_in_its_buckets(frame):
    rows = [(i, f"t{i % 50}") for i in range(2000)]
    schema = "id long, text string"
    before = sinks.bucket_digests(frame(rows, schema), digits=2)
    assert sinks.changed_buckets(before, sinks.bucket_digests(frame(rows[::-1], schema, 9), digits=2)).count() == 0
    changed = [*rows[:7], (7, "other"), *rows[8:], (9999, None)]
    digest = lambda r: hashlib.md5("".join("n" if c is None else f"{len(str(c))}:{c}" for c in r).encode()).hexdigest()[:2]
    found = {r.bucket: r.rows_after - r.rows_before for r in sinks.changed_buckets(before, sinks.bucket_digests(frame(changed, schema), digits=2)).collect()}
    want = {}
    for row, n in ((rows[7], -1), ((7, "other"), 1), ((9999, None), 1)):
        want[digest(row)] = want.get(digest(row), 0) + n
    assert found == want
    roots = [sinks.root_digest(b).first() for b in (before, sinks.bucket_digests(frame(rows[::-1], schema)), sinks.bucket_digests(frame(changed, schema)))]
    assert roots[0] == roots[1] and roots[0].fingerprint != roots[2].fingerprint and roots[2].rows == 2001
    assert sinks.root_digest(sinks.bucket_digests(frame([], schema))).first().rows == 0


def test_files_are_hashed_byte_by_byte(spark, tmp_path):
    (tmp_path / "a").mkdir()
    files = {"a/x.bin": bytes(range(256)) * 10, "a/empty.bin": b"", "y.bin": "ü\r\n".encode()}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "z.txt").write_text("no")
    got = {r.file.split(f"{tmp_path.name}/")[1]: (r.bytes, r.sha256) for r in sinks.file_digests(spark, str(tmp_path), "*.bin").collect()}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items() if data}


def test_large_files_are_hashed_without_being_held(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "WHOLE_BYTES", 1000, raising=False)
    text = "".join(f"{i} {'ü' * (i % 40)}\r\n" for i in range(900)).encode()
    files = {
        "lines.txt": text, "no end.txt": text[:-1], "a/marked.txt": b"\xef\xbb\xbf" + text, "a/marked no end.txt": b"\xef\xbb\xbf" + text[:-2],
        "bytes.bin": bytes(range(256)) * 200, "empty lines.bin": b"\n" * 30_000, "one line.bin": b"x" * 30_000, "not unpacked.gz": gzip.compress(text), "no archive.gz": text,
        "part-00000": text, "a/part-00000": text[:-1], "state": b"\xef\xbb\xbf" + text, "small.txt": b"\xef\xbb\xbf", "small.gz": gzip.compress(b"small"), "empty.txt": b"",
    }
    (tmp_path / "a").mkdir()
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    conf = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "5000", "spark.sql.execution.arrow.maxRecordsPerBatch": "70"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        rows = sinks.file_digests(spark, str(tmp_path)).collect()
        chosen = sinks.file_digests(spark, str(tmp_path), "*.txt").collect()
    finally:
        for key in conf:
            spark.conf.unset(key)
    got = {r.file.split(f"{tmp_path.name}/")[1]: (r.bytes, r.sha256) for r in rows}
    assert len(rows) == len(got) and got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items() if data}
    assert sorted(chosen) == sorted(r for r in rows if r.file.endswith(".txt"))


def test_bucketed_tables_join_without_an_exchange(spark, frame, tmp_path):
    mark = uuid.uuid4().hex
    left = sinks.write_bucketed_once(frame([(i % 20, i) for i in range(200)], "key long, a long"), f"left_{mark}", "key", 4, f"{tmp_path}/left")
    right = sinks.write_bucketed_once(frame([(i, str(i)) for i in range(25)], "key long, b string"), f"right_{mark}", "key", 4, f"{tmp_path}/right")
    joined = left.hint("merge").join(right, "key").groupBy("key").count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert {r["key"]: r["count"] for r in joined.collect()} == {i: 10 for i in range(20)}
    assert sinks.write_bucketed_once(frame([], "key long, a long"), f"left_{mark}", "key", 4).count() == 200
