"""Fill-in-the-middle and vector codes against plain versions."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import infilling, vector_codes

MARKS = ("<P>", "<S>", "<M>")


def slow_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, suffix + prefix + middle) if h[3] % 100 < 20 else (n, "psm", a, b - a, prefix + suffix + middle)


def test_infilling_equals_slices_and_comes_back(spark, frame):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab <>PSMü語🤦\n") for _ in range(rng.randrange(40))), "x") for i in range(200)]
    rows += [(500, None, "x"), (501, "", "x"), (502, "a<M>b", "x"), (None, "no id", "x"), (None, "no id", "x"), (7, "again", "x"), (7, "again", "x")]
    rows += [(600 + k, "wört " * 60_000, "x") for k in range(4)]
    moved = infilling.infill(frame(rows, "doc_id long, text string, n string"))
    assert moved.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(str, (tuple(r) for r in moved.collect())))
    assert got == sorted(str((i, *slow_infill(i, t))) for i, t, _ in rows)
    assert {r["form"] for r in moved.collect()} == {"plain", "psm", "spm"}
    back = infilling.restored(moved).collect()
    assert sorted((str(r["doc_id"]), r["restored"]) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)


def test_infilling_of_no_rows(spark):
    moved = infilling.infill(spark.createDataFrame([], "doc_id long, text string"))
    assert moved.count() == 0 and infilling.restored(moved).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a<>PSMé語", max_size=30).filter(lambda t: not any(m in t for m in MARKS)), st.data())
def test_rotations_undo_each_other(text, data):
    a, b = sorted(data.draw(st.integers(0, len(text))) for _ in range(2))
    raw = text.encode()
    for form in ("plain", "psm", "spm"):
        assert infilling.restore(bytes(infilling.permute(raw, form, infilling.cut_points(raw, (a, b)))), form) == raw


def test_long_rotations_swap_in_pieces(monkeypatch):
    monkeypatch.setattr(infilling, "SWAP", 3)
    buffer = bytearray(range(50))
    infilling.rotate(buffer, 5, 17, 48)
    assert buffer == bytes([*range(5), *range(17, 48), *range(5, 17), 48, 49])


def slow_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (vec_id, vector, label) in order of id."""
    kept = [(i, [math.floor(scale * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // parts)
    vectors = [v + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in vectors]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            at = [near(p, x[p])[1] for x in cut]
            for k in range(len(books[p])):
                mine = [x[p] for x, a in zip(cut, at, strict=True) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[near(p, x[p]) for p in range(parts)] for x in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, k), e in zip(kept, error, strict=True):
        by_label[k] = by_label.get(k, 0) + e
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, by_label[lab]) for (i, _, lab), f, e in zip(kept, found, error, strict=True)]
    return out, books


def coded(frame, rows, **options):
    found, book = vector_codes.codes(vector_codes.prepared(frame(rows, "vec_id long, embedding array<float>, label int")), **options)
    return [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.with_label_errors(found).collect()], book


@pytest.mark.parametrize("rounds", [0, 1, 2, 4])
def test_codes_equal_a_plain_version(spark, frame, rounds, monkeypatch):
    monkeypatch.setattr(vector_codes, "OWNER_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 32)], int(rng.integers(3))) for i in range(150)]
    rows += [(200 + i, rows[3][1], None) for i in range(60)]  # an entry that many rows share
    rows += [(300, None, 1), (301, [None] * 32, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] * 32, 1)]
    rows += [(304, [], 1), (305, [1.5] * 7, 2), (306, [-3.25] * 32, None), (306, [-3.25] * 32, None)]
    got, book = coded(frame, rows, rounds=rounds)
    want, books = slow_codes(rows, rounds=rounds)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert book.tolist() == books
    assert vector_codes.digest(book) == hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()


def test_few_vectors_make_few_entries(spark, frame):
    rows = [(1, [0.5] * 16, 1), (2, [0.25] * 16, 1), (3, [0.5] * 16, 2)]
    got, book = coded(frame, rows)
    assert book.shape == (16, 3, 1) and sorted(got) == sorted(slow_codes(rows)[0])
    assert all(error == 0 for _, _, error, _ in got)


def test_null_ids_and_no_vectors(spark, frame):
    got, book = coded(frame, [(None, [1.0] * 16, 1), (4, [0.0] * 16, 1)])
    assert book[:, 0].sum() == 0 and {r[0] for r in got} == {None, 4}
    empty, book = coded(frame, [(1, None, 1)])
    assert empty == [] and book.size == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.codes(vector_codes.prepared(vectors))[0].count() == 0


def test_huge_components_stay_exact(spark, frame):
    rows = [(i, [x] * 16, 0) for i, x in enumerate((1e30, -1e30, 65_000.5, -65_000.5))]
    got, _ = coded(frame, rows, entries=2)
    limit = vector_codes.LIMIT / 256
    assert sorted(got) == sorted(slow_codes([(i, [min(limit, max(-limit, x)) for x in v], k) for i, v, k in rows], entries=2)[0])


def test_only_movers_are_written_again(spark, frame):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 16)], 0) for i in range(300)]
    vectors = vector_codes.prepared(frame(rows, "vec_id long, embedding array<float>, label int"))
    written = []
    settle = vector_codes.Members.settle

    def counted(self, moved, book):
        settle(self, moved, book)
        written.append(self.tables[-1].count())

    vector_codes.Members.settle = counted
    try:
        vector_codes.codes(vectors, rounds=3)
    finally:
        vector_codes.Members.settle = settle
    assert written[0] == 300 * 16 and 0 < written[1] < written[0] // 2 and written[2] <= written[1]
    assert vectors.where(F.col("row").isNull()).count() == 0
