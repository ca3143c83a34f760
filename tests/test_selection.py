"""Quotas in hash order against plain sorting, at every depth of cells, and the plan that gives them."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from keyloom.functions import selection
from keyloom.functions.selection import first_by_hash

ROWS = [("hot" if i % 4 else f"g{i % 9}", i) for i in range(600)] + [(None, i) for i in range(600, 640)]


def slow_first(rows, seed, quota):
    out = set()
    for group in {g for g, _ in rows}:
        ids = sorted((i for g, i in rows if g == group), key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())
        out |= set(ids[: max(0, quota(len(ids)))])
    return out


def quotas(sizes):
    return sizes.withColumns({"few": F.lit(3), "half": F.floor(F.col("__n") / 2), "all": F.col("__n") + 5, "none": F.lit(-1)})


@pytest.mark.parametrize("cell_rows, most_groups", [(1000, None), (5, None), (1, None), (1000, 0)])
def test_quotas_equal_sorting(frame, monkeypatch, cell_rows, most_groups):
    monkeypatch.setattr(selection, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(selection, "DIGITS", 1)
    df = frame([(*r, "kept") for r in ROWS], "g string, id long, extra string")
    got = first_by_hash(df, ["g"], "id", 5, ["few", "half", "all", "none"], quotas, most_groups=most_groups)
    assert got.columns == ["g", "id", "extra", "few", "half", "all", "none"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for name, quota in (("few", lambda n: 3), ("half", lambda n: n // 2), ("all", lambda n: n), ("none", lambda n: 0)):
        assert {r.id for r in rows if r[name]} == slow_first(ROWS, 5, quota)


def test_rows_are_not_exchanged(spark):
    chosen = first_by_hash(spark.createDataFrame(ROWS, "g string, id long"), ["g"], "id", 5, ["few"], lambda s: s.withColumn("few", F.lit(3)))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, id long")
    assert first_by_hash(empty, ["g"], "id", 1, ["few"], lambda s: s.withColumn("few", F.lit(3))).count() == 0
