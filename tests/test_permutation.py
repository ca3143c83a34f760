from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from keyloom.functions import permutation
from keyloom.functions.permutation import permuted


def test_every_size_gives_a_permutation(spark):
    sizes = [*range(1, 40), 50, 64, 97, 100, 101, 1000]
    rows = spark.createDataFrame([(n, i) for n in sizes for i in range(n)], "n long, i long")
    drawn = rows.select("n", "i", *[permuted(F.col("i"), F.col("n"), F.lit("seed"), F.lit(k)).alias(f"p{k}") for k in range(2)]).collect()
    for n in sizes:
        for k in range(2):
            assert sorted(r[f"p{k}"] for r in drawn if r.n == n) == list(range(n))
    large = [r for r in drawn if r.n == 1000]
    assert sum(r.p0 == r.p1 for r in large) < 20 and sum(r.p0 == r.i for r in large) < 20
    # no order is left: neighbours are as far from each other as any two positions
    place = {r.i: r.p0 for r in large}
    assert 250 < sum(abs(place[i] - place[i + 1]) for i in range(999)) / 999 < 420


def test_a_position_that_stays_outside_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(permutation, "MOST_WALKS", 1)
    rows = spark.range(5).select("id", permuted(F.col("id"), F.lit(5).cast("long"), F.lit("x")).alias("p"))
    try:
        assert sorted(r.p for r in rows.collect()) == list(range(5))
    except Exception as error:
        assert "did not come back" in str(error)


@pytest.mark.parametrize("size", [(1 << 40) + 12_345])
def test_large_ranges(spark, size):
    rows = spark.range(200).select(permuted(F.col("id"), F.lit(size), F.lit("x")).alias("p")).collect()
    assert len({r.p for r in rows}) == 200 and all(0 <= r.p < size for r in rows)
    assert max(r.p for r in rows) > size // 2
