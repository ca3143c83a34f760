from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions.hashing import derive_seed, derive_seed_column
from keyloom.functions.ordering import hash_rank, mid_ranks, ordered, percentiles, running, sorted_codes
from keyloom.session import cut_lineage, ensure_checkpoint_dir

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def brute_rank(rows, seed):
    """Rank of every (group, id) in hash order, in plain Python."""
    out = {}
    for group in {g for g, _ in rows}:
        ids = [i for g, i in rows if g == group]
        ids.sort(key=lambda i: (hashlib.md5(f"{seed}|{i}".encode()).hexdigest(), i))
        out.update({(group, i): (place + 1, len(ids)) for place, i in enumerate(ids)})
    return out


@pytest.mark.parametrize("rows_per_range", [3, 10, 10**6])
@pytest.mark.parametrize("parts", [1, 16])
def test_hash_rank_is_the_same_however_groups_are_split(frame, rows_per_range, parts):
    rows = [("hot" if i % 3 else f"g{i % 7}", i) for i in range(300)] + [(None, i) for i in range(300, 340)]
    df = frame(rows, "g string, id long", parts)
    ranked = hash_rank(df, ["g"], ["id"], 5, rows_per_range=rows_per_range).collect()
    assert {(r.g, r.id): (r["rank"], r["size"]) for r in ranked} == brute_rank(rows, 5)


def test_hash_rank_of_the_whole_table(frame):
    rows = [(0, i) for i in range(5000)]
    ranked = hash_rank(frame([(i,) for _, i in rows], "id long"), [], ["id"], 9).collect()
    assert {(0, r.id): (r["rank"], r["size"]) for r in ranked} == brute_rank(rows, 9)


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.floats(-5, 5).map(lambda x: round(x, 1))), min_size=1, max_size=60))
def test_percentiles_and_mid_ranks_match_numpy(spark, values):
    df = spark.createDataFrame(values, "g string, v double").repartition(4)
    got = {r.g: (r.a, r.b, r.c) for r in percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    for group in {g for g, _ in values}:
        own = [v for g, v in values if g == group]
        assert np.allclose(got[group], np.percentile(own, [10, 50, 99]))
    ranks = mid_ranks(df, ["g"], {"v": "r"}).collect()
    for row in ranks:
        own = np.array([v for g, v in values if g == row.g])
        assert row.r == (own < row.v).sum() + ((own == row.v).sum() + 1) / 2


def test_running_totals_cross_block_borders(spark):
    rows = [(i % 2, float((i * 37) % 101), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, v double, id int")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keep eight sort partitions
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        placed = ordered(df, ["g"], ["v", "id"])
        assert placed.select("__block").distinct().count() > 4
        up = running(placed, ["g"], "rank", F.col("v"), "sum", "total")
        both = running(up, ["g"], "rank", F.col("v") % 10, "min", "least", backward=True).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    for g in (0, 1):
        own = sorted((v, i) for k, v, i in rows if k == g)
        mine = sorted([r for r in both if r.g == g], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(own) + 1))
        assert [(r.v, r.id) for r in mine] == own
        assert np.allclose([r.total for r in mine], np.cumsum([v for v, _ in own]))
        ones = np.array([v % 10 for v, _ in own])
        assert np.allclose([r.least for r in mine], np.minimum.accumulate(ones[::-1])[::-1])


def test_sorted_codes_follow_byte_order(frame):
    keys = ["b", "a", "B", "é", "z", "a"]
    codes = {r.k: r.code for r in sorted_codes(frame([(k,) for k in keys], "k string"), "k").collect()}
    assert codes == {k: i for i, k in enumerate(sorted(set(keys)))}


def test_derived_seeds_agree_in_python_and_spark(frame):
    rows = frame([(i, f"x{i}") for i in range(20)], "i int, s string")
    for row in rows.select("i", "s", derive_seed_column(F.lit("batch"), "i", "s").alias("seed")).collect():
        assert row.seed == derive_seed("batch", row.i, row.s)


def test_lineage_is_cut_in_the_session_folder(spark, frame):
    folder = ensure_checkpoint_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or named.rstrip("/") in folder
    assert cut_lineage(frame([(1,)], "a int")).count() == 1
