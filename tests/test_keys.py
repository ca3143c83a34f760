from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.operators import assign, keys, sampling
from keyloom.plans.profile import profile_keys, save_profile

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
PROFILE = [(0, c) for c in (4, 4, 4, 4, 3, 4)] + [(1, c) for c in (0, 0, 1)] + [(2, 2)]


def keyed(frame, sizes, parts=3):
    rows = [(f"k{k:03d}", k * 1000 + i, (k + i) % 5) for k, n in enumerate(sizes) for i in range(n)]
    return frame(rows, "key string, row long, label int", parts)


def test_profile_hand_values(frame, tmp_path):
    tables = profile_keys(frame(PROFILE, "key int, label int"), "key", "label", 5, (1, 3, 5))
    summary = tables["summary"].first()
    assert (summary.records, summary["keys"], summary.single_class_keys) == (10, 3, 1)
    spread = {r.metric: r for r in tables["distributions"].collect()}
    assert (spread["size"].min, spread["size"].p50, spread["size"].max) == (1, 3, 6)
    assert spread["majority_share"].p50 == pytest.approx(5 / 6)
    assert spread["mean_label"].p25 == pytest.approx(np.percentile([23 / 6, 1 / 3, 2], 25))
    kept = {r.min_size: (r.keys_retained, r.records_retained) for r in tables["retention"].collect()}
    assert kept == {1: (3, 10), 3: (2, 9), 5: (1, 6)}
    saved = save_profile(tables, str(tmp_path / "profile"))
    assert saved["per_key"].count() == 3
    assert {r.label: r.n for r in saved["classes"].collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 5}


def test_filter_hand_values(frame):
    df = keyed(frame, [2, 5, 8, 20, 30, 40])
    assert keys.filter_keys_min(df, "key", 8).count() == 98
    kept = keys.filter_keys(df, "key", "row", 8, cap=25, seed=1)
    assert sorted(r["count"] for r in kept.groupBy("key").count().collect()) == [8, 20, 25, 25]
    report = keys.filter_report(df, "key", 8, cap=25).first()
    assert (report.raw_keys, report.raw_records, report.keys_retained, report.records_retained, report.keys_capped) == (6, 105, 4, 78, 2)
    assert keys.filter_keys(df, "key", "row", 8, max_keys=2, seed=1).select("key").distinct().count() == 2
    with pytest.raises(ValueError):
        keys.filter_keys(df, "key", "row", None)


def test_split_holds_out_whole_keys(frame):
    df = keyed(frame, [15] * 20)
    split = keys.split_keys(df, "key", 0.2, 3)
    assert split.where("unseen").count() == 4
    roles = keys.roles_within_keys(df, "key", "row", split, (0.8, 0.1, 0.1), 4)
    assert roles.where(F.col("role") == keys.UNSEEN).count() == 60
    overlap = keys.assert_no_key_overlap(roles, "key").first()
    assert (overlap.seen_keys, overlap.unseen_keys, overlap.overlap) == (16, 4, 0)
    broken = roles.withColumn("role", F.when(F.col("row") == 0, 3 - F.col("role")).otherwise(F.col("role")))
    broken = broken.withColumn("role", F.when(F.col("row") == 1, F.lit(3)).when(F.col("row") == 0, F.lit(0)).otherwise(F.col("role")))
    with pytest.raises(Exception, match="both sides"):
        keys.assert_no_key_overlap(broken, "key").collect()
    for fraction in (0.001, 0.999):
        with pytest.raises(Exception, match="would be empty"):
            keys.split_keys(df, "key", fraction, 3).collect()
    with pytest.raises(ValueError):
        keys.split_keys(df, "key", 1.0, 3)


def test_roles_of_every_key_size(frame):
    sizes = list(range(1, 40))
    df = keyed(frame, sizes)
    split = df.select("key").distinct().withColumn("unseen", F.lit(False))
    results = []
    for options in ({}, {"rows_per_range": 4}):
        roles = keys.roles_within_keys(df, "key", "row", split, (0.8, 0.1, 0.1), 4, **options)
        results.append({(r.key, r.row): r.role for r in roles.collect()})
        counts = roles.groupBy("key").pivot("role", [0, 1, 2]).count().na.fill(0).collect()
        for r in counts:
            n = sizes[int(r.key[1:])]
            n_test = max(1, round(0.1 * n)) if n >= 2 else 0
            n_val = round(0.1 * n) if n - n_test >= 2 else 0
            assert (r["0"], r["1"], r["2"]) == (n - n_test - n_val, n_val, n_test)
    assert results[0] == results[1]


@SLOW
@given(st.lists(st.integers(1, 30), min_size=2, max_size=12), st.integers(0, 100))
def test_cap_and_samples(spark, sizes, seed):
    rows = [(k, k * 1000 + i, i % 3) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "key int, row long, label int").repartition(4)
    capped = {r.key: r.n for r in keys.cap_per_key(df, "key", "row", 7, seed).groupBy("key").agg(F.count("row").alias("n")).collect()}
    assert capped == {k: min(n, 7) for k, n in enumerate(sizes)}
    subset = sampling.stratified_subset(df, "label", "row", len(rows) // 2, seed)
    assert subset.count() == len(rows) // 2 == subset.select("row").distinct().count()


def test_stratified_roles_and_errors(frame):
    df = keyed(frame, [50, 50])
    roles = sampling.assign_roles_stratified(df, "label", "row", (0.8, 0.1, 0.1), 1)
    assert {(r.label, r.role): r["count"] for r in roles.groupBy("label", "role").count().collect()} == {
        (c, role): n for c in range(5) for role, n in ((0, 16), (1, 2), (2, 2))
    }
    with pytest.raises(ValueError):
        sampling.assign_roles_stratified(df, "label", "row", (0.8, 0.1, 0.2), 1)


def test_noise_changes_the_right_rows(frame):
    df = keyed(frame, [100, 100])
    noisy = sampling.flip_labels(df, "row", "label", F.col("key") == "k000", 0.25, 5, 3).withColumnRenamed("label", "noisy")
    joined = noisy.join(df.select("row", "label"), "row").collect()
    assert sum(r.flipped for r in joined) == 25
    assert all((r.noisy != r.label) == r.flipped and 0 <= r.noisy < 5 for r in joined)
    assert not any(r.flipped for r in joined if r.key == "k001")


def test_keys_per_round(frame):
    ks = frame([(i,) for i in range(10)], "key int")
    drawn = sampling.sample_keys_per_round(ks, "key", 0.25, 1, 3, 4).collect()
    per_round = {n: {r.key for r in drawn if r.round == n} for n in range(1, 5)}
    assert all(len(s) == 2 for s in per_round.values()) and len(set(map(frozenset, per_round.values()))) > 1
    assert sampling.sample_keys_per_round(ks, "key", 0.01, 3, 3, 1).count() == 3
    assert sampling.sample_keys_per_round(ks, "key", 0.5, 30, 3, 1).count() == 10


# ---- assignments

def two_classes(frame, n=4000):
    return frame([(i, i % 2) for i in range(n)], "row long, label int")


def sizes_of(assigned):
    return sorted(r["count"] for r in assigned.groupBy("client").count().collect())


def test_iid_sizes_and_cover(frame):
    assigned = assign.iid_assign(two_classes(frame, 1003), "row", 10, 1)
    assert sizes_of(assigned) == [100] * 7 + [101] * 3
    assert assigned.select("row").distinct().count() == 1003


def skew(df, assigned):
    shares = df.join(assigned, "row").groupBy("client").agg(F.avg("label").alias("s")).collect()
    return float(np.mean([abs(r.s - 0.5) for r in shares]))


def test_dirichlet_covers_all_rows_and_skews_with_alpha(frame):
    df = two_classes(frame)
    skews = []
    for alpha in (0.1, 1.0, 100.0):
        assigned, draws = assign.dirichlet_assign(df, "row", "label", 5, alpha, 2, min_size=10)
        assert assigned.count() == 4000 == assigned.select("row").distinct().count()
        assert min(sizes_of(assigned)) >= 10 and draws >= 1
        skews.append(skew(df, assigned))
    assert skews[0] > skews[1] > skews[2]
    again, _ = assign.dirichlet_assign(df.repartition(9), "row", "label", 5, 100.0, 2, min_size=10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, assigned.collect()))
    with pytest.raises(RuntimeError, match="rows in 3 tries"):
        assign.dirichlet_assign(df, "row", "label", 200, 0.01, 2, min_size=19, max_tries=3)


def test_equal_size_dirichlet(frame):
    df = two_classes(frame, 10000)
    assigned = assign.dirichlet_equal_assign(df, "row", "label", 100, 0.1, 5)
    assert sizes_of(assigned) == [100] * 100 and assigned.select("row").distinct().count() == 10000
    assert skew(df, assigned) > 0.3
    odd = assign.dirichlet_equal_assign(two_classes(frame, 1003), "row", "label", 10, 0.1, 5)
    assert sizes_of(odd) == [100] * 7 + [101] * 3


@pytest.mark.parametrize("counts, clients, alpha", [({0: 7, 1: 0, 2: 500}, 9, 0.05), ({"a": 3}, 5, 1.0), ({0: 1, 1: 1, 2: 1}, 7, 0.1), ({0: 90, 1: 10, 2: 1000}, 40, 100.0)])
def test_equal_size_plans_use_every_row_once(counts, clients, alpha):
    plan = assign.equal_size_plan(counts, clients, alpha, 3)
    given = np.array([np.diff(edges) for edges in plan.values()])
    assert (given >= 0).all() and given.sum(axis=1).tolist() == list(counts.values())
    assert given.sum(axis=0).max() - given.sum(axis=0).min() <= 1


def test_quantity_skew(frame):
    assigned, _ = assign.quantity_skew_assign(two_classes(frame), "row", 6, 0.5, 3, min_size=5)
    assert sum(sizes_of(assigned)) == 4000 and sizes_of(assigned)[0] >= 5 and len(set(sizes_of(assigned))) > 3


def test_natural_clients(frame):
    df = frame([(i, k) for i, k in enumerate(["u2", "u1", "u2", "u3", "u1", "u2"])] + [(6, "-1"), (7, None)], "row long, key string")
    assigned = assign.natural_assign(df, "key", "row", 2, ignored="-1")
    assert sorted((r.client, r.row) for r in assigned.collect()) == [(0, 1), (0, 4), (1, 0), (1, 2), (1, 5)]


def test_saved_assignments_are_verified(spark, frame, tmp_path):
    df = two_classes(frame, 200)
    assigned, _ = assign.dirichlet_assign(df, "row", "label", 4, 1.0, 2, min_size=1)
    path = str(tmp_path / "a")
    assign.save_assignment(assigned, "row", path)
    assert assign.load_assignment(spark, "row", path, 200).count() == 200
    with pytest.raises(RuntimeError, match="200 rows"):
        assign.load_assignment(spark, "row", path, 100)
    stored = spark.read.parquet(path + "/rows").collect()
    moved = spark.createDataFrame([(r.row, (r.client + (r.row == 7)) % 4) for r in stored], "row long, client int")
    moved.write.mode("overwrite").parquet(path + "/rows")
    with pytest.raises(RuntimeError, match="differs"):
        assign.load_assignment(spark, "row", path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        assign.load_assignment(spark, "row", str(tmp_path / "none"))


def test_description(frame):
    rows = frame([(0, 1, 0), (0, 1, 2), (1, 0, 1)], "client int, label int, role int")
    got = assign.describe_assignment(rows, "label", 2, "role").orderBy("client").collect()
    assert [tuple(r) for r in got] == [(0, 2, 0, 2, 1, 0, 1), (1, 1, 1, 0, 0, 1, 0)]
