from __future__ import annotations

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.operators import ledger, metrics
from keyloom.operators import replicates as stats

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def brute_metrics(y, p, classes):
    cm = np.zeros((classes, classes))
    for a, b in zip(y, p):
        cm[a, b] += 1
    hit, true, pred = np.diag(cm), cm.sum(1), cm.sum(0)
    precision = np.array([h / q if q else 0 for h, q in zip(hit, pred)])
    recall = np.array([h / q if q else 0 for h, q in zip(hit, true)])
    f1 = np.array([2 * a * b / (a + b) if a + b else 0 for a, b in zip(precision, recall)])
    here = true > 0
    return hit.sum() / cm.sum(), f1[here].mean(), precision[here].mean(), recall[here].mean()


@SLOW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=60))
def test_metrics_and_additivity(spark, rows):
    df = spark.createDataFrame(rows, "k int, y int, p int").repartition(3)
    counts = metrics.confusion(df, "y", "p", 4, ["k"])
    per_key = {r.k: r for r in metrics.classification_metrics(counts, 4, ["k"]).collect()}
    for k in {r[0] for r in rows}:
        own = [(y, p) for key, y, p in rows if key == k]
        r = per_key[k]
        assert np.allclose([r.accuracy, r.macro_f1, r.macro_precision, r.macro_recall], brute_metrics(*zip(*own), 4))
    pooled = counts.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))
    whole = metrics.classification_metrics(pooled, 4).first()
    assert whole.n == len(rows)
    assert np.isclose(whole.macro_f1, brute_metrics([r[1] for r in rows], [r[2] for r in rows], 4)[1])


def test_single_class_key(frame):
    df = frame([(1, 1), (1, 1), (1, 1), (1, 0)], "y int, p int")
    row = metrics.classification_metrics(metrics.confusion(df, "y", "p", 2), 2).first()
    assert row.macro_f1 == pytest.approx(2 * 0.75 / 1.75)


def test_dispersion_hand_values(frame):
    row = metrics.dispersion(frame([(0.9,), (0.8,), (0.5,), (float("nan"),), (None,)], "v double"), "v").first()
    assert (row["count"], row.worst, row.best) == (3, 0.5, 0.9)
    assert row.spread == pytest.approx(0.4) and row["median"] == 0.8
    assert row["std"] == pytest.approx(np.std([0.9, 0.8, 0.5], ddof=1)) and row.p10 == pytest.approx(np.percentile([0.9, 0.8, 0.5], 10))
    one = metrics.dispersion(frame([(0.3,)], "v double"), "v").first()
    assert (one["std"], one.iqr) == (0.0, 0.0)
    none = metrics.dispersion(frame([(None,)], "v double"), "v").first()
    assert none["count"] == 0 and none["mean"] is None and none["std"] is None


def test_seen_and_unseen(frame):
    rows = [("seen", 1, 1, 1), ("seen", 1, 0, 0), ("seen", 2, 1, 0), ("unseen", 7, 1, 1), ("unseen", 7, 0, 0), ("unseen", 9, 1, 1), ("unseen", 9, 1, 0)]
    df = frame(rows, "side string, k int, y int, p int")
    report = metrics.generalization_report(df, "k", "side", "y", "p", 2).first()
    assert report.unseen_accuracy == 0.75 and report.unseen_key_count == 2
    assert report.gap_accuracy == pytest.approx(2 / 3 - 0.75)
    per_key = {r.k: r.n for r in metrics.per_key_metrics(df.where("side = 'unseen'"), "k", "y", "p", 2).collect()}
    assert per_key == {7: 2, 9: 2}


HISTORY = [(1, 0.5), (2, 0.7), (3, 0.65), (4, 0.72), (5, 0.8)]


@pytest.mark.parametrize("target, patience, expected", [(0.7, 1, 2), (0.7, 2, 4), (0.95, 1, None), (0.8, 2, None)])
def test_rounds_to_target(frame, target, patience, expected):
    rows = frame([("r", n, v, 100 * n) for n, v in HISTORY], "run string, round int, f1 double, cum long")
    row = metrics.bytes_to_target(rows, ["run"], "round", "f1", "cum", target, patience).first()
    assert row.rounds_to_target == expected and row.bytes_to_target == (expected and 100 * expected)


def test_a_missing_metric_breaks_a_streak(frame):
    rows = frame([("r", 1, 0.8), ("r", 2, None), ("r", 3, 0.8), ("r", 4, 0.9)], "run string, round int, f1 double")
    assert metrics.rounds_to_target(rows, ["run"], "round", "f1", 0.7, 2).first().rounds_to_target == 3


def brute_wilcoxon(diffs):
    d = np.array([x for x in diffs if x != 0])
    if not len(d):
        return None, None
    ranks = np.array([(np.abs(d) < abs(x)).sum() + ((np.abs(d) == abs(x)).sum() + 1) / 2 for x in d])
    plus, total = ranks[d > 0].sum(), ranks.sum()
    far = abs(plus - total / 2)
    hits = sum(abs(np.dot(s, ranks) - total / 2) >= far - 1e-12 for s in itertools.product((0, 1), repeat=len(d)))
    return hits / 2 ** len(d), (2 * plus - total) / total


@SLOW
@given(st.lists(st.lists(st.integers(-4, 4), min_size=1, max_size=9), min_size=1, max_size=6))
def test_wilcoxon_equals_enumeration(spark, groups):
    df = spark.createDataFrame([(g, float(d)) for g, ds in enumerate(groups) for d in ds], "g int, d double")
    for row in stats.wilcoxon(df, ["g"], "d").collect():
        p, rb = brute_wilcoxon(groups[row.g])
        assert (row.wilcoxon_p is None) == (p is None)
        if p is not None:
            assert row.wilcoxon_p == pytest.approx(p) and row.rank_biserial == pytest.approx(rb)


def test_wilcoxon_of_larger_groups(frame):
    rng = np.random.default_rng(0)
    groups = {"exact": rng.normal(0.3, 1, 40), "ties": np.round(rng.normal(0.3, 1, 40), 0), "large": rng.normal(0.2, 1, 200)}
    df = frame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, d double")
    got = {r.g: r for r in stats.wilcoxon(df.where("g = 'exact'"), ["g"], "d").collect()}
    got |= {r.g: r for r in stats.wilcoxon(df.where("g <> 'exact'"), ["g"], "d", "normal").collect()}
    assert {r.wilcoxon_method for r in got.values()} == {"exact", "normal"}
    with pytest.raises(Exception, match="1200 differences"):
        stats.wilcoxon(frame([(0, float(i + 1)) for i in range(1200)], "g int, d double"), ["g"], "d").collect()
    from statistics import NormalDist

    for name, values in groups.items():
        d = values[values != 0]
        n = len(d)
        ranks = np.array([(np.abs(d) < abs(x)).sum() + ((np.abs(d) == abs(x)).sum() + 1) / 2 for x in d])
        plus = ranks[d > 0].sum()
        if name == "exact":
            counts = np.zeros(n * (n + 1) // 2 + 1)
            counts[0] = 1
            for r in range(1, n + 1):
                counts[r:] = counts[r:] + np.concatenate([counts[:-r]])
            far = abs(plus - n * (n + 1) / 4)
            p = counts[np.abs(np.arange(len(counts)) - n * (n + 1) / 4) >= far - 1e-12].sum() / 2**n
        else:
            _, t = np.unique(np.abs(d), return_counts=True)
            var = n * (n + 1) * (2 * n + 1) / 24 - (t**3 - t).sum() / 48
            p = 2 * NormalDist().cdf(-abs(plus - n * (n + 1) / 4) / np.sqrt(var))
        assert got[name].wilcoxon_p == pytest.approx(p, abs=1e-9), name


def test_paired_seeds_hand_values(frame):
    rows = frame([(0.81, 0.80), (0.83, 0.82), (0.85, 0.84), (0.87, 0.86), (0.89, 0.88)], "a double, b double").withColumn("g", F.lit(1))
    row = stats.paired_comparison(rows, ["g"], "a", "b").first()
    assert row.mean_diff == pytest.approx(0.01) and row.wilcoxon_p == pytest.approx(0.0625) and row.wilcoxon_min_p == 0.0625
    one = stats.paired_comparison(rows.limit(1), ["g"], "a", "b").first()
    assert one.t_p is None and one.diff_ci95_low is None and one.n == 1


def test_holm_hand_values_and_null(frame):
    rows = frame([("a", 0, 0.01), ("a", 1, 0.04), ("a", 2, 0.03), ("b", 0, None), ("b", 1, 0.01)], "f string, i int, p double")
    got = {(r.f, r.i): round(r.p_holm, 10) for r in stats.holm(rows, "p", ["i"], ["f"]).collect()}
    assert got == {("a", 0): 0.03, ("a", 1): 0.06, ("a", 2): 0.06, ("b", 0): 1.0, ("b", 1): 0.02}


def test_summary_of_one_and_many(frame):
    rows = [("one", 0.5)] + [("many", v) for v in (0.1, 0.2, 0.4, 0.7)]
    got = {r.g: r for r in stats.summarize(frame(rows, "g string, v double"), ["g"], "v").collect()}
    assert got["one"].n == 1 and got["one"]["std"] is None and got["one"].ci95_low is None
    half = 3.182446305284263 * np.std([0.1, 0.2, 0.4, 0.7], ddof=1) / 2
    assert got["many"].ci95_high - got["many"]["mean"] == pytest.approx(half)


def test_pairs_need_two_shared_seeds(frame):
    rows = frame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3), ("b", 2, 0.1), ("c", 2, 0.5)], "c string, seed int, v double")
    assert [(r.a, r.b, r.n) for r in stats.all_pairs_comparison(rows, "c", "seed", "v").collect()] == [("a", "b", 2)]


def test_ledger_hand_values(frame):
    rows = [(1, "training", "down", 100)] * 3 + [(1, "training", "up", 90)] * 2 + [(2, "training", "down", 100), (2, "training", "up", 90)]
    rows += [(0, "evaluation", "down", 50), (0, "evaluation", "up", 5), (0, "setup", "down", 1)]
    messages = frame(rows, "round int, phase string, direction string, bytes long").withColumn("run", F.lit("r"))
    ledger_rows = ledger.round_ledger(messages.where("phase = 'training'"), ["run"], "round").orderBy("round").collect()
    assert [(r.downlink_clients, r.uplink_bytes, r.cum_total_bytes) for r in ledger_rows] == [(3, 180, 480), (1, 90, 670)]
    totals = ledger.ledger_totals(messages, ["run"]).first()
    assert (totals.training_total_bytes, totals.evaluation_downlink_bytes, totals.setup_downlink_bytes, totals.setup_uplink_bytes) == (670, 50, 1, 0)
    silent = ledger.round_ledger(messages.where("direction = 'down'"), ["run"], "round").first()
    assert silent.uplink_bytes_per_client == 0.0


def test_tails(spark):
    from keyloom.functions import tdist

    assert tdist.quantile(7) == pytest.approx(2.364624251592785) and tdist.quantile(10**6) == pytest.approx(1.9599663568, abs=1e-8)
    rows = spark.createDataFrame([(0.0, 3), (2.0, 1), (1.5, 4), (60.0, 30), (-2.0, 10**7), (None, 3), (1.0, 0)], "t double, v long")
    p = [r.p for r in rows.select(tdist.two_sided_p(F.col("t"), F.col("v")).alias("p")).collect()]
    assert p[:3] == pytest.approx([1.0, 1 - 2 / np.pi * np.arctan(2.0), 0.208], abs=1e-9)
    assert 0 < p[3] < 1e-30 and p[4] == pytest.approx(0.0455003, abs=1e-6) and p[5:] == [None, None]
    z = [r.p for r in spark.createDataFrame([(0.0,), (-1.96,), (20.0,), (None,)], "z double").select(tdist.normal_two_sided_p(F.col("z")).alias("p")).collect()]
    assert z[:2] == pytest.approx([1.0, 0.04999579]) and 0 < z[2] < 1e-80 and z[3] is None
