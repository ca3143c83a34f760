"""Training against brute force with dense NumPy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.operators import params, scoring, training
from keyloom.operators.keys import key_label_counts
from keyloom.operators.training import Fit

D, C, SIZES = 6, 3, (10, 8, 14)


@pytest.fixture(scope="module")
def data(frame_module):
    rng = np.random.default_rng(0)
    n = sum(SIZES)
    x = rng.random((n, D)) * (rng.random((n, D)) < 0.5)
    x[3] = 0  # a document without features
    y = (x @ rng.normal(size=(D, C)) + rng.normal(size=(n, C)) * 0.3).argmax(axis=1)
    key = np.repeat(np.arange(len(SIZES)), SIZES)
    documents = frame_module([(i, int(key[i]), int(y[i])) for i in range(n)], "doc long, key int, label int")
    cells = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    features = frame_module(cells, "doc long, idx int, value double")
    return x, y, key, documents, features


@pytest.fixture(scope="module")
def frame_module(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def order(ids, seed, number):
    return sorted(ids, key=lambda d: (hashlib.md5(f"{seed}|{number}|{d}".encode()).hexdigest(), d))


def brute_fit(x, y, ids, w0, fit, offset=0.0, correction=0.0):
    """Dense mini-batch SGD; the last column of ``w`` is the bias."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, speed = w0.copy(), np.zeros_like(w0)
    n = len(ids)
    size = fit.batch_size or n
    batches = -(-n // size)
    total = max(1, round(fit.epochs * batches))
    loss, seen = 0.0, 0
    for step in range(total):
        number, turn = divmod(step, batches)
        batch = order(ids, fit.seed, number)[turn * size:(turn + 1) * size] if fit.batch_size else list(ids)
        p = softmax(x1[batch] @ w.T + offset)
        loss -= np.log(p[np.arange(len(batch)), y[batch]]).sum()
        seen += len(batch)
        p[np.arange(len(batch)), y[batch]] -= 1
        g = p.T @ x1[batch] / len(batch) + fit.mu * (w - w0) + correction + fit.weight_decay * w
        speed = fit.momentum * speed + g
        w = w - fit.lr * speed
    return w, total, loss / seen


def dense(rows, names="w"):
    w = np.zeros((C, D + 1))
    for r in rows:
        for c in range(C):
            w[c, D if r.idx == training.BIAS else r.idx] = r[f"{names}_{c}"]
    return w


def dense_long(table):
    w = np.zeros((C, D + 1))
    for r in table.collect():
        w[r["class"], D if r.layer == "bias" else r.idx] = r.value
    return w


def start_params(spark, w):
    rows = [("weight", c, j, float(w[c, j])) for c in range(C) for j in range(D)]
    rows += [("bias", c, 0, float(w[c, D])) for c in range(C)]
    return spark.createDataFrame(rows, "layer string, class int, idx int, value double")


FITS = [
    Fit(C, 0.5),
    Fit(C, 0.3, epochs=3, momentum=0.9, weight_decay=0.05),
    Fit(C, 0.3, epochs=2, batch_size=7, mu=0.4, seed=5),
    Fit(C, 0.2, epochs=1.5, batch_size=5, momentum=0.5, weight_decay=0.02, mu=0.1, seed=9),
    Fit(C, 0.2, epochs=1.5, batch_size=5, momentum=0.5, weight_decay=0.02, mu=0.1, seed=9, max_group_rows=0),
    Fit(C, 0.3, epochs=2.5, batch_size=9, momentum=0.9, seed=2, max_group_rows=30),
    Fit(C, 0.3, epochs=2, batch_size=100, mu=0.4, seed=5, max_group_rows=0),
    Fit(C, 0.2, epochs=1.5, batch_size=5, momentum=0.5, weight_decay=0.02, mu=0.1, seed=9, wide_batch=1),
]


@pytest.mark.parametrize("fit", FITS)
def test_training_equals_brute_force(spark, data, fit):
    x, y, key, documents, features = data
    w0 = np.random.default_rng(1).normal(size=(C, D + 1)) * 0.3
    rows = training.training_rows(documents, features, "doc", "key", "label")
    start = training.start_table(rows, training.to_wide(start_params(spark, w0), C), C)
    got = training.train_per_key(rows, start, fit).collect()
    for k in range(len(SIZES)):
        mine = [r for r in got if r.key == k]
        w, steps, loss = brute_fit(x, y, np.flatnonzero(key == k).tolist(), w0, fit)
        used = sorted({r.idx for r in mine})
        columns = [D if j == training.BIAS else j for j in used]
        assert np.allclose(dense(mine)[:, columns], w[:, columns])
        assert mine[0].steps == steps and mine[0].n == SIZES[k] and mine[0].train_loss == pytest.approx(loss)
        # the rule for parameters the key never uses, and the listed change against it
        assert np.allclose((mine[0].keep * w0 + dense(mine, "d"))[:, columns], w[:, columns])
        unused = [j for j in range(D) if j not in used]
        assert np.allclose(mine[0].keep * w0[:, unused], w[:, unused])


def test_pooled_step(data):
    x, y, _, documents, features = data
    fit = Fit(C, 0.5)
    pooled, history = training.train_pooled(documents, features, "doc", "label", fit, 1)
    assert np.allclose(dense_long(pooled), brute_fit(x, y, list(range(len(y))), np.zeros((C, D + 1)), fit)[0])
    assert history.first().train_loss == pytest.approx(np.log(C))


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("fit", [Fit(C, 0.5), Fit(C, 0.3, momentum=0.9, weight_decay=0.05, mu=0.2)])
def test_pooled_blocks_equal_steps(data, monkeypatch, fit, most):
    """Both forms of pooled training, over two epochs with a decaying rate."""
    monkeypatch.setattr(training, "MOST_WEIGHTS", most)
    x, y, _, documents, features = data
    pooled, history = training.train_pooled(documents, features, "doc", "label", fit, 2, 0.5)
    w = np.zeros((C, D + 1))
    for epoch, lr in ((1, fit.lr), (2, fit.lr * 0.5)):
        w, steps, loss = brute_fit(x, y, list(range(len(y))), w, Fit(C, lr, momentum=fit.momentum, weight_decay=fit.weight_decay, mu=fit.mu))
        row = history.where(F.col("round") == epoch).first()
        assert row.train_loss == pytest.approx(loss) and row.steps == steps and row.lr == pytest.approx(lr)
    assert np.allclose(dense_long(pooled), w)


def test_prior_offsets(data, frame_module):
    x, y, key, documents, features = data
    counts = np.array([np.bincount(y[key == k], minlength=C) + 1.0 for k in range(len(SIZES))])
    offsets = np.log(counts / counts.sum(axis=1, keepdims=True))
    shifted = documents.join(scoring.label_prior_offset(key_label_counts(documents, "key", "label", C), C).select("key", "offset"), "key")
    rows = training.training_rows(shifted, features, "doc", "key", "label", ["offset"])
    fit = Fit(C, 0.4, epochs=2)
    trained = training.train_per_key(rows, training.start_table(rows, None, C), fit).collect()
    for k in range(len(SIZES)):
        mine = [r for r in trained if r.key == k]
        w, _, _ = brute_fit(x, y, np.flatnonzero(key == k).tolist(), np.zeros((C, D + 1)), fit, offsets[k])
        columns = [D if r.idx == training.BIAS else r.idx for r in mine]
        assert np.allclose(dense(mine)[:, columns], w[:, columns])
    rows = frame_module([(0, 0)] * 3 + [(0, 1)], "key int, label int")
    offset = scoring.label_prior_offset(key_label_counts(rows, "key", "label", 3), 3).first().offset
    assert np.allclose(np.exp(offset), [4 / 7, 2 / 7, 1 / 7])


@pytest.mark.parametrize("records", [1, 3, 1000])
def test_documents_may_go_on_in_the_next_arrow_batch(spark, data, records):
    """Keys that are streamed equal keys that are grouped, however rows are cut into batches."""
    _, _, _, documents, features = data
    rows = training.training_rows(documents, features, "doc", "key", "label")
    fit = Fit(C, 0.3, epochs=2, batch_size=3, momentum=0.5, seed=4)
    start = training.start_table(rows, None, C)
    grouped = training._fit_grouped(rows, start, fit).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        streamed = training.fit_in_order(rows, start, fit).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    known = {(r.key, r.idx): r for r in grouped}
    assert len(streamed) == len(known)
    for r in streamed:
        assert tuple(r)[4:] == pytest.approx(tuple(known[r.key, r.idx])[4:]) and r.steps == known[r.key, r.idx].steps


def test_local_only_models(data):
    x, y, key, documents, features = data
    rows = training.training_rows(documents, features, "doc", "key", "label")
    fit = Fit(C, 0.5, epochs=5)
    results, spread = training.train_local_only(rows, rows, fit)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    for r in results.collect():
        ids = np.flatnonzero(key == r.key)
        w, _, _ = brute_fit(x, y, ids.tolist(), np.zeros((C, D + 1)), fit)
        right = (x1 @ w.T).argmax(axis=1) == y
        assert r.client_test_accuracy == pytest.approx(right[ids].mean())
    assert {r.metric: r["count"] for r in spread.collect()} == {"client_test_accuracy": 3, "client_test_macro_f1": 3}


def test_scores_and_evaluation(spark, data):
    x, y, _, documents, features = data
    w = np.random.default_rng(3).normal(size=(C, D + 1))
    scored = scoring.score_linear(documents, features, start_params(spark, w), "doc", C)
    logits = np.hstack([x, np.ones((len(x), 1))]) @ w.T
    for r in scored.collect():
        assert np.allclose(r.logits, logits[r.doc])
    report = scoring.evaluate(scored, "label", C).first()
    assert report.loss == pytest.approx(-np.log(softmax(logits)[np.arange(len(y)), y]).mean())
    assert report.accuracy == pytest.approx((logits.argmax(axis=1) == y).mean())
    zero = scoring.evaluate(scoring.score_linear(documents, features, start_params(spark, w * 0), "doc", C), "label", C).first()
    assert zero.loss == pytest.approx(np.log(C)) and zero.n == len(y)
    empty = scoring.evaluate(scored.limit(0), "label", C).first()
    assert (empty.n, empty.loss, empty.accuracy, empty.macro_f1) == (0, None, None, None)


def test_server_steps_hand_values(frame_module):
    table = lambda rows: frame_module([("weight", 0, 0, v) for v in rows], "layer string, class int, idx int, value double")
    updates = frame_module([(c, "weight", 0, 0, v) for c, v in ((1, 1.0), (2, 4.0))], "client int, layer string, class int, idx int, value double")
    clients = frame_module([(1, 1), (2, 2)], "client int, n long")
    mean = params.weighted_average(updates, clients)
    assert mean.first().value == pytest.approx(3.0)
    assert params.step_fedavg(table([0.0]), mean).first().value == pytest.approx(3.0)
    assert params.step_fedavg(table([0.5]), mean.limit(0)).first().value == 0.5
    state = frame_module([], "layer string, class int, idx int, m double, v double")
    adam = params.step_fedadam(table([0.0]), table([2.0]), state, 0.1).first()
    assert adam.value == pytest.approx(0.1 * 0.2 / (0.04**0.5 + 0.001))
    kept = params.step_fedadam(table([0.7]), table([2.0]).limit(0), state, 0.1).first()
    assert (kept.value, kept.m) == (0.7, 0.0)
    ones = frame_module([(c, "weight", 0, 0, 1.0) for c in (1, 2)], "client int, layer string, class int, idx int, value double")
    twos = ones.withColumn("value", F.lit(2.0))
    stepped, variates = params.step_scaffold(table([0.0]), ones, table([0.0]), twos, clients, 4)
    assert stepped.first().value == pytest.approx(1.0) and variates.first().value == pytest.approx(1.0)
    counted = params.parameter_counts(table([1.0, 2.0])).first()
    assert (counted.total_parameters, counted.bytes_float32) == (2, 8)


def test_missing_cells_count_as_zero(frame_module):
    updates = frame_module([(1, "weight", 0, 0, 3.0), (2, "weight", 0, 1, 6.0)], "client int, layer string, class int, idx int, value double")
    clients = frame_module([(1, 1), (2, 2)], "client int, n long")
    assert {r.idx: r.value for r in params.weighted_average(updates, clients).collect()} == {0: 1.0, 1: 4.0}
    assert {r.idx: r.value for r in params.simple_average(updates, clients).collect()} == {0: 1.5, 1: 3.0}


def test_work_of_mini_batches_grows_with_rows_not_with_steps_times_features(monkeypatch):
    rng = np.random.default_rng(3)
    docs, features = 400, 3000
    rows = pd.DataFrame({"doc": np.repeat(np.arange(docs), 6), "idx": np.tile([-1, 0, 0, 0, 0, 0], docs)})
    rows.loc[rows["idx"] == 0, "idx"] = (np.arange(docs * 5) * 7) % features
    rows["value"], rows["label"], rows["key"] = rng.normal(size=len(rows)), rows["doc"] % 2, "k"
    start = pd.DataFrame({"key": "k", "idx": np.unique(rows["idx"])})
    for name in ("w_0", "w_1", "g_0", "g_1", "l_0", "l_1"):
        start[name] = rng.normal(size=len(start))
    counted, made = np.bincount, []

    def bincount(*args):
        made.append(len(counted(*args)))
        return counted(*args)

    monkeypatch.setattr(training.np, "bincount", bincount)
    fit = training.Fit(2, 0.1, epochs=1.5, batch_size=2, momentum=0.9, weight_decay=0.01, mu=0.1, seed=1)
    got = training._fit_group(rows, start, fit).set_index("idx")
    assert sum(made) <= 8 * len(rows)
    # the same steps, every parameter moved in each
    monkeypatch.undo()
    w, g, own = (start.set_index("idx")[[f"{p}_0", f"{p}_1"]].to_numpy() for p in "wgl")
    first, speed, at = w.copy(), np.zeros_like(w), np.searchsorted(start["idx"], rows["idx"])
    x = np.zeros((docs, len(start)))
    np.add.at(x, (rows["doc"], at), rows["value"])
    for step in range(300):
        batch = training._pass_order(list(range(docs)), 1, step // 200)[step % 200 * 2:][:2]
        odds = np.exp(x[batch] @ w)
        residual = odds / odds.sum(axis=1, keepdims=True) - np.eye(2)[batch % 2]
        speed = 0.9 * speed + x[batch].T @ residual / 2 + 0.1 * (w - first) + g - own + 0.01 * w
        w = w - 0.1 * speed
    assert np.allclose(got.loc[start["idx"], ["w_0", "w_1"]], w)


def test_pooled_rows_are_dealt_out_once_for_all_epochs(data, monkeypatch):
    x, y, _, documents, features = data
    dealt, parted = [], training._parted
    monkeypatch.setattr(training, "MOST_WEIGHTS", 0)
    monkeypatch.setattr(training, "_parted", lambda rows: dealt.append(1) or parted(rows))
    monkeypatch.setattr(training, "packed_documents", lambda rows: pytest.fail("packed, but trained in steps"))
    pooled, _ = training.train_pooled(documents, features, "doc", "label", Fit(C, 0.5), 2)
    assert len(dealt) == 1
    w = np.zeros((C, D + 1))
    for _ in range(2):
        w = brute_fit(x, y, list(range(len(y))), w, Fit(C, 0.5))[0]
    assert np.allclose(dense_long(pooled), w)
