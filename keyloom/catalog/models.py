"""Scores, predictions, training and metrics over labelled documents, and parameter averaging over embeddings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.catalog import query
from keyloom.catalog.tables import (
    CENTROIDS, CLASSES, FEATURES, KEYED_EVENTS, KEYED_LABELS, MESSAGES, UPDATES, features, keyed_events,
    keyed_labels, keyed_text, messages, model_inputs, r, rounded, rs, updates, with_,
)
from keyloom.operators import metrics, params, scoring, training
from keyloom.operators.keys import key_label_counts
from keyloom.operators.ledger import round_ledger
from keyloom.session import cut_lineage

LOGITS = [
    *FEATURES, *CENTROIDS,
    """sums AS (
      SELECT f.doc_id, p.class, sum(f.value * p.value) AS s FROM features f
      JOIN centroids p ON p.idx = f.idx AND p.layer = 'weight' GROUP BY f.doc_id, p.class)""",
    """logits AS (
      SELECT k.doc_id, k.key, k.lang, k.label, b.class, coalesce(s.s, 0.0) + b.value AS logit
      FROM keyed_text k CROSS JOIN (SELECT class, value FROM centroids WHERE layer = 'bias') b
      LEFT JOIN sums s ON s.doc_id = k.doc_id AND s.class = b.class)""",
    """predictions AS (
      SELECT doc_id, key, lang, label, class::INTEGER AS prediction FROM logits
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY logit DESC, class) = 1)""",
    """losses AS (
      SELECT doc_id, any_value(lang) AS lang, ln(sum(exp(logit))) - max(CASE WHEN class = label THEN logit END) AS loss
      FROM logits GROUP BY doc_id)""",
]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    documents, values, model = model_inputs(spark, sf)
    return scoring.score_linear(documents, values, model, "doc_id", CLASSES)


@query(with_(LOGITS, f"SELECT doc_id, class::INTEGER AS class, {r('logit')} AS logit FROM logits"))
def score_linear(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(spark, sf).select("doc_id", F.posexplode("logits").alias("class", "logit")), "logit")


@query(with_(LOGITS, "SELECT doc_id, label, prediction FROM predictions"))
def predict(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.predict(scored(spark, sf)).select("doc_id", "label", "prediction")


def metrics_sql(source: str, by: str, classes: int, truth: str = "label") -> list[str]:
    """Metrics of ``source(by.., truth, prediction)`` as the table ``measured``, one row per ``by`` group."""
    hits = f"count(*) FILTER ({truth} = prediction)"
    return [
        f"labels_ AS (SELECT unnest(range(0, {classes})) AS c)",
        f"groups_ AS (SELECT {by}, count(*) AS n, {hits} / count(*) AS accuracy FROM {source} GROUP BY {by})",
        f"""per_class AS (
          SELECT {by}, c, count(*) FILTER ({truth} = c) AS t, count(*) FILTER (prediction = c) AS p,
                 count(*) FILTER ({truth} = c AND prediction = c) AS hit FROM {source}, labels_ GROUP BY {by}, c)""",
        f"""rates AS (
          SELECT {by}, c, t, CASE WHEN p > 0 THEN hit / p ELSE 0.0 END AS pr, CASE WHEN t > 0 THEN hit / t ELSE 0.0 END AS rc
          FROM per_class)""",
        f"scores AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM rates)",
        f"""macro AS (
          SELECT {by}, avg(f1) FILTER (t > 0) AS macro_f1, avg(pr) FILTER (t > 0) AS macro_precision,
                 avg(rc) FILTER (t > 0) AS macro_recall FROM scores GROUP BY {by})""",
        f"measured AS (SELECT * FROM groups_ JOIN macro USING ({by}))",
    ]


MEASURES = ("accuracy", "macro_f1", "macro_precision", "macro_recall")


@query(with_([*LOGITS, *metrics_sql("predictions", "lang", 2),
              "loss AS (SELECT lang, avg(loss) AS loss FROM losses GROUP BY lang)"],
             f"SELECT lang, n, {rs(*MEASURES, 'loss')} FROM measured JOIN loss USING (lang)"))
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    measured = scoring.evaluate(scored(spark, sf), "label", CLASSES, ["lang"]).drop("per_class_f1")
    return rounded(measured, *MEASURES, "loss")


EVENT_COUNTS = [
    KEYED_EVENTS,
    "pairs AS (SELECT key, unnest(range(0, 5))::INTEGER AS class FROM (SELECT DISTINCT key FROM keyed_events))",
    """counted AS (
      SELECT p.key, p.class, count(e.row_id) AS n_c FROM pairs p
      LEFT JOIN keyed_events e ON e.key = p.key AND e.label = p.class GROUP BY p.key, p.class)""",
    "totals AS (SELECT class, sum(n_c) + 1.0 AS n_all FROM counted GROUP BY class)",
]


@query(with_(EVENT_COUNTS, f"""
SELECT key, class, {r('ln((n_c + 1.0) / (sum(n_c) OVER (PARTITION BY key) + 5.0))')} AS own,
       {r('ln((n_c + 1.0) / (sum(n_c) OVER (PARTITION BY key) + 5.0)) - ln(n_all / (SELECT sum(n_all) FROM totals))')} AS relative
FROM counted JOIN totals USING (class)"""))
def label_prior_offset(spark: SparkSession, sf: str) -> DataFrame:
    counts = key_label_counts(keyed_events(spark, sf), "key", "label", 5)
    own = scoring.label_prior_offset(counts, 5).withColumnRenamed("offset", "own")
    both = scoring.label_prior_offset(own, 5, scoring.global_prior(counts, 5))
    return rounded(
        both.select("key", F.posexplode(F.arrays_zip("own", "offset")).alias("class", "v")).select(
            "key", "class", "v.own", F.col("v.offset").alias("relative")
        ), "own", "relative",
    )


@query(with_([KEYED_LABELS], """
SELECT key, count(*) AS n, greatest(1, round_even(1.5 * ceil(count(*) / 4), 0))::BIGINT AS steps FROM keyed_labels GROUP BY key"""))
def planned_steps(spark: SparkSession, sf: str) -> DataFrame:
    sizes = keyed_labels(spark, sf).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("steps", scoring.planned_steps(F.col("n"), 4, 1.5))


# ---- training

LR = 0.5


def start_sql(by: str, where: str = "true") -> list[str]:
    return [
        f"""train AS (
          SELECT {by} AS g, k.doc_id, k.label, f.idx, f.value FROM features f JOIN keyed_text k ON k.doc_id = f.doc_id WHERE {where}
          UNION ALL SELECT {by}, doc_id, label, -1, 1.0 FROM keyed_text k WHERE {where})""",
        "sizes AS (SELECT g, count(*) AS n FROM train WHERE idx = -1 GROUP BY g)",
        "w0 AS (SELECT DISTINCT g, idx, 0.0 AS a, 0.0 AS b FROM train)",
    ]


def step_sql(t: int, lr: float = LR, decay: float = 0.0, mu: float = 0.0) -> list[str]:
    """Full-batch step ``t`` of a two-class model per group ``g``: weights ``a``, ``b`` from w(t-1) to w(t)."""
    move = lambda c: f"w.{c} - {lr} * (d.{c} + {decay} * w.{c} + {mu} * w.{c})"  # noqa: E731  (started from zero)
    return [
        f"""x{t} AS (
          SELECT t.g, t.doc_id, any_value(t.label) AS label, sum(value * a) AS xa, sum(value * b) AS xb
          FROM train t JOIN w{t - 1} w ON w.g = t.g AND w.idx = t.idx GROUP BY t.g, t.doc_id)""",
        f"""r{t} AS (
          SELECT g, doc_id, 1 / (1 + exp(xb - xa)) - (label = 0)::INTEGER AS ra,
                 1 / (1 + exp(xa - xb)) - (label = 1)::INTEGER AS rb,
                 CASE WHEN label = 0 THEN ln(1 + exp(xb - xa)) ELSE ln(1 + exp(xa - xb)) END AS loss FROM x{t})""",
        f"""d{t} AS (
          SELECT t.g, t.idx, sum(value * ra) / any_value(n) AS a, sum(value * rb) / any_value(n) AS b
          FROM train t JOIN r{t} r ON r.g = t.g AND r.doc_id = t.doc_id JOIN sizes s ON s.g = t.g GROUP BY t.g, t.idx)""",
        f"w{t} AS (SELECT w.g, w.idx, {move('a')} AS a, {move('b')} AS b FROM w{t - 1} w JOIN d{t} d ON d.g = w.g AND d.idx = w.idx)",
    ]


def long_sql(source: str) -> str:
    """Parameter table of ``source(idx, a, b)``."""
    layer = "CASE WHEN idx = -1 THEN 'bias' ELSE 'weight' END AS layer, greatest(idx, 0)::INTEGER AS idx"
    return (
        f"SELECT {layer}, 0 AS class, {r('a')} AS value FROM {source} UNION ALL SELECT {layer}, 1, {r('b')} FROM {source}"
    )


def training_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return cut_lineage(keyed_text(spark, sf).select("doc_id", "key", "label")), cut_lineage(features(spark, sf))


@query(with_([*FEATURES, *start_sql("k.key"), *step_sql(1, decay=0.01), *step_sql(2, decay=0.01),
              "l AS (SELECT g, avg(loss) AS loss FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) GROUP BY g)"], f"""
SELECT g AS key, idx::INTEGER AS idx, n, 2::BIGINT AS steps, {r('loss')} AS train_loss, {r('a')} AS w_0, {r('b')} AS w_1
FROM w2 JOIN sizes USING (g) JOIN l USING (g)"""))
def train_per_key(spark: SparkSession, sf: str) -> DataFrame:
    documents, values = training_inputs(spark, sf)
    rows = cut_lineage(training.training_rows(documents, values, "doc_id", "key", "label"))
    fit = training.Fit(classes=CLASSES, lr=LR, epochs=2, weight_decay=0.01)
    trained = training.train_per_key(rows, training.start_table(rows, None, CLASSES), fit)
    return rounded(trained.select("key", "idx", "n", "steps", "train_loss", "w_0", "w_1"), "train_loss", "w_0", "w_1")


@query(with_([*FEATURES, *start_sql("k.key"), *step_sql(1, decay=0.01), *step_sql(2, decay=0.01)], f"""
SELECT g AS key, idx::INTEGER AS idx, {r('a')} AS w_0, {r('b')} AS w_1 FROM w2"""))
def train_hot_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The weights after two steps, in the form of training that has no limit on the size of a key."""
    documents, values = training_inputs(spark, sf)
    rows = cut_lineage(training.training_rows(documents, values, "doc_id", "key", "label"))
    fit = training.Fit(classes=CLASSES, lr=LR, epochs=2, weight_decay=0.01)
    trained = training.fit_stepwise(rows, training.start_table(rows, None, CLASSES), fit)
    return rounded(trained.select("key", "idx", "w_0", "w_1"), "w_0", "w_1")


SIZE, PASSES, MOMENTUM = 8, 1.5, 0.9
# mini-batches in hash order, one recursion per step; a key without a batch in a step has ended
BATCHES = [
    *FEATURES, *start_sql("k.key"),
    f"plan AS (SELECT g, n, greatest(1, round_even({PASSES} * ceil(n / {SIZE}), 0))::BIGINT AS steps, ceil(n / {SIZE})::BIGINT AS batches FROM sizes)",
    f"""read AS (
      SELECT g, doc_id, p * batches + (place - 1) // {SIZE} AS step FROM (
        SELECT k.key AS g, k.doc_id, p, row_number() OVER (PARTITION BY k.key, p ORDER BY md5('3|' || p || '|' || k.doc_id), k.doc_id) AS place
        FROM keyed_text k, range({math.ceil(PASSES)}) t(p)) JOIN plan USING (g) WHERE p * batches + (place - 1) // {SIZE} < steps)""",
    "feed AS (SELECT t.*, r.step FROM train t JOIN read r ON r.g = t.g AND r.doc_id = t.doc_id)",
    f"""state AS (
      SELECT 0::BIGINT AS step, g, idx, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS va, 0.0::DOUBLE AS vb, 0.0::DOUBLE AS loss FROM w0
      UNION ALL
      SELECT s.step + 1, s.g, s.idx, s.a - {LR} * ({MOMENTUM} * s.va + coalesce(d.a, 0) / l.m), s.b - {LR} * ({MOMENTUM} * s.vb + coalesce(d.b, 0) / l.m),
             {MOMENTUM} * s.va + coalesce(d.a, 0) / l.m, {MOMENTUM} * s.vb + coalesce(d.b, 0) / l.m, s.loss + l.loss
      FROM state s
      JOIN (SELECT g, count(*) AS m, sum(CASE WHEN label = 0 THEN ln(1 + exp(xb - xa)) ELSE ln(1 + exp(xa - xb)) END) AS loss
            FROM (SELECT f.g, f.doc_id, any_value(f.label) AS label, sum(value * a) AS xa, sum(value * b) AS xb
                  FROM feed f JOIN state w ON w.g = f.g AND w.idx = f.idx AND w.step = f.step GROUP BY f.g, f.doc_id) GROUP BY g) l ON l.g = s.g
      LEFT JOIN (SELECT f.g, f.idx, sum(f.value * (1 / (1 + exp(xb - xa)) - (label = 0)::INTEGER)) AS a, sum(f.value * (1 / (1 + exp(xa - xb)) - (label = 1)::INTEGER)) AS b
            FROM (SELECT f.g, f.doc_id, f.step, sum(value * a) AS xa, sum(value * b) AS xb
                  FROM feed f JOIN state w ON w.g = f.g AND w.idx = f.idx AND w.step = f.step GROUP BY f.g, f.doc_id, f.step) x
            JOIN feed f ON f.g = x.g AND f.doc_id = x.doc_id AND f.step = x.step GROUP BY f.g, f.idx) d ON d.g = s.g AND d.idx = s.idx)""",
    "trained AS (SELECT s.*, plan.n, plan.steps FROM state s JOIN plan ON plan.g = s.g AND plan.steps = s.step)",
    "seen AS (SELECT g, count(*) AS seen FROM read GROUP BY g)",
]


def trained_in_batches(spark: SparkSession, sf: str, **options: int) -> DataFrame:
    documents, values = training_inputs(spark, sf)
    rows = cut_lineage(training.training_rows(documents, values, "doc_id", "key", "label"))
    fit = training.Fit(classes=CLASSES, lr=LR, epochs=PASSES, batch_size=SIZE, momentum=MOMENTUM, seed=3, **options)
    return training.train_per_key(rows, training.start_table(rows, None, CLASSES), fit)


@query(with_(BATCHES, f"""
SELECT g AS key, n, steps, {r('loss / seen')} AS train_loss, 1.0::DOUBLE AS keep,
       {r(f'list_sum([{LR} * (1 - pow({MOMENTUM}, t)) / (1 - {MOMENTUM}) FOR t IN range(1, steps + 1)])')} AS drift
FROM trained JOIN seen USING (g) WHERE idx = -1"""))
def train_per_key_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Mini-batches in seeded order."""
    return rounded(training.per_key_stats(trained_in_batches(spark, sf)), "train_loss", "keep", "drift")


@query(with_(BATCHES, f"SELECT g AS key, idx::INTEGER AS idx, steps, {r('a')} AS w_0, {r('b')} AS w_1 FROM trained"))
def train_large_keys_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The weights, in the form of training that takes keys of any size: rows in the order of their steps."""
    trained = trained_in_batches(spark, sf, max_group_rows=0)
    return rounded(trained.select("key", "idx", "steps", "w_0", "w_1"), "w_0", "w_1")


@query(with_([*FEATURES, *start_sql("0"), *step_sql(1), *step_sql(2)], long_sql("w2")))
def train_pooled(spark: SparkSession, sf: str) -> DataFrame:
    documents, values = training_inputs(spark, sf)
    model, _ = training.train_pooled(documents, values, "doc_id", "label", training.Fit(CLASSES, LR), 2)
    return rounded(model, "value")


@query(with_([*FEATURES, *start_sql("0"), *step_sql(1), *step_sql(2)], f"""
SELECT 1 AS round, {LR} ::DOUBLE AS lr, {r('avg(loss)')} AS train_loss, 1::BIGINT AS steps FROM r1
UNION ALL SELECT 2, {LR}::DOUBLE, {r('avg(loss)')}, 1 FROM r2"""))
def train_pooled_history(spark: SparkSession, sf: str) -> DataFrame:
    documents, values = training_inputs(spark, sf)
    _, history = training.train_pooled(documents, values, "doc_id", "label", training.Fit(CLASSES, LR), 2)
    return rounded(history, "train_loss")


HELD_OUT = "k.doc_id % 5 = 0"


@query(with_([*FEATURES, *start_sql("k.key", f"NOT ({HELD_OUT})"), *step_sql(1),
              f"""own AS (
                SELECT k.key, k.doc_id, any_value(k.label) AS label,
                       (any_value(z.b) + coalesce(sum(f.value * w.b), 0) > any_value(z.a) + coalesce(sum(f.value * w.a), 0))::INTEGER AS prediction
                FROM keyed_text k JOIN w1 z ON z.g = k.key AND z.idx = -1 LEFT JOIN features f ON f.doc_id = k.doc_id
                LEFT JOIN w1 w ON w.g = k.key AND w.idx = f.idx WHERE {HELD_OUT} GROUP BY k.key, k.doc_id)""",
              *metrics_sql("own", "key", 2)],
             f"""SELECT s.g AS key, s.n AS n_train, {r('accuracy')} AS accuracy, {r('macro_f1')} AS macro_f1
             FROM sizes s LEFT JOIN measured m ON m.key = s.g"""))
def train_local_only(spark: SparkSession, sf: str) -> DataFrame:
    """One model per key from four fifths of its documents, scored on the rest."""
    documents, values = training_inputs(spark, sf)
    parts = [
        cut_lineage(training.training_rows(documents.where(side), values, "doc_id", "key", "label"))
        for side in (F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 0)
    ]
    results, _ = training.train_local_only(*parts, training.Fit(CLASSES, LR))
    return rounded(
        results.select("key", "n_train", F.col("client_test_accuracy").alias("accuracy"), F.col("client_test_macro_f1").alias("macro_f1")),
        "accuracy", "macro_f1",
    )


# ---- parameter tables

WEIGHTED = """mean AS (
  SELECT layer, class, idx, sum(value * n) / (SELECT sum(n) FROM clients) AS value
  FROM updates JOIN clients USING (client) GROUP BY layer, class, idx)"""
PLAIN = """mean AS (
  SELECT layer, class, idx, sum(value) / (SELECT count(*) FROM clients) AS value FROM updates GROUP BY layer, class, idx)"""


@query(with_([*UPDATES, WEIGHTED], f"SELECT layer, class, idx, {r('value')} AS value FROM mean"))
def weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    long, clients, _ = updates(spark, sf)
    return rounded(params.weighted_average(long, clients), "value")


@query(with_([*UPDATES, PLAIN], f"SELECT layer, class, idx, {r('value')} AS value FROM mean"))
def simple_average(spark: SparkSession, sf: str) -> DataFrame:
    long, clients, _ = updates(spark, sf)
    return rounded(params.simple_average(long, clients), "value")


@query(with_([*UPDATES, WEIGHTED], f"""
SELECT layer, class, idx, {r('p.value + 0.7 * (m.value - p.value)')} AS value FROM params p JOIN mean m USING (layer, class, idx)"""))
def step_fedavg(spark: SparkSession, sf: str) -> DataFrame:
    long, clients, current = updates(spark, sf)
    return rounded(params.step_fedavg(current, params.weighted_average(long, clients), 0.7), "value")


@query(with_([*UPDATES, WEIGHTED,
              """adam AS (
                SELECT layer, class, idx, p.value AS w, 0.9 * 0.01 * p.value + 0.1 * (m.value - p.value) AS m,
                       0.99 * 0.0001 + 0.01 * pow(m.value - p.value, 2) AS v FROM params p JOIN mean m USING (layer, class, idx))"""],
             f"SELECT layer, class, idx, {r('w + 0.1 * m / (sqrt(v) + 0.001)')} AS value, {rs('m', 'v')} FROM adam"))
def step_fedadam(spark: SparkSession, sf: str) -> DataFrame:
    long, clients, current = updates(spark, sf)
    state = current.select("layer", "class", "idx", (F.col("value") * 0.01).alias("m"), F.lit(0.0001).alias("v"))
    return rounded(params.step_fedadam(current, params.weighted_average(long, clients), state, 0.1), "value", "m", "v")


@query(with_([*UPDATES, PLAIN], f"""
SELECT p.layer, p.class, p.idx, {r('p.value + (m.value - p.value)')} AS value,
       {r('0.5 * p.value + (10 / 20.0) * m.value')} AS variate FROM params p JOIN mean m USING (layer, class, idx)"""))
def step_scaffold(spark: SparkSession, sf: str) -> DataFrame:
    """Ten of twenty clients report; their updates serve as changes of the control variates too."""
    long, clients, current = updates(spark, sf)
    variates = current.withColumn("value", F.col("value") * 0.5)
    stepped, moved = params.step_scaffold(current, long, variates, long, clients, 20)
    both = stepped.join(moved.withColumnRenamed("value", "variate"), ["layer", "class", "idx"])
    return rounded(both, "value", "variate")


@query(with_([*UPDATES], "SELECT count(*) AS total_parameters, count(*) * 4 AS bytes_float32 FROM params"))
def parameter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return params.parameter_counts(updates(spark, sf)[2])


# ---- metrics over five classes: order priority against price band

@query(with_([KEYED_LABELS, "cells AS (SELECT t.c AS y_true, p.c AS y_pred FROM range(0, 5) t(c), range(0, 5) p(c))"], """
SELECT s.status, y_true::INTEGER AS y_true, y_pred::INTEGER AS y_pred, count(k.row_id) AS n
FROM cells CROSS JOIN (SELECT DISTINCT status FROM keyed_labels) s
LEFT JOIN keyed_labels k ON k.status = s.status AND k.label = y_true AND k.prediction = y_pred GROUP BY ALL"""))
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(keyed_labels(spark, sf), "label", "prediction", 5, ["status"])


@query(with_([KEYED_LABELS, *metrics_sql("keyed_labels", "status", 5),
              "f1s AS (SELECT status, " + ", ".join(f"max(f1) FILTER (c = {c}) AS f1_{c}" for c in range(5)) + " FROM scores GROUP BY status)"],
             f"SELECT status, n, {rs(*MEASURES, *[f'f1_{c}' for c in range(5)])} FROM measured JOIN f1s USING (status)"))
def classification_metrics(spark: SparkSession, sf: str) -> DataFrame:
    counts = metrics.confusion(keyed_labels(spark, sf), "label", "prediction", 5, ["status"])
    measured = metrics.classification_metrics(counts, 5, ["status"])
    measured = measured.withColumns({f"f1_{c}": F.col("per_class_f1")[c] for c in range(5)}).drop("per_class_f1")
    return rounded(measured, *MEASURES, *[f"f1_{c}" for c in range(5)])


PER_KEY = [KEYED_LABELS, *metrics_sql("keyed_labels", "key", 5)]


def key_scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.per_key_metrics(keyed_labels(spark, sf), "key", "label", "prediction", 5)


@query(with_(PER_KEY, f"SELECT key, n, {rs('accuracy', 'macro_f1')} FROM measured"))
def per_key_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(key_scores(spark, sf), "accuracy", "macro_f1")


def dispersion_sql(value: str) -> str:
    return f"""count({value}) AS count, {r(f'avg({value})')} AS mean, {r(f'median({value})')} AS median,
      {r(f'CASE WHEN count({value}) > 1 THEN stddev_samp({value}) ELSE 0.0 END')} AS std,
      {r(f'quantile_cont({value}, 0.1)')} AS p10, {r(f'min({value})')} AS worst, {r(f'max({value})')} AS best,
      {r(f'quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)')} AS iqr, {r(f'max({value}) - min({value})')} AS spread"""


SPREAD = ("mean", "median", "std", "p10", "worst", "best", "iqr", "spread")


@query(with_(PER_KEY, f"SELECT n, {dispersion_sql('macro_f1')} FROM measured GROUP BY n"))
def dispersion(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of macro F1 over the customers with equally many orders."""
    return rounded(metrics.dispersion(key_scores(spark, sf), "macro_f1", ["n"]), *SPREAD)


SIDES = "sided AS (SELECT *, CASE WHEN status = 'P' THEN 'unseen' ELSE 'seen' END AS side, key || '|' || status AS cell FROM keyed_labels)"


def side_sql(name: str, by: str, classes: int) -> list[str]:
    """Metrics of ``sided`` by ``by``, as tables whose names end in ``name``."""
    renamed = {k: f"{k}_{name}" for k in ("labels_", "groups_", "per_class", "rates", "scores", "macro", "measured")}
    out = []
    for cte in metrics_sql("sided", by, classes):
        for a, b in renamed.items():
            cte = __import__("re").sub(rf"\b{a}\b", b, cte)
        out.append(cte)
    return out


@query(with_([KEYED_LABELS, SIDES, *side_sql("pool", "side", 5), *side_sql("cell", "side, cell", 5),
              f"spread AS (SELECT side, {dispersion_sql('macro_f1')} FROM measured_cell GROUP BY side)",
              "s AS (SELECT * FROM measured_pool JOIN spread USING (side) WHERE side = 'seen')",
              "u AS (SELECT * FROM measured_pool JOIN spread USING (side) WHERE side = 'unseen')"],
             "SELECT " + ", ".join(
                 f"{t}.n AS {name}_n, {t}.count AS {name}_key_count, " + ", ".join(
                     f"{r(f'{t}.{c}')} AS {name}_{c}" for c in ("accuracy", "macro_f1")) + ", " + ", ".join(
                     f"{r(f'{t}.{c}')} AS {name}_key_{c}" for c in SPREAD)
                 for t, name in (("s", "seen"), ("u", "unseen")))
             + f", {r('s.macro_f1 - u.macro_f1')} AS gap_macro_f1, {r('s.accuracy - u.accuracy')} AS gap_accuracy FROM s, u"))
def generalization_report(spark: SparkSession, sf: str) -> DataFrame:
    """Pending orders play the unseen side; a key is a customer within one status."""
    side = F.when(F.col("status") == "P", "unseen").otherwise("seen")
    rows = keyed_labels(spark, sf).withColumn("side", side).withColumn("cell", F.concat_ws("|", "key", "status"))
    report = metrics.generalization_report(rows, "cell", "side", "label", "prediction", 5)
    return rounded(report, *[c for c, kind in report.dtypes if kind == "double"])


HISTORY = [
    MESSAGES,
    """sent AS (
      SELECT run, round, sum(bytes)::BIGINT AS bytes, avg(value) / 100 AS metric FROM messages GROUP BY run, round)""",
    "history AS (SELECT *, sum(bytes) OVER (PARTITION BY run ORDER BY round)::BIGINT AS cum FROM sent)",
    """streaks AS (
      SELECT *, min((metric >= 0.5)::INTEGER) OVER ahead = 1 AND count(*) OVER ahead = 3 AS hit FROM history
      WINDOW ahead AS (PARTITION BY run ORDER BY round ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))""",
    "reached AS (SELECT run, min(round) FILTER (hit) AS rounds_to_target FROM streaks GROUP BY run)",
]


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Days as rounds: the mean event value as the metric, all bytes so far as the cost."""
    sent = messages(spark, sf)
    ledger = round_ledger(sent, ["run"], "round").select("run", "round", F.col("cum_total_bytes").alias("cum"))
    metric = sent.groupBy("run", "round").agg((F.avg("value") / 100).alias("metric"))
    return ledger.join(metric, ["run", "round"])


@query(with_(HISTORY, "SELECT run, rounds_to_target FROM reached"))
def rounds_to_target(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rounds_to_target(history(spark, sf), ["run"], "round", "metric", 0.5, 3)


@query(with_(HISTORY, """
SELECT r.run, r.rounds_to_target, h.cum AS bytes_to_target FROM reached r
LEFT JOIN history h ON h.run = r.run AND h.round = r.rounds_to_target"""))
def bytes_to_target(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bytes_to_target(history(spark, sf), ["run"], "round", "metric", "cum", 0.5, 3)
