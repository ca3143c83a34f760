"""Softmax regression per key and over the pooled table.

A document's features are long rows ``(doc, idx, value)``; the bias is the feature ``BIAS`` with value 1. A key's update
lists only the features the key uses. Every other parameter follows a rule without data (it shrinks by ``keep`` and
moves by ``drift`` times the control variate), so it is never written out per key.

Full batches (the default) are trained by Spark aggregations over all keys at once, a fixed number of jobs per step however
large a key is. Mini-batches are numbered by the hash order of a key's documents in Spark: the step table says which
document is read in which step. Batches of many documents are Spark steps as well. The small steps of a key follow one
another, so they run in one task: in a grouped map if the key's rows are few; otherwise the rows arrive sorted by step and
the task holds weights and one gradient of the key, never its rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from keyloom.functions.ordering import attach, hash_rank
from keyloom.operators.metrics import classification_metrics, confusion, dispersion
from keyloom.operators.scoring import predict
from keyloom.session import cut_lineage, ship_with_tasks

ship_with_tasks(sys.modules[__name__])

BIAS = -1
# Features of a pooled model whose weights are sent to all tasks, and come back as one gradient.
MOST_WEIGHTS = 200_000


@dataclass(frozen=True)
class Fit:
    """Settings of local training; ``batch_size=None`` takes all rows of the key in every step.

    ``max_group_rows``: feature rows of a key that one task may hold when ``batch_size`` is set; larger keys are streamed.
    ``wide_batch``: batches of at least so many documents are computed by Spark, one step at a time for all keys.
    """

    classes: int
    lr: float
    epochs: float = 1.0
    batch_size: int | None = None
    momentum: float = 0.0
    weight_decay: float = 0.0
    mu: float = 0.0
    seed: object = 0
    max_group_rows: int = 2_000_000
    wide_batch: int = 100_000


def _columns(prefix: str, classes: int) -> list[str]:
    return [f"{prefix}_{c}" for c in range(classes)]


def training_rows(documents: DataFrame, features: DataFrame, doc: str, key: str, label: str, extra: Sequence[str] = ()) -> DataFrame:
    """``(key, doc, label, idx, value)`` with one bias row per document, so documents without features count."""
    docs = documents.select(F.col(key).alias("key"), F.col(doc).alias("doc"), F.col(label).alias("label"), *extra)
    rows = docs.join(features.select(F.col(doc).alias("doc"), "idx", "value"), "doc")
    bias = docs.withColumn("idx", F.lit(BIAS)).withColumn("value", F.lit(1.0))
    return rows.unionByName(bias)


def start_table(rows: DataFrame, params: DataFrame | None, classes: int, variates: DataFrame | None = None,
                local: DataFrame | None = None) -> DataFrame:
    """Per key and used feature: start weights ``w_c``, global variates ``g_c`` and the key's own ``l_c``."""
    start = rows.select("key", "idx").distinct()
    for table, prefix, on in ((params, "w", ["idx"]), (variates, "g", ["idx"]), (local, "l", ["key", "idx"])):
        names = _columns(prefix, classes)
        if table is not None:
            start = start.join(table.select(*on, *names), on, "left")
        start = start.withColumns({n: F.coalesce(n, F.lit(0.0)) if table is not None else F.lit(0.0) for n in names})
    return start


def to_wide(params: DataFrame, classes: int, prefix: str = "w") -> DataFrame:
    """Parameter table as ``(idx, w_0, ..)`` with the bias at index ``BIAS``."""
    idx = F.when(F.col("layer") == "bias", F.lit(BIAS)).otherwise(F.col("idx")).cast("int")
    sums = [F.sum(F.when(F.col("class") == c, F.col("value")).otherwise(0.0)).alias(f"{prefix}_{c}") for c in range(classes)]
    return params.groupBy(idx.alias("idx")).agg(*sums)


def to_long(wide: DataFrame, classes: int, prefix: str = "w", keep: Sequence[str] = ()) -> DataFrame:
    """Inverse of :func:`to_wide`."""
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"{prefix}_{c}").alias("value")) for c in range(classes)])
    layer = F.when(F.col("idx") == BIAS, "bias").otherwise("weight")
    idx = F.when(F.col("idx") == BIAS, 0).otherwise(F.col("idx")).cast("int")
    rows = wide.select(*keep, layer.alias("layer"), idx.alias("idx"), F.explode(cells).alias("c"))
    return rows.select(*keep, "layer", F.col("c.class").alias("class"), "idx", F.col("c.value").alias("value"))


def _untouched(steps: int, fit: Fit) -> tuple[float, float]:
    """How a parameter without data moves in ``steps`` steps: factor on its start, factor on the variate."""
    keep, drift, keep_speed, drift_speed = 1.0, 0.0, 0.0, 0.0
    for _ in range(steps):
        keep_speed = fit.momentum * keep_speed + fit.weight_decay * keep + fit.mu * (keep - 1.0)
        drift_speed = fit.momentum * drift_speed + 1.0 - (fit.weight_decay + fit.mu) * drift
        keep, drift = keep - fit.lr * keep_speed, drift + fit.lr * drift_speed
    return keep, drift


def _pass_order(doc_ids: Sequence, seed: object, number: int) -> np.ndarray:
    digests = [hashlib.md5(f"{seed}|{number}|{d}".encode()).hexdigest() for d in doc_ids]
    return np.array(sorted(range(len(doc_ids)), key=lambda i: (digests[i], doc_ids[i])))


def _result_schema(rows: DataFrame, classes: int) -> str:
    key_type = dict(rows.dtypes)["key"]
    numbers = ", ".join(f"{name} double" for c in range(classes) for name in (f"d_{c}", f"w_{c}"))
    return f"key {key_type}, idx int, n long, steps long, train_loss double, keep double, drift double, {numbers}"


def _fit_grouped(rows: DataFrame, start: DataFrame, fit: Fit) -> DataFrame:
    def run(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        return _fit_group(pdf, begin, fit)

    # both sides come from the same rows: renaming gives the start table columns of its own
    grouped = rows.groupBy("key").cogroup(start.toDF(*start.columns).groupBy("key"))
    return grouped.applyInPandas(run, _result_schema(rows, fit.classes))


def _sized(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A written table, broadcast if it has few rows; beyond that Spark joins it, and adaptive execution splits hot keys."""
    return F.broadcast(df) if df.count() <= most_rows else df


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents, one row each, and their feature rows, both dealt out by key and document and written once."""
    dealt = rows.repartition("key", "doc")
    documents = dealt.where(F.col("idx") == BIAS).drop("idx", "value")
    return cut_lineage(documents), cut_lineage(dealt.where(F.col("idx") != BIAS).select("key", "doc", "idx", "value"))


def _logits(documents: DataFrame, features: DataFrame, weights: DataFrame, classes: int) -> DataFrame:
    """``documents`` with ``x_c``: the score by the weights of their own key; features without a weight count as 0.

    The bias meets documents by key, apart from the features, so it adds no row that all documents share.
    """
    names = [f"w_{c}" for c in range(classes)]
    inner = weights.where(F.col("idx") != BIAS).select("key", "idx", *names)
    bias = weights.where(F.col("idx") == BIAS).select("key", *[F.col(w).alias(f"bias_{w}") for w in names])
    sums = features.join(_sized(inner), ["key", "idx"]).groupBy("key", "doc").agg(
        *[F.sum(F.col("value") * F.col(f"w_{c}")).alias(f"s_{c}") for c in range(classes)]
    )
    scored = documents.join(sums, ["key", "doc"], "left").join(_sized(bias), "key")
    totals = [(F.coalesce(f"s_{c}", F.lit(0.0)) + F.col(f"bias_w_{c}")).alias(f"x_{c}") for c in range(classes)]
    return scored.select(*documents.columns, *totals)


def step_table(documents: DataFrame, fit: Fit) -> DataFrame:
    """``(key, doc, step)``: the step, counted from 0, in which a key reads a document; one row for each pass that reads it.

    A pass takes the key's documents in the hash order of seed, pass and document, ``batch_size`` at a time, the last batch
    with what is left. A key has ``round(epochs * batches)`` steps, one at least, so that its last pass may be cut short.
    """
    narrow, tables = documents.select("key", "doc"), []
    for number in range(max(1, math.ceil(fit.epochs))):
        ranked = hash_rank(narrow, ["key"], ["doc"], f"{fit.seed}|{number}", "__rank", "__n")
        batches = F.ceil(F.col("__n") / fit.batch_size)
        step = (F.floor((F.col("__rank") - 1) / fit.batch_size) + number * batches).cast("long")
        total = F.greatest(F.lit(1), F.rint(F.lit(float(fit.epochs)) * batches)).cast("long")
        tables.append(ranked.select("key", "doc", step.alias("step"), total.alias("total")).where("step < total").drop("total"))
    return cut_lineage(reduce(DataFrame.unionByName, tables))


def fit_stepwise(rows: DataFrame, start: DataFrame, fit: Fit, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Steps for all keys at once, full batches or those of :func:`step_table`; same result as the grouped map.

    ``parts``: the rows as :func:`_parted` has written them, if they are trained on several times.

    A step scores documents, writes their residuals, and adds up one gradient per key and feature from partial sums. Its
    number of jobs does not depend on the data, and weights are written after every step. A key that has no more
    batches keeps its weights.
    """
    classes = range(fit.classes)
    documents, features = parts or _parted(rows)
    state = start.withColumns({f"b_{c}": F.col(f"w_{c}") for c in classes}).withColumns({f"v_{c}": F.lit(0.0) for c in classes})
    state = cut_lineage(state.withColumn("loss_sum", F.lit(0.0)))
    sizes = documents.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if fit.batch_size:
        turns = step_table(documents, fit)
        taken = turns.groupBy("key").agg(F.count(F.lit(1)).alias("seen"), (F.max("step") + 1).alias("steps"))
        sizes = cut_lineage(attach(sizes, taken, ["key"], "inner"))
        steps = sizes.agg(F.max("steps")).first()[0] or 0
    else:
        steps = max(1, int(round(fit.epochs)))
        sizes = cut_lineage(sizes.withColumns({"seen": F.col("n") * steps, "steps": F.lit(steps).cast("long")}))
    for step in range(steps):
        members = attach(documents, turns.where(F.col("step") == step).drop("step"), ["key", "doc"], "left_semi") if fit.batch_size else documents
        scored = _logits(members, features, state, fit.classes)
        if "offset" in documents.columns:
            scored = scored.withColumns({f"x_{c}": F.col(f"x_{c}") + F.col("offset")[c] for c in classes})
        odds = [F.exp(F.col(f"x_{c}") - F.greatest(*[f"x_{d}" for d in classes])) for c in classes]
        total = sum(odds[1:], odds[0])
        own = sum((F.when(F.col("label") == c, odds[c]).otherwise(0.0) for c in classes[1:]), F.when(F.col("label") == 0, odds[0]).otherwise(0.0))
        shares = [(odds[c] / total - F.when(F.col("label") == c, 1.0).otherwise(0.0)).alias(f"r_{c}") for c in classes]
        residual = cut_lineage(scored.select("key", "doc", (-F.log(own / total)).alias("loss"), *shares))
        pulls = features.join(residual, ["key", "doc"]).groupBy("key", "idx").agg(
            *[F.sum(F.col("value") * F.col(f"r_{c}")).alias(f"p_{c}") for c in classes]
        )
        per_key = residual.groupBy("key").agg(*[F.sum(f"r_{c}").alias(f"p_{c}") for c in classes], F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("m"))
        biases = per_key.select("key", F.lit(BIAS).alias("idx"), *[f"p_{c}" for c in classes])
        moved = state.join(pulls.unionByName(biases), ["key", "idx"], "left").join(per_key.select("key", "loss", "m"), "key", "left")
        speed, weight = {}, {}
        for c in classes:
            w, v = F.col(f"w_{c}"), F.col(f"v_{c}")
            gradient = (
                F.coalesce(f"p_{c}", F.lit(0.0)) / F.col("m") + fit.mu * (w - F.col(f"b_{c}"))
                + (F.col(f"g_{c}") - F.col(f"l_{c}")) + fit.weight_decay * w
            )
            active = F.col("m").isNotNull()
            speed[c] = F.when(active, fit.momentum * v + gradient).otherwise(v)
            weight[c] = F.when(active, w - fit.lr * speed[c]).otherwise(w)
        state = cut_lineage(
            moved.select(
                "key", "idx", *[f"{p}_{c}" for p in "gl" for c in classes], *[f"b_{c}" for c in classes],
                *[weight[c].alias(f"w_{c}") for c in classes], *[speed[c].alias(f"v_{c}") for c in classes],
                (F.col("loss_sum") + F.coalesce("loss", F.lit(0.0))).alias("loss_sum"),
            )
        )
    closed = sizes.select("steps").distinct().collect()  # numbers of steps, not keys
    keep = _lookup("steps", {r["steps"]: _untouched(r["steps"], fit)[0] for r in closed})
    drift = _lookup("steps", {r["steps"]: _untouched(r["steps"], fit)[1] for r in closed})
    done = state.join(sizes, "key").withColumns({"keep": keep, "drift": drift})
    deltas = [(F.col(f"w_{c}") - (F.col("keep") * F.col(f"b_{c}") - F.col("drift") * F.col(f"g_{c}"))).alias(f"d_{c}") for c in classes]
    interleaved = [col for c in classes for col in (deltas[c], F.col(f"w_{c}"))]
    return done.select("key", "idx", "n", "steps", (F.col("loss_sum") / F.col("seen")).alias("train_loss"), "keep", "drift", *interleaved)


def _lookup(column: str, values: dict) -> Column:
    cells = [F.lit(x) for pair in values.items() for x in pair]
    return F.element_at(F.create_map(*cells), F.col(column).cast("int")) if cells else F.lit(None).cast("double")


class _Rest:
    """Steps of a parameter whose gradient has no data: speed and weight after any number of them, by powers of one matrix.

    Such a step is linear, with one matrix for all parameters and one constant for each; powers are kept and doubled.
    """

    def __init__(self, fit: Fit):
        pull = fit.mu + fit.weight_decay
        self.once = np.array([[fit.momentum, pull], [-fit.lr * fit.momentum, 1.0 - fit.lr * pull]])
        self.push = np.array([1.0, -fit.lr])
        self.powers, self.sums = np.eye(2)[None], np.zeros((1, 2))

    def after(self, steps: np.ndarray, speed: np.ndarray, weight: np.ndarray, constant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        while len(self.powers) <= steps.max(initial=0):
            power, total = self.powers[-1] @ self.once, self.sums[-1] + self.powers[-1] @ self.push
            self.sums = np.concatenate([self.sums, self.sums + self.powers @ total])
            self.powers = np.concatenate([self.powers, self.powers @ power])
        p, q = self.powers[steps], self.sums[steps]
        return tuple(p[:, i, 0, None] * speed + p[:, i, 1, None] * weight + q[:, i, None] * constant for i in (0, 1))


class _InOrder:
    """Training of one key whose rows come in the order of steps: weights, and the gradient of the step at hand.

    A step touches the parameters of its own documents. The others have moved by rule when they are read next, see
    :class:`_Rest`, so that a step's work does not grow with the number of features of the key.
    """

    def __init__(self, key: object, fit: Fit):
        self.key, self.fit = key, fit
        self.idx: np.ndarray = np.zeros(0, np.int64)
        self.begin = self.variate = self.own = np.zeros((0, fit.classes))
        self.step, self.members, self.moves = -1, 0, 0
        self.loss, self.seen = 0.0, 0
        self.rest, self.pulls = _Rest(fit), []

    def open(self, idx: np.ndarray, values: np.ndarray) -> None:
        """More start rows, with begin, variate and own variate for each class; they come before all steps, by idx."""
        c = self.fit.classes
        self.idx = np.concatenate([self.idx, idx])
        self.begin, self.variate, self.own = (np.concatenate([old, values[:, k * c : (k + 1) * c]]) for k, old in enumerate((self.begin, self.variate, self.own)))
        self.weights, self.speed = self.begin.copy(), np.zeros_like(self.begin)
        self.constant = self.variate - self.own - self.fit.mu * self.begin
        self.moved = np.zeros(len(self.idx), np.int64)

    def _catch_up(self, places: np.ndarray) -> None:
        places = places[self.moved[places] < self.moves]
        if len(places):
            behind = self.moves - self.moved[places]
            self.speed[places], self.weights[places] = self.rest.after(behind, self.speed[places], self.weights[places], self.constant[places])
            self.moved[places] = self.moves

    def _move(self) -> None:
        if not self.members:
            return
        places, inverse = np.unique(np.concatenate([at for at, _ in self.pulls]), return_inverse=True)
        pulls = np.concatenate([pull for _, pull in self.pulls])
        pull = np.stack([np.bincount(inverse, pulls[:, c], len(places)) for c in range(self.fit.classes)], axis=1)
        weights = self.weights[places]
        gradient = pull / self.members + self.constant[places] + (self.fit.mu + self.fit.weight_decay) * weights
        self.speed[places] = self.fit.momentum * self.speed[places] + gradient
        self.weights[places] = weights - self.fit.lr * self.speed[places]
        self.moves += 1
        self.moved[places] = self.moves
        self.members, self.pulls = 0, []

    def read(self, step: int, doc: np.ndarray, label: np.ndarray, idx: np.ndarray, value: np.ndarray, offset: np.ndarray) -> None:
        """Whole documents of one step; ``doc`` numbers them from 0, ``label`` and ``offset`` have one row for each."""
        if step != self.step:
            self._move()
            self.step = step
        n, at = len(label), np.searchsorted(self.idx, idx)
        self._catch_up(np.unique(at))
        contribution = value[:, None] * self.weights[at]
        logits = np.stack([np.bincount(doc, contribution[:, c], n) for c in range(self.fit.classes)], axis=1) + offset
        logits -= logits.max(axis=1, keepdims=True)
        share = np.exp(logits)
        share /= share.sum(axis=1, keepdims=True)
        self.loss -= float(np.log(share[np.arange(n), label]).sum())
        share[np.arange(n), label] -= 1.0
        self.pulls.append((at, value[:, None] * share[doc]))
        self.members += n
        self.seen += n

    def result(self, sizes: int) -> dict[str, object]:
        self._move()
        self._catch_up(np.arange(len(self.idx)))
        total = self.step + 1
        keep, drift = _untouched(total, self.fit)
        out = {"key": [self.key] * len(self.idx), "idx": self.idx, "n": sizes, "steps": total, "train_loss": self.loss / self.seen, "keep": keep, "drift": drift}
        for c in range(self.fit.classes):
            out[f"d_{c}"] = self.weights[:, c] - (keep * self.begin[:, c] - drift * self.variate[:, c])
            out[f"w_{c}"] = self.weights[:, c]
        return out


def _fit_group(rows: pd.DataFrame, start: pd.DataFrame, fit: Fit) -> pd.DataFrame:
    """Mini-batch SGD for the rows of one key: sorted by batch once for each pass, so that a step reads its own rows only."""
    classes = fit.classes
    doc_ids, first, doc = np.unique(rows["doc"].to_numpy(), return_index=True, return_inverse=True)
    start = start.sort_values("idx")
    idx, value, label = rows["idx"].to_numpy(), rows["value"].to_numpy(np.float64), rows["label"].to_numpy()[first]
    offset = np.stack(rows["offset"].to_numpy()[first]) if "offset" in rows else np.zeros((len(doc_ids), classes))
    state = _InOrder(rows["key"].iloc[0], fit)
    state.open(start["idx"].to_numpy(), start[[*_columns("w", classes), *_columns("g", classes), *_columns("l", classes)]].to_numpy(np.float64))
    n = len(doc_ids)
    size = fit.batch_size or n
    batches = -(-n // size)
    total = max(1, int(round(fit.epochs * batches)))
    for number in range(-(-total // batches)):
        order = _pass_order(doc_ids.tolist(), fit.seed, number) if fit.batch_size else np.arange(n)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        at = np.argsort(place[doc], kind="stable")
        ends = np.searchsorted(place[doc][at], np.arange(0, n + size, size))
        for turn in range(min(batches, total - number * batches)):
            used = at[ends[turn] : ends[turn + 1]]
            members = order[turn * size : (turn + 1) * size]
            state.read(number * batches + turn, place[doc[used]] - turn * size, label[members], idx[used], value[used], offset[members])
    return pd.DataFrame(state.result(n))


def fit_in_order(rows: DataFrame, start: DataFrame, fit: Fit) -> DataFrame:
    """Mini-batch steps of keys of any size: rows sorted by key and step pass through tasks that hold one key's weights.

    Same result as the grouped map. A task reads each of its keys' rows once per pass, in Arrow batches; of the rows it
    holds one batch and the document that goes on in the next.
    """
    classes = fit.classes
    documents = cut_lineage(rows.where(F.col("idx") == BIAS).select("key", "doc"))
    counts = documents.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    begin = F.array(*[F.col(f"{p}_{c}") for p in "wgl" for c in range(classes)])
    offset = F.col("offset") if "offset" in rows.columns else F.array(*[F.lit(0.0)] * classes)
    doc_type = dict(rows.dtypes)["doc"]
    read = attach(rows, step_table(documents, fit), ["key", "doc"], "inner")
    read = read.select("key", "step", "doc", F.col("label").cast("int").alias("label"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"),
                       offset.alias("numbers"), F.lit(0).cast("long").alias("n"))
    opened = attach(start, counts, ["key"], "inner").select(
        "key", F.lit(-1).cast("long").alias("step"), F.lit(None).cast(doc_type).alias("doc"), F.lit(0).alias("label"), F.col("idx").cast("long").alias("idx"),
        F.lit(0.0).alias("value"), begin.alias("numbers"), "n")
    ordered = read.unionByName(opened).repartition("key").sortWithinPartitions("key", "step", "doc", "idx")
    schema = _result_schema(rows, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _InOrder | None = None
        size, carried = 0, None

        def parts(last: bool, table: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """Rows of one key and step each, whole documents only; what may go on is carried over."""
            nonlocal carried
            if carried is not None:
                table = pd.concat([carried, table], ignore_index=True)
                carried = None
            if not len(table):
                return
            same = [(table[c] == table[c].shift()) | (table[c].isna() & table[c].shift().isna()) for c in ("key", "step", "doc")]
            same[0].iloc[0] = False
            block = (~(same[0] & same[1])).cumsum().to_numpy()
            table["__doc"] = (~(same[0] & same[1] & same[2])).cumsum().to_numpy()
            whole = len(table)
            if not last and table["step"].iloc[-1] >= 0:
                whole = int(np.searchsorted(table["__doc"].to_numpy(), table["__doc"].iloc[-1]))
                carried = table.iloc[whole:].drop(columns="__doc")
            for places in np.split(np.arange(whole), np.flatnonzero(np.diff(block[:whole])) + 1):
                if len(places):
                    yield table.iloc[places[0] : places[-1] + 1]

        def answer() -> pa.RecordBatch:
            made = pd.DataFrame(state.result(size))
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type, from_pandas=f.name == "key") for f in result], [f.name for f in result])

        def feed(part: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            nonlocal state, size
            key, step = part["key"].iloc[0], int(part["step"].iloc[0])
            fresh = state is None or not (key == state.key or (pd.isna(key) and pd.isna(state.key)))
            if fresh:
                if state is not None:
                    yield answer()
                state = _InOrder(None if pd.isna(key) else key, fit)
            numbers = part["numbers"].to_numpy()
            if step < 0:
                size = int(part["n"].iloc[0])
                state.open(part["idx"].to_numpy(), np.stack(numbers))
                return
            doc = part["__doc"].to_numpy()
            first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
            state.read(step, doc - doc[0], part["label"].to_numpy()[first], part["idx"].to_numpy(), part["value"].to_numpy(), np.stack(numbers[first]))

        names = None
        for batch in batches:
            names = batch.schema
            for part in parts(False, batch.to_pandas()):
                yield from feed(part)
        if names is not None:
            for part in parts(True, names.empty_table().to_pandas()):
                yield from feed(part)
        if state is not None:
            yield answer()

    result = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    return ordered.mapInArrow(run, schema)


def packed_documents(rows: DataFrame) -> DataFrame:
    """One row per document, (key, doc, label, idx, value, ..) with its features as arrays, dealt out by document and written once."""
    extra = [c for c in rows.columns if c not in ("key", "doc", "label", "idx", "value")]
    cells = F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value")))  # of one document
    packed = rows.groupBy("key", "doc").agg(F.first("label").cast("int").alias("label"), cells.alias("cells"), *[F.first(c).alias(c) for c in extra])
    return cut_lineage(packed.select("key", "doc", "label", F.col("cells.idx").alias("idx"), F.col("cells.value").alias("value"), *extra))


def fit_blocks(packed: DataFrame, start: DataFrame, fit: Fit) -> DataFrame:
    """Full-batch steps of the one key of ``packed``; same result as :func:`fit_stepwise`.

    Weights go to all tasks. A task adds up the gradient of its documents and sends one row per feature that they use, so a
    step reads the features once and shuffles partial gradients only. For models of ``MOST_WEIGHTS`` features at most.
    """
    classes, steps = fit.classes, max(1, int(round(fit.epochs)))
    spark = packed.sparkSession
    begin = start.orderBy("idx").toPandas()  # MOST_WEIGHTS rows at most
    idx = begin["idx"].to_numpy(np.int64)
    first, variate, own = (begin[_columns(p, classes)].to_numpy(np.float64) for p in "wgl")
    weights, speed, loss_sum, n = first.copy(), np.zeros_like(first), 0.0, 0
    offsets = "offset" in packed.columns
    sums = ", ".join(f"p_{c} double" for c in range(classes))

    def gradients(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idx, weights = shared.value
            pull, loss, members = np.zeros_like(weights), 0.0, 0
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                lists = batch.column("idx")
                doc = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                at = np.searchsorted(idx, lists.flatten().to_numpy(zero_copy_only=False))
                value = batch.column("value").flatten().to_numpy(zero_copy_only=False)
                label = batch.column("label").to_numpy(zero_copy_only=False)
                contribution = value[:, None] * weights[at]
                logits = np.stack([np.bincount(doc, contribution[:, c], n) for c in range(classes)], axis=1)
                if offsets:
                    logits += batch.column("offset").flatten().to_numpy(zero_copy_only=False).reshape(n, classes)
                logits -= logits.max(axis=1, keepdims=True)
                share = np.exp(logits)
                share /= share.sum(axis=1, keepdims=True)
                loss -= float(np.log(share[np.arange(n), label]).sum())
                share[np.arange(n), label] -= 1.0
                moved = value[:, None] * share[doc]
                for c in range(classes):
                    pull[:, c] += np.bincount(at, moved[:, c], len(idx))
                members += n
            used = np.flatnonzero(pull.any(axis=1))
            place = np.append(used, -1)  # the last row has the loss and the number of documents
            last = (loss, float(members))
            columns = [np.append(pull[used, c], last[c] if c < 2 else 0.0) for c in range(classes)]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *map(pa.array, columns)], ["place", *(f"p_{c}" for c in range(classes))])

        return packed.mapInArrow(run, f"place long, {sums}")

    for _ in range(steps):
        shared = spark.sparkContext.broadcast((idx, weights))
        added = gradients(shared).groupBy("place").agg(*[F.sum(f"p_{c}").alias(f"p_{c}") for c in range(classes)]).toPandas()
        shared.unpersist()
        counted = added["place"] < 0
        loss_sum += float(added.loc[counted, "p_0"].sum())
        n = round(float(added.loc[counted, "p_1"].sum()))
        pull = np.zeros_like(weights)
        pull[added.loc[~counted, "place"].to_numpy()] = added.loc[~counted, _columns("p", classes)].to_numpy()
        gradient = pull / max(n, 1) + fit.mu * (weights - first) + variate - own + fit.weight_decay * weights
        speed = fit.momentum * speed + gradient
        weights = weights - fit.lr * speed
    keep, drift = _untouched(steps, fit)
    out = pd.DataFrame({"key": begin["key"], "idx": idx.astype(np.int32), "n": n, "steps": steps, "train_loss": loss_sum / max(n * steps, 1), "keep": keep, "drift": drift})
    for c in range(classes):
        out[f"d_{c}"] = weights[:, c] - (keep * first[:, c] - drift * variate[:, c])
        out[f"w_{c}"] = weights[:, c]
    return spark.createDataFrame(out, _result_schema(packed, classes))


def train_per_key(rows: DataFrame, start: DataFrame, fit: Fit) -> DataFrame:
    """Trains every key from its start weights.

    Returns one row per key and used feature: final weights ``w_c``, change ``d_c`` against the rule for unused
    parameters, and on each row the key's ``n``, ``steps``, ``train_loss``, ``keep`` and ``drift``. Keys of any size are
    trained: in Spark steps (no ``batch_size``, or at least ``wide_batch``), in a grouped map (keys of ``max_group_rows``
    rows at most), or in order of their steps.
    """
    if not fit.batch_size or fit.batch_size >= fit.wide_batch:
        return fit_stepwise(rows, start, fit)
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > fit.max_group_rows).select("key")
    large = cut_lineage(large)
    if large.isEmpty():
        return _fit_grouped(rows, start, fit)
    grouped = _fit_grouped(attach(rows, large, ["key"], "left_anti"), attach(start, large, ["key"], "left_anti"), fit)
    return grouped.unionByName(fit_in_order(attach(rows, large, ["key"], "left_semi"), attach(start, large, ["key"], "left_semi"), fit))


def per_key_stats(trained: DataFrame) -> DataFrame:
    """One row per trained key."""
    return trained.where(F.col("idx") == BIAS).select("key", "n", "steps", "train_loss", "keep", "drift")


def train_pooled(
    documents: DataFrame, features: DataFrame, doc: str, label: str, fit: Fit, epochs: int, lr_decay: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """One model on all rows: its parameter table and one history row per epoch.

    Features stay where they are, packed by document; see :func:`fit_blocks`. A model of more than ``MOST_WEIGHTS`` features
    is trained by :func:`fit_stepwise`. Rows, their parts and the features in use are written once for all epochs.
    """
    pooled = documents.withColumn("__all", F.lit(0))
    rows = training_rows(pooled, features, doc, "__all", label)
    rows = cut_lineage(rows)
    used = cut_lineage(rows.select("key", F.col("idx").cast("int").alias("idx")).distinct())
    blocks = fit.classes >= 2 and 0 < used.count() <= MOST_WEIGHTS
    packed, parts = (packed_documents(rows), None) if blocks else (None, _parted(rows))
    weights, history = None, None
    for epoch in range(1, epochs + 1):
        now = replace(fit, epochs=1.0, lr=fit.lr * lr_decay ** (epoch - 1), seed=f"{fit.seed}|{epoch}")
        start = start_table(used, weights, fit.classes)
        trained = cut_lineage(fit_blocks(packed, start, now) if blocks else fit_stepwise(rows, start, now, parts))
        weights = trained.select("idx", *_columns("w", fit.classes))
        row = per_key_stats(trained).select(F.lit(epoch).alias("round"), F.lit(now.lr).alias("lr"), "train_loss", "steps")
        history = row if history is None else history.unionByName(row)
    return to_long(weights, fit.classes), history


def score_own_rows(rows: DataFrame, trained: DataFrame, classes: int) -> DataFrame:
    """Every document of a trained key scored by its key's model: ``(key, doc, label, logits)``.

    Features the key never saw in training have weight 0 in a model started from zero.
    """
    documents, features = _parted(rows)
    scored = _logits(documents, features, cut_lineage(trained.select("key", "idx", *_columns("w", classes))), classes)
    return scored.select("key", "doc", "label", F.array(*[f"x_{c}" for c in range(classes)]).alias("logits"))


def train_local_only(train: DataFrame, own_test: DataFrame, fit: Fit) -> tuple[DataFrame, DataFrame]:
    """An independent model per key, started from zero, tested on the key's own rows: per-key results and their spread.

    ``train`` and ``own_test`` come from :func:`training_rows`. To test one model on rows of other keys, score them with
    that model; all rows by all models would be keys times documents.
    """
    trained = cut_lineage(train_per_key(train, start_table(train, None, fit.classes), fit))
    results = per_key_stats(trained).select("key", F.col("n").alias("n_train"), "train_loss")
    predicted = predict(score_own_rows(own_test, trained, fit.classes))
    counts = confusion(predicted, "label", "prediction", fit.classes, ["key"])
    measured = classification_metrics(counts, fit.classes, ["key"]).select(
        "key", F.col("accuracy").alias("client_test_accuracy"), F.col("macro_f1").alias("client_test_macro_f1")
    )
    spreads = None
    for metric in ("accuracy", "macro_f1"):
        spread = dispersion(measured, f"client_test_{metric}").withColumn("metric", F.lit(f"client_test_{metric}"))
        spreads = spread if spreads is None else spreads.unionByName(spread)
    return results.join(measured, "key", "left"), spreads
