"""Confusion counts, classification metrics, dispersion over keys, and convergence to a target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.ordering import attach, percentiles


def confusion(df: DataFrame, truth: str, predicted: str, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Every (true, predicted) pair with its count per ``keys`` group, zeros included.

    Pairs that occur are counted; a group's counts then fill its table of ``classes`` x ``classes`` pairs. Values that are no
    class are left out.
    """
    keys = list(keys)
    known = F.col(truth).between(0, classes - 1) & F.col(predicted).between(0, classes - 1)
    place = F.when(known, F.col(truth) * classes + F.col(predicted)).cast("int").alias("__place")
    pairs = df.groupBy(*keys, place).agg(F.count(F.lit(1)).alias("__n"))
    seen = F.collect_list(F.when(F.col("__place").isNotNull(), F.struct("__place", "__n")))  # one entry per pair
    groups = pairs.groupBy(*keys).agg(F.map_from_entries(seen).alias("__seen"))
    cells = F.explode(F.sequence(F.lit(0), F.lit(classes * classes - 1))).alias("__cell")
    return groups.select(*keys, "__seen", cells).select(
        *keys, F.floor(F.col("__cell") / classes).cast("int").alias("y_true"), (F.col("__cell") % classes).alias("y_pred"),
        F.coalesce(F.element_at("__seen", F.col("__cell")), F.lit(0).cast("long")).alias("n"),
    )


def classification_metrics(confused: DataFrame, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1 from confusion counts, per ``keys`` group.

    Macro averages run over the classes that occur in the truth; a class never predicted or never right counts 0.
    """
    sums = []
    for c in range(classes):
        is_true, is_pred = F.col("y_true") == c, F.col("y_pred") == c
        sums += [
            F.sum(F.when(is_true & is_pred, F.col("n")).otherwise(0)).alias(f"__hit_{c}"),
            F.sum(F.when(is_true, F.col("n")).otherwise(0)).alias(f"__true_{c}"),
            F.sum(F.when(is_pred, F.col("n")).otherwise(0)).alias(f"__pred_{c}"),
        ]
    rows = confused.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *sums)
    zero = F.lit(0.0)
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), zero)
    for c in range(classes):
        rows = rows.withColumns({f"__p_{c}": share(f"__hit_{c}", f"__pred_{c}"), f"__r_{c}": share(f"__hit_{c}", f"__true_{c}")})
    f1 = {
        c: F.coalesce(F.try_divide(2 * F.col(f"__p_{c}") * F.col(f"__r_{c}"), F.col(f"__p_{c}") + F.col(f"__r_{c}")), zero)
        for c in range(classes)
    }
    present = {c: F.col(f"__true_{c}") > 0 for c in range(classes)}
    total = lambda parts: sum(parts[1:], parts[0])
    k = F.greatest(total([F.when(present[c], 1).otherwise(0) for c in range(classes)]), F.lit(1))
    macro = lambda value: total([F.when(present[c], value(c)).otherwise(0.0) for c in range(classes)]) / k
    return rows.select(
        *keys,
        "n",
        F.try_divide(total([F.col(f"__hit_{c}") for c in range(classes)]).cast("double"), F.col("n")).alias("accuracy"),
        macro(lambda c: f1[c]).alias("macro_f1"),
        macro(lambda c: F.col(f"__p_{c}")).alias("macro_precision"),
        macro(lambda c: F.col(f"__r_{c}")).alias("macro_recall"),
        F.array(*[f1[c] for c in range(classes)]).alias("per_class_f1"),
    )


def dispersion(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Spread of a metric over keys; NULL and NaN are skipped, a single key has standard deviation 0."""
    by = list(by)
    clean = df.withColumn(value, F.nullif(F.col(value).cast("double"), F.lit(float("nan"))))
    sums = clean.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.when(F.count(value) > 1, F.stddev_samp(value)).when(F.count(value) == 1, 0.0).alias("std"),
        F.min(value).alias("worst"),
        F.max(value).alias("best"),
        (F.max(value) - F.min(value)).alias("spread"),
    )
    points = percentiles(clean, by, value, {"median": 0.5, "p10": 0.1, "p25": 0.25, "p75": 0.75})
    points = points.withColumn("iqr", F.col("p75") - F.col("p25")).drop("p25", "p75")
    if not by:
        sums, points, by = sums.withColumn("__one", F.lit(1)), points.withColumn("__one", F.lit(1)), ["__one"]
    return attach(sums, points, by).drop("__one")


def per_key_metrics(df: DataFrame, key: str, truth: str, predicted: str, classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """Records, accuracy and macro F1 of every key."""
    by = [*keys, key]
    measured = classification_metrics(confusion(df, truth, predicted, classes, by), classes, by)
    return measured.select(*by, "n", "accuracy", "macro_f1")


def generalization_report(
    df: DataFrame, key: str, side: str, truth: str, predicted: str, classes: int, models: Sequence[str] = ()
) -> DataFrame:
    """Seen against unseen keys: pooled metrics, gaps, and the spread of per-key macro F1 on each side.

    ``side`` holds ``seen`` or ``unseen``. The pooled counts are the sums of the per-key counts.
    """
    models = list(models)
    counts = confusion(df, truth, predicted, classes, [*models, side, key])
    pooled_counts = counts.groupBy(*models, side, "y_true", "y_pred").agg(F.sum("n").alias("n"))
    pooled = classification_metrics(pooled_counts, classes, [*models, side])
    per_key = classification_metrics(counts, classes, [*models, side, key])
    spread = dispersion(per_key, "macro_f1", [*models, side])
    joined = attach(pooled.select(*models, side, "n", "accuracy", "macro_f1"), spread, [*models, side])
    picked = []
    for name in ("seen", "unseen"):
        for column in ("n", "accuracy", "macro_f1"):
            picked.append(F.max(F.when(F.col(side) == name, F.col(column))).alias(f"{name}_{column}"))
        for column in ("count", "mean", "median", "std", "p10", "worst", "best", "iqr", "spread"):
            picked.append(F.max(F.when(F.col(side) == name, F.col(column))).alias(f"{name}_key_{column}"))
    report = joined.groupBy(*models).agg(*picked)
    return report.withColumn("gap_macro_f1", F.col("seen_macro_f1") - F.col("unseen_macro_f1")).withColumn(
        "gap_accuracy", F.col("seen_accuracy") - F.col("unseen_accuracy")
    )


def rounds_to_target(
    history: DataFrame, run: Sequence[str], round_: str, metric: str, target: float, patience: int = 1
) -> DataFrame:
    """First round that starts ``patience`` evaluations in a row at or above the target; NULL if none does.

    One row per run. ``history`` has one row per run and round, so a run's window holds its rounds only.
    """
    run = list(run)
    ahead = Window.partitionBy(*run).orderBy(round_).rowsBetween(0, patience - 1)
    hit = F.when(F.col(metric) >= target, 1).otherwise(0)
    streak = (F.min(hit).over(ahead) == 1) & (F.count(F.lit(1)).over(ahead) == patience)
    marked = history.withColumn("__start", F.when(streak, F.col(round_)))
    return marked.groupBy(*run).agg(F.min("__start").alias("rounds_to_target"))


def bytes_to_target(
    history: DataFrame, run: Sequence[str], round_: str, metric: str, spent: str, target: float, patience: int = 1
) -> DataFrame:
    """Adds to :func:`rounds_to_target` the cumulative bytes spent up to that round."""
    reached = rounds_to_target(history, run, round_, metric, target, patience)
    at = history.select(*run, F.col(round_).alias("rounds_to_target"), F.col(spent).alias("bytes_to_target"))
    return attach(reached, at, [*run, "rounds_to_target"])
