"""Linear scores, predictions, evaluation and label-prior offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.keys import class_columns
from keyloom.operators.metrics import classification_metrics, confusion
from keyloom.operators.terms import match_terms


def wide_weights(params: DataFrame, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Weights as one row per feature with a column per class."""
    weights = params.where(F.col("layer") == "weight")
    return weights.groupBy(*by, "idx").agg(
        *[F.sum(F.when(F.col("class") == c, F.col("value")).otherwise(0.0)).alias(f"w_{c}") for c in range(classes)]
    )


def bias_vector(params: DataFrame, classes: int) -> Column:
    """The ``classes`` biases as one array; a missing bias is 0."""
    sums = [
        F.sum(F.when((F.col("layer") == "bias") & (F.col("class") == c), F.col("value")).otherwise(0.0))
        for c in range(classes)
    ]
    return params.agg(F.array(*[F.coalesce(s, F.lit(0.0)) for s in sums])).scalar()


def score_linear(documents: DataFrame, features: DataFrame, params: DataFrame, doc: str, classes: int) -> DataFrame:
    """Adds ``logits``, one per class, to every document; a document without features scores the biases.

    Weights sit in one row per feature, so a document's features meet all classes at once and one shuffle on the
    document sums them. Weights that are many are broadcast for frequent features only.
    """
    joined = match_terms(features.select(doc, "idx", "value"), wide_weights(params, classes), "idx")
    sums = joined.groupBy(doc).agg(*[F.sum(F.col("value") * F.col(f"w_{c}")).alias(f"__x_{c}") for c in range(classes)])
    scored = documents.join(sums, doc, "left").withColumn("__bias", bias_vector(params, classes))
    logits = F.array(*[F.coalesce(f"__x_{c}", F.lit(0.0)) + F.col("__bias")[c] for c in range(classes)])
    return scored.withColumn("logits", logits).drop("__bias", *[f"__x_{c}" for c in range(classes)])


def predict(scored: DataFrame) -> DataFrame:
    """Adds the class with the largest logit, the lowest class on ties."""
    best = F.array_position("logits", F.array_max("logits")) - 1
    return scored.withColumn("prediction", best.cast("int"))


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax of the true class."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return top + F.log(total) - F.element_at(logits, label.cast("int") + 1)


def evaluate(scored: DataFrame, label: str, classes: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean cross-entropy and classification metrics per ``by`` group; NULL without documents."""
    by = list(by)
    predicted = predict(scored)
    loss = predicted.groupBy(*by).agg(F.avg(cross_entropy(F.col("logits"), F.col(label))).alias("loss"))
    measured = classification_metrics(confusion(predicted, label, "prediction", classes, by), classes, by)
    if not by:
        empty = F.col("n") == 0
        measured = measured.withColumn("loss", loss.scalar())
        return measured.withColumns(
            {c: F.when(~empty, F.col(c)) for c in ("macro_f1", "macro_precision", "macro_recall")}
        )
    return measured.join(loss, by)


def label_prior_offset(counts: DataFrame, classes: int, reference: Column | None = None, smoothing: float = 1.0) -> DataFrame:
    """Adds ``offset``: log of each key's smoothed class shares, less the log of a reference prior if given.

    ``counts`` comes from ``key_label_counts``; ``reference`` is an array column of class shares.
    """
    total = F.col("size") + classes * smoothing
    parts = []
    for c, name in enumerate(class_columns(classes)):
        own = F.log((F.col(name) + smoothing) / total)
        parts.append(own if reference is None else own - F.log(reference[c]))
    return counts.withColumn("offset", F.array(*parts))


def global_prior(counts: DataFrame, classes: int) -> Column:
    """Add-one class shares over all keys, as an array."""
    sums = [F.sum(name) + 1.0 for name in class_columns(classes)]
    total = sum(sums[1:], sums[0])
    return counts.agg(F.array(*[s / total for s in sums])).scalar()


def planned_steps(n: Column, batch_size: Column | int, epochs: float) -> Column:
    """SGD steps of a possibly fractional number of epochs: none without rows, otherwise at least one."""
    steps = F.rint(F.lit(float(epochs)) * F.ceil(n / batch_size)).cast("long")
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), steps))
