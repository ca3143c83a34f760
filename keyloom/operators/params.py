"""Parameter tables ``(layer, class, idx, value)``: averaging client updates and server steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.ordering import attach

CELL = ["layer", "class", "idx"]


def weighted_average(updates: DataFrame, clients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the clients' values weighted by ``n``; a cell a client does not list counts as 0.

    ``updates`` is ``(by.., client, layer, class, idx, value)``, ``clients`` is ``(by.., client, n)``.
    """
    by = list(by)
    totals = clients.groupBy(*by).agg(F.sum("n").cast("double").alias("__total"))
    weighted = attach(updates, clients, [*by, "client"], "inner")
    sums = weighted.groupBy(*by, *CELL).agg(F.sum(F.col("value") * F.col("n")).alias("value"))
    sums = attach(sums, totals, by, "inner") if by else sums.withColumn("__total", totals.scalar())
    return sums.withColumn("value", F.col("value") / F.col("__total")).drop("__total")


def simple_average(updates: DataFrame, clients: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain mean of the clients' values."""
    return weighted_average(updates, clients.withColumn("n", F.lit(1)), by)


def _paired(params: DataFrame, mean: DataFrame) -> DataFrame:
    """Current value ``w`` and ``delta`` to the mean per cell; delta is 0 everywhere if nobody reported."""
    reported = mean.agg(F.count(F.lit(1)) > 0).scalar()
    both = params.select(*CELL, F.col("value").alias("w")).join(
        mean.select(*CELL, F.col("value").alias("m")), CELL, "full_outer"
    )
    w, m = F.coalesce("w", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    return both.select(*CELL, w.alias("w"), F.when(reported, m - w).otherwise(0.0).alias("delta"))


def step_fedavg(params: DataFrame, mean: DataFrame, server_lr: float = 1.0) -> DataFrame:
    """Moves the parameters towards the mean; unchanged if nobody reported."""
    return _paired(params, mean).select(*CELL, (F.col("w") + server_lr * F.col("delta")).alias("value"))


def step_fedadam(
    params: DataFrame, mean: DataFrame, state: DataFrame, server_lr: float, beta1: float = 0.9, beta2: float = 0.99,
    tau: float = 1e-3,
) -> DataFrame:
    """Adam step on the mean update; ``state`` is ``(layer, class, idx, m, v)``. Returns value, m and v per cell."""
    reported = mean.agg(F.count(F.lit(1)) > 0).scalar()
    old = state.select(*CELL, F.col("m").alias("m0"), F.col("v").alias("v0"))
    joined = _paired(params, mean).withColumn("reported", reported).join(old, CELL, "left")
    m0, v0, d = F.coalesce("m0", F.lit(0.0)), F.coalesce("v0", F.lit(0.0)), F.col("delta")
    joined = joined.withColumn("m", F.when(F.col("reported"), beta1 * m0 + (1 - beta1) * d).otherwise(m0)).withColumn(
        "v", F.when(F.col("reported"), beta2 * v0 + (1 - beta2) * d * d).otherwise(v0)
    )
    moved = F.col("w") + server_lr * F.col("m") / (F.sqrt("v") + tau)
    return joined.select(*CELL, F.when(F.col("reported"), moved).otherwise(F.col("w")).alias("value"), "m", "v")


def step_scaffold(
    params: DataFrame, updates: DataFrame, variates: DataFrame, deltas: DataFrame, clients: DataFrame, num_clients: int,
    server_lr: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """Plain-mean step on the parameters; control variates move by (reporting / all clients) times the mean change."""
    stepped = step_fedavg(params, simple_average(updates, clients), server_lr)
    share = clients.agg(F.count(F.lit(1)) / F.lit(float(num_clients))).scalar()
    change = simple_average(deltas, clients).select(*CELL, F.col("value").alias("change"))
    both = variates.join(change, CELL, "full_outer")
    moved = F.coalesce("value", F.lit(0.0)) + share * F.coalesce("change", F.lit(0.0))
    return stepped, both.select(*CELL, moved.alias("value"))


def control_change(variate: Column, start: Column, end: Column, steps: Column, lr: Column | float) -> Column:
    """Change of a client's control variate after local training from ``start`` to ``end``."""
    spent = F.greatest(steps, F.lit(1)) * lr
    return (start - end) / spent - variate


def parameter_counts(params: DataFrame) -> DataFrame:
    """Number of parameters and their size as 32-bit floats."""
    counts = params.agg(F.count(F.lit(1)).alias("total_parameters"))
    return counts.withColumn("bytes_float32", F.col("total_parameters") * 4)
