"""Message and resource ledgers: per round, cumulative, and totals by phase."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_sums(messages: DataFrame, run: Sequence[str], round_: str) -> DataFrame:
    """Participants and bytes of each round in both directions (``down`` and ``up``)."""
    sums = []
    for name in ("down", "up"):
        mine = F.col("direction") == name
        sums += [
            F.count_if(mine).alias(f"{name}link_clients"),
            F.sum(F.when(mine, F.col("bytes")).otherwise(0)).alias(f"{name}link_bytes"),
        ]
    return messages.groupBy(*run, round_).agg(*sums)


def with_cumulative(rounds: DataFrame, run: Sequence[str], round_: str) -> DataFrame:
    """Adds bytes per participant and running totals to :func:`round_sums`; a run's window holds its rounds only."""
    so_far = Window.partitionBy(*(list(run) or [F.lit(1)])).orderBy(round_).rowsBetween(Window.unboundedPreceding, 0)
    for name in ("down", "up"):
        per = F.try_divide(F.col(f"{name}link_bytes").cast("double"), F.col(f"{name}link_clients"))
        rounds = rounds.withColumn(f"{name}link_bytes_per_client", F.coalesce(per, F.lit(0.0))).withColumn(
            f"cum_{name}link_bytes", F.sum(f"{name}link_bytes").over(so_far)
        )
    return rounds.withColumn("cum_total_bytes", F.col("cum_downlink_bytes") + F.col("cum_uplink_bytes"))


def round_ledger(messages: DataFrame, run: Sequence[str], round_: str) -> DataFrame:
    """Bytes, participants and cumulative totals of every training round."""
    return with_cumulative(round_sums(messages, run, round_), run, round_)


def ledger_totals(messages: DataFrame, run: Sequence[str]) -> DataFrame:
    """Training, setup and evaluation bytes of every run; only training counts towards the training total."""
    sums = []
    for phase in ("training", "setup", "evaluation"):
        for name in ("down", "up"):
            mine = (F.col("phase") == phase) & (F.col("direction") == name)
            sums.append(F.sum(F.when(mine, F.col("bytes")).otherwise(0)).alias(f"{phase}_{name}link_bytes"))
    totals = messages.groupBy(*run).agg(*sums)
    return totals.withColumn(
        "training_total_bytes", F.col("training_downlink_bytes") + F.col("training_uplink_bytes")
    )


def phase_rollup(messages: DataFrame, run: Sequence[str]) -> DataFrame:
    """Bytes by phase and direction with subtotals; NULL marks a subtotal."""
    rolled = messages.rollup(*run, "phase", "direction").agg(F.sum("bytes").alias("bytes"))
    return rolled.select(*run, "phase", "direction", "bytes")


def energy_proxy(cpu_seconds: Column, cpu_watts: float, gpu_seconds: Column, gpu_watts: float) -> Column:
    """Active seconds times declared power."""
    return cpu_seconds * F.lit(cpu_watts) + gpu_seconds * F.lit(gpu_watts)


def round_resources(
    reports: DataFrame, run: Sequence[str], round_: str, cpu_watts: float = 0.0, gpu_watts: float = 0.0
) -> DataFrame:
    """Seconds, peak memory, steps and example-weighted loss of every round.

    ``reports`` has one row per participant: wall_s, cpu_s, gpu_s, memory_mb, train_loss, num_examples, steps.
    """
    weighted = F.sum(F.col("train_loss") * F.col("num_examples"))
    sums = reports.groupBy(*run, round_).agg(
        F.count(F.lit(1)).alias("reported"),
        F.sum("wall_s").alias("wall_s"),
        F.sum("cpu_s").alias("cpu_s"),
        F.sum("gpu_s").alias("gpu_s"),
        F.max("memory_mb").alias("peak_memory_mb"),
        F.try_divide(weighted.cast("double"), F.sum("num_examples")).alias("train_loss"),
        F.sum("steps").alias("steps"),
    )
    return sums.withColumn("energy_joules", energy_proxy(F.col("cpu_s"), cpu_watts, F.col("gpu_s"), gpu_watts))
