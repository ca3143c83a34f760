"""Seeded roles, class-proportional subsets, label noise and per-round key samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.hashing import hash_word, seeded_hash
from keyloom.functions.ordering import attach, hash_rank
from keyloom.functions.selection import first_by_hash
from keyloom.operators.keys import CLIENT_TEST, TRAIN, VAL


def assign_roles_stratified(
    df: DataFrame, label: str, row: str, fractions: Sequence[float], seed: object, **options: int
) -> DataFrame:
    """Adds ``role``: the rounded shares of every class go to train and validation, the rest to test."""
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("role fractions must sum to 1")
    train = F.rint(F.lit(fractions[0]) * F.col("__n")).cast("long")
    val = F.rint(F.lit(fractions[1]) * F.col("__n")).cast("long")
    quotas = {"__train": train, "__val": train + val}
    marked = first_by_hash(df, [label], row, seed, list(quotas), lambda sizes: sizes.withColumns(quotas), **options)
    role = F.when(F.col("__train"), TRAIN).when(F.col("__val"), VAL).otherwise(CLIENT_TEST)
    return marked.withColumn("role", role).drop(*quotas)


def class_quotas(counts: DataFrame, label: str, size: int) -> DataFrame:
    """Adds ``__quota`` to the sizes ``__n`` of classes: the floor of its share of ``size``, remainders to the largest classes."""
    everything = Window.partitionBy(F.lit(1))  # one row per class
    floors = counts.withColumn(
        "__floor", F.floor(F.col("__n") / F.sum("__n").over(everything) * F.lit(size)).cast("long")
    )
    missing = F.lit(size) - F.sum("__floor").over(everything)
    place = F.row_number().over(everything.orderBy(F.desc("__n"), F.asc(label)))
    return floors.select(label, "__n", (F.col("__floor") + F.when(place <= missing, 1).otherwise(0)).alias("__quota"))


def stratified_subset(df: DataFrame, label: str, row: str, size: int, seed: object, **options: int) -> DataFrame:
    """Seeded class-proportional subset of exactly ``size`` rows."""
    chosen = first_by_hash(df, [label], row, seed, ["__quota"], lambda sizes: class_quotas(sizes, label, size), **options)
    return chosen.where("__quota").drop("__quota")


def flip_labels(
    df: DataFrame, row: str, label: str, eligible: Column, rate: float, classes: int, seed: object
) -> DataFrame:
    """Moves the rounded share ``rate`` of the eligible rows to another class; adds ``flipped``."""
    ranked = hash_rank(df.where(eligible).select(row, label), [], [row], seed)
    flips = ranked.where(F.col("rank") <= F.rint(F.lit(rate) * F.col("size")))
    shift = 1 + hash_word(seeded_hash(f"{seed}|shift", row)) % (classes - 1)
    flips = flips.select(row, ((F.col(label) + shift) % classes).cast("int").alias("__noisy"))
    marked = attach(df, flips, [row]).withColumn("flipped", F.col("__noisy").isNotNull())
    return marked.withColumn(label, F.coalesce("__noisy", F.col(label))).drop("__noisy")


def sample_keys_per_round(
    keys: DataFrame, key: str, fraction: float, min_keys: int, seed: object, rounds: int, **options: int
) -> DataFrame:
    """For every round, a seeded sample of keys without replacement: ``(round, key)``."""
    drawn = keys.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    ranked = hash_rank(drawn, ["round"], ["round", key], seed, **options)
    wanted = F.least(F.col("size"), F.greatest(F.lit(min_keys).cast("long"), F.rint(F.lit(fraction) * F.col("size")).cast("long")))
    return ranked.where(F.col("rank") <= wanted).select("round", key)
