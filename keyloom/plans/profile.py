"""Profile of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.keys import (
    THRESHOLDS, class_distribution_of_counts, distributions, key_label_counts, retention_curve, with_skew,
)
from keyloom.session import cut_lineage
from keyloom.sources.sinks import write_once


def profile_keys(df: DataFrame, key: str, label: str, classes: int, thresholds: Sequence[int] = THRESHOLDS) -> dict[str, DataFrame]:
    """Everything known about the keys before filtering. The records are read once, into label counts per key."""
    per_key = cut_lineage(with_skew(key_label_counts(df, key, label, classes), classes))
    summary = per_key.agg(
        F.sum("size").alias("records"),
        F.count(F.lit(1)).alias("keys"),
        F.count_if(F.col("majority_share") == 1.0).alias("single_class_keys"),
    )
    return {
        "summary": summary,
        "distributions": distributions(per_key, ["size", "majority_share", "mean_label"]),
        "classes": class_distribution_of_counts(per_key, classes),
        "retention": retention_curve(per_key, thresholds),
        "per_key": per_key,
    }


def save_profile(profile: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Writes every table of a profile once."""
    return {name: write_once(table, f"{path}/{name}") for name, table in profile.items()}
