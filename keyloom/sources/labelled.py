"""Labelled text with named splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.sinks import union_rows


def load_labelled_text(
    spark: SparkSession, splits: dict[str, str], text: str, label: str, offset: int = 0, fmt: str = "parquet",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(split, text, label)`` from one path per split; ``offset`` is subtracted from the source labels."""
    if not splits:
        raise ValueError("name at least one split")
    return union_rows(
        [labelled(spark.read.format(fmt).load(path), name, text, label, offset, keep) for name, path in splits.items()]
    )


def labelled(df: DataFrame, split: str, text: str, label: str, offset: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """One split as ``(split, text, label)``."""
    return df.select(
        F.lit(split).alias("split"), *keep, F.col(text).alias("text"), (F.col(label) - offset).cast("int").alias("label")
    )


def split_class_counts(df: DataFrame) -> DataFrame:
    """Records of each split and class."""
    return df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
