"""Cleaning of review records: status, labels, text, duplicates, and the counts of every rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.hashing import sized_cell
from keyloom.functions.text import strip

# Fixed value: rules in the order in which they apply.
STATUSES = ("bad_json", "bad_rating", "missing_id", "empty_text", "ok")
CLASSES = 5


def label_from_rating(rating: Column) -> Column:
    """Star ratings 1..5 become classes 0..4."""
    return (rating.cast("int") - 1).cast("int")


def compose_text(title: Column, body: Column) -> Column:
    """Title and body on separate lines, or the body alone if the title is blank."""
    head = strip(title)
    return F.when(head != "", F.concat(head, F.lit("\n"), strip(body))).otherwise(strip(body))


def classify_record(parsed: DataFrame) -> DataFrame:
    """Adds ``body`` (stripped text) and ``status``, the first rule the record breaks or ``ok``."""
    rated = F.coalesce(F.col("rating").isin(1.0, 2.0, 3.0, 4.0, 5.0), F.lit(False))
    missing = (F.coalesce("user_id", F.lit("")) == "") | (F.coalesce("parent_asin", F.lit("")) == "")
    with_body = parsed.withColumn("body", strip(F.col("text")))
    status = (
        F.when(~F.col("is_object"), "bad_json")
        .when(~rated, "bad_rating")
        .when(missing, "missing_id")
        .when(F.col("body") == "", "empty_text")
        .otherwise("ok")
    )
    return with_body.withColumn("status", status)


def valid_records(classified: DataFrame) -> DataFrame:
    """Records that break no rule, as ``(seq, user_id, parent_asin, label, text, timestamp, body)``."""
    return classified.where(F.col("status") == "ok").select(
        "seq",
        "user_id",
        "parent_asin",
        label_from_rating(F.col("rating")).alias("label"),
        compose_text(F.col("title"), F.col("text")).alias("text"),
        "timestamp",
        "body",
    )


def duplicate_key(columns: Sequence[str]) -> Column:
    """Digest that stands for the compared columns, so that long texts are not shuffled; NULL equals NULL only."""
    return F.sha2(F.concat(*[sized_cell(F.col(c)) for c in columns]), 256)


def dedup_keep_first(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """First record in ``order`` of every group of equal ``columns``; ``order`` is unique.

    The first positions come from a partial aggregation, so a text copied into a third of all rows is merged
    before the shuffle and never gathered.
    """
    firsts = df.groupBy(duplicate_key(columns).alias("__key")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def clean_reviews(parsed: DataFrame) -> DataFrame:
    """Valid records without exact duplicates of user, item and body; the title does not count."""
    kept = dedup_keep_first(valid_records(classify_record(parsed)), ["user_id", "parent_asin", "body"], "seq")
    return kept.drop("body")


def cleaning_report(classified: DataFrame, classes: int = CLASSES) -> DataFrame:
    """Lines, records lost to each rule, duplicates, records kept, and kept records of each class."""
    status = classified.agg(
        F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    )
    groups = (
        valid_records(classified)
        .groupBy(duplicate_key(["user_id", "parent_asin", "body"]).alias("key"))
        .agg(F.min_by("label", "seq").alias("label"))
    )
    kept = groups.agg(
        F.struct(
            F.count(F.lit(1)).alias("kept"), *[F.count_if(F.col("label") == c).alias(f"n_{c}") for c in range(classes)]
        )
    ).scalar()
    whole = status.withColumn("k", kept)
    return whole.select(
        "lines", *STATUSES[:-1], (F.col("ok") - F.col("k.kept")).alias("duplicate"), F.col("k.kept").alias("kept"),
        *[F.col(f"k.n_{c}").alias(f"n_{c}") for c in range(classes)],
    )
