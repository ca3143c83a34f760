"""Profiling, filtering and splitting whole keys (authors, products, sources)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.ordering import attach, hash_rank, percentiles, sorted_codes
from keyloom.functions.selection import first_by_hash

# Percentiles of a profile, default retention thresholds, role codes.
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)
THRESHOLDS = (1, 2, 5, 10, 20, 50, 100, 200)
TRAIN, VAL, CLIENT_TEST, UNSEEN = 0, 1, 2, 3


def encode_keys(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Adds the key's position 0..K-1 in sorted key order."""
    return attach(df, sorted_codes(df, key, code), [key], "inner")


def key_label_counts(df: DataFrame, key: str, label: str, classes: int) -> DataFrame:
    """One row per key: records ``size`` and records of each class ``n_0`` .. ``n_{C-1}``."""
    per_class = [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in range(classes)]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size"), *per_class)


def class_columns(classes: int) -> list[str]:
    return [f"n_{c}" for c in range(classes)]


def with_skew(counts: DataFrame, classes: int) -> DataFrame:
    """Adds each key's majority-class share and mean label to its label counts."""
    names = class_columns(classes)
    majority = F.greatest(*names) if classes > 1 else F.col(names[0])
    weighted = sum((F.col(f"n_{c}") * c for c in range(1, classes)), F.lit(0))
    return counts.withColumn("majority_share", majority / F.col("size")).withColumn(
        "mean_label", weighted / F.col("size")
    )


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: min, max, mean and the profile percentiles over all rows."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("m")
    ).select("m.metric", "m.value")
    spread = long.groupBy("metric").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )
    points = percentiles(long, ["metric"], "value", {f"p{p}": p / 100.0 for p in PERCENTILES})
    return spread.join(points, "metric")


def key_size_distribution(counts: DataFrame) -> DataFrame:
    """Distribution of records per key."""
    return distributions(counts, ["size"]).drop("metric").withColumn("median", F.col("p50"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Records and share of each class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def class_distribution_of_counts(counts: DataFrame, classes: int) -> DataFrame:
    """:func:`class_distribution` from per-key label counts, without another pass over the records."""
    sums = counts.agg(F.sum("size").alias("total"), *[F.sum(c).alias(c) for c in class_columns(classes)])
    cells = [F.struct(F.lit(c).alias("label"), F.col(f"n_{c}").alias("n")) for c in range(classes)]
    rows = sums.select("total", F.explode(F.array(*cells)).alias("c"))
    return rows.select("c.label", "c.n", F.try_divide(F.col("c.n"), F.col("total")).alias("share"))


def key_skew(counts: DataFrame, classes: int) -> tuple[DataFrame, DataFrame]:
    """Distributions of majority share and mean label over keys, and the number of single-class keys."""
    skewed = with_skew(counts, classes)
    single = skewed.agg(F.count_if(F.col("majority_share") == 1.0).alias("single_class_keys"))
    return distributions(skewed, ["majority_share", "mean_label"]), single


def retention_curve(counts: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Keys and records kept for each minimum size, counted in one pass over the key sizes."""
    sums = [F.count(F.lit(1)).alias("k"), F.sum("size").alias("n")]
    for t in thresholds:
        keep = F.col("size") >= t
        sums += [F.count_if(keep).alias(f"k_{t}"), F.sum(F.when(keep, F.col("size")).otherwise(0)).alias(f"n_{t}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(int(t)).cast("long").alias("min_size"),
                F.col(f"k_{t}").alias("keys_retained"),
                F.try_divide(F.col(f"k_{t}"), F.col("k")).alias("key_fraction"),
                F.col(f"n_{t}").alias("records_retained"),
                F.try_divide(F.col(f"n_{t}"), F.col("n")).alias("record_fraction"),
            )
            for t in thresholds
        ]
    )
    return counts.agg(*sums).select(F.inline(rows))


def keys_with_min(df: DataFrame, key: str, min_n: int) -> DataFrame:
    """Keys that have at least ``min_n`` records, with their size."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_n)


def filter_keys_min(df: DataFrame, key: str, min_n: int) -> DataFrame:
    """Records of the keys that have at least ``min_n`` records."""
    return df.join(keys_with_min(df, key, min_n).select(key), key, "left_semi")


def sample_keys(keys: DataFrame, key: str, max_keys: int, seed: object) -> DataFrame:
    """Seeded sample of ``max_keys`` distinct keys without replacement; all of them if there are fewer."""
    ranked = hash_rank(keys.select(key).distinct(), [], [key], seed)
    return ranked.where(F.col("rank") <= max_keys).select(key)


def cap_per_key(df: DataFrame, key: str, row: str, cap: int, seed: object, **options: int) -> DataFrame:
    """Keys with more than ``cap`` records keep a seeded subset of exactly ``cap``; others keep all."""
    chosen = first_by_hash(df, [key], row, seed, ["__kept"], lambda sizes: sizes.withColumn("__kept", F.lit(cap)), **options)
    return chosen.where("__kept").drop("__kept")


def retained_keys(
    df: DataFrame, key: str, min_n: int, max_keys: int | None = None, seed: object = 0
) -> DataFrame:
    """Keys the filter rule keeps, with their raw size."""
    if min_n is None:
        raise ValueError("set a minimum number of records per key; profile the keys first")
    kept = keys_with_min(df, key, min_n)
    return kept if max_keys is None else kept.join(sample_keys(kept, key, max_keys, seed), key, "left_semi")


def filter_keys(
    df: DataFrame, key: str, row: str, min_n: int, cap: int | None = None, max_keys: int | None = None, seed: object = 0
) -> DataFrame:
    """The whole filter rule: minimum size, then a sample of keys, then a cap on records per key."""
    kept = df.join(retained_keys(df, key, min_n, max_keys, seed).select(key), key, "left_semi")
    return kept if cap is None else cap_per_key(kept, key, row, cap, seed)


def filter_report(
    df: DataFrame, key: str, min_n: int, cap: int | None = None, max_keys: int | None = None, seed: object = 0
) -> DataFrame:
    """Raw and retained keys and records, computed from key sizes alone."""
    raw = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    kept = retained_keys(df, key, min_n, max_keys, seed).select(key, F.lit(True).alias("kept"))
    marked = raw.join(kept, key, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    size = F.col("size") if cap is None else F.least("size", F.lit(cap).cast("long"))
    capped = F.lit(False) if cap is None else F.col("kept") & (F.col("size") > cap)
    report = marked.agg(
        F.count(F.lit(1)).alias("raw_keys"),
        F.sum("size").alias("raw_records"),
        F.count_if("kept").alias("keys_retained"),
        F.sum(F.when(F.col("kept"), size).otherwise(0)).alias("records_retained"),
        F.count_if(capped).alias("keys_capped"),
    )
    return report.withColumn("record_fraction", F.col("records_retained") / F.col("raw_records"))


def split_keys(keys: DataFrame, key: str, fraction: float, seed: object) -> DataFrame:
    """Holds out a share of whole keys: ``(key, unseen)``. Fails when either side would be empty."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("the held-out fraction must be strictly between 0 and 1")
    held = F.rint(F.lit(fraction) * F.col("size")).cast("long")
    message = F.lit("the held-out split would be empty or would contain every key")
    held = F.when((held == 0) | (held == F.col("size")), F.raise_error(message).cast("long")).otherwise(held)
    ranked = hash_rank(keys.select(key).distinct(), [], [key], seed)
    return ranked.select(key, (F.col("rank") <= held).alias("unseen"))


def roles_within_keys(
    df: DataFrame, key: str, row: str, split: DataFrame, fractions: Sequence[float], seed: object, **options: int
) -> DataFrame:
    """Adds ``role``: UNSEEN for records of held-out keys, otherwise a seeded split inside each key.

    A key with two or more records has at least one test record; every seen key keeps a training record.
    ``fractions`` are the shares of train, validation and test.
    """
    seen = attach(df, split.select(key, "unseen"), [key], "inner")
    n = F.col("__n")
    n_test = F.when(n >= 2, F.greatest(F.lit(1), F.rint(F.lit(fractions[2]) * n).cast("long"))).otherwise(0)
    n_val = F.when(n - n_test >= 2, F.rint(F.lit(fractions[1]) * n).cast("long")).otherwise(0)
    quotas = {"__train": n - n_val - n_test, "__val": n - n_test}
    ranked = first_by_hash(seen, [key], row, seed, list(quotas), lambda sizes: sizes.withColumns(quotas), **options)
    role = F.when(F.col("unseen"), UNSEEN).when(F.col("__train"), TRAIN).when(F.col("__val"), VAL).otherwise(CLIENT_TEST)
    return ranked.withColumn("role", role).drop("unseen", *quotas)


def key_overlap(df: DataFrame, key: str, role: str = "role") -> DataFrame:
    """Keys and records on both sides of the seen/unseen split, and the number of keys on both."""
    sides = df.groupBy(key).agg(
        F.count_if(F.col(role) == UNSEEN).alias("held"), F.count_if(F.col(role) != UNSEEN).alias("open")
    )
    return sides.agg(
        F.count_if(F.col("open") > 0).alias("seen_keys"),
        F.count_if(F.col("held") > 0).alias("unseen_keys"),
        F.count_if((F.col("open") > 0) & (F.col("held") > 0)).alias("overlap"),
        F.sum("open").alias("seen_records"),
        F.sum("held").alias("unseen_records"),
    )


def assert_no_key_overlap(df: DataFrame, key: str, role: str = "role") -> DataFrame:
    """:func:`key_overlap` that fails on a shared key or an empty side."""
    report = key_overlap(df, key, role)
    bad = (F.col("overlap") > 0) | (F.col("seen_keys") == 0) | (F.col("unseen_keys") == 0)
    problem = F.raise_error(F.lit("a key lies on both sides of the split, or one side is empty")).cast("long")
    return report.withColumn("overlap", F.when(bad, problem).otherwise(F.col("overlap")))


def rows_by_role(df: DataFrame, role: int, key: str | None = None, value: object = None) -> DataFrame:
    """Records of one role, within one key if given."""
    rows = df.where(F.col("role") == role)
    return rows if key is None else rows.where(F.col(key) == value)
