"""From labelled records to a keyed data set: filter, holdout, roles, vocabulary, features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.hashing import derive_seed
from keyloom.operators.keys import (
    TRAIN, assert_no_key_overlap, filter_keys, filter_report, roles_within_keys, split_keys,
)
from keyloom.operators.terms import fit_on_role, tfidf_transform
from keyloom.session import cut_lineage


@dataclass(frozen=True)
class Preparation:
    """Rules fixed before any training."""

    min_records: int
    max_records: int | None = None
    max_keys: int | None = None
    filter_seed: int = 0
    unseen_fraction: float = 0.2
    holdout_seed: int = 0
    role_fractions: tuple[float, float, float] = (0.8, 0.1, 0.1)
    role_seed: int = 0
    min_df: int = 2
    max_features: int | None = None
    ngram_low: int = 1
    ngram_high: int = 2
    sublinear: bool = True


def prepare_keyed_dataset(df: DataFrame, row: str, key: str, label: str, text: str, rule: Preparation) -> dict[str, DataFrame]:
    """Rows with roles, the vocabulary of the training rows of seen keys, features of all rows, and reports.

    Roles are decided on narrow rows; the text is joined back once and read for the vocabulary and the features.
    """
    narrow = df.select(row, key, label)
    kept = filter_keys(narrow, key, row, rule.min_records, rule.max_records, rule.max_keys, rule.filter_seed)
    kept = cut_lineage(kept)
    split = cut_lineage(split_keys(kept, key, rule.unseen_fraction, derive_seed("holdout", rule.holdout_seed)))
    roles = roles_within_keys(kept, key, row, split, rule.role_fractions, derive_seed("roles", rule.role_seed))
    rows = cut_lineage(roles)
    texts = rows.join(df.select(row, text), row)
    vocabulary = cut_lineage(
        fit_on_role(texts, text, "role", TRAIN, rule.min_df, rule.max_features, rule.ngram_low, rule.ngram_high)
    )
    features = tfidf_transform(texts, row, text, vocabulary, rule.sublinear, rule.ngram_low, rule.ngram_high)
    return {
        "rows": rows,
        "split": split,
        "vocabulary": vocabulary,
        "features": features,
        "filter_report": filter_report(df, key, rule.min_records, rule.max_records, rule.max_keys, rule.filter_seed),
        "overlap": assert_no_key_overlap(rows, key),
        "role_counts": rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")),
    }
