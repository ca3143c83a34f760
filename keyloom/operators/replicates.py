"""Statistics over replicates (seeds): intervals, paired comparisons, multiple testing, headline tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.ordering import attach, mid_ranks, ordered, running
from keyloom.functions.tdist import normal_two_sided_p, quantile_column, two_sided_p

# The exact test counts in doubles, which hold the number of sign patterns of so many differences.
MOST_EXACT = 1000


def summarize(df: DataFrame, by: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """Count, mean, sample deviation and Student-t interval; deviation and interval are NULL for one value."""
    n, std = F.count(value), F.stddev_samp(value)
    sums = df.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.when(n > 1, std).alias("std"))
    half = quantile_column(F.col("n") - 1, confidence) * F.col("std") / F.sqrt("n")
    return sums.withColumn("ci95_low", F.col("mean") - half).withColumn("ci95_high", F.col("mean") + half)


def _sign_pattern_tail(ranks: Column, doubled_total: Column, doubled_plus: Column) -> Column:
    """Sign patterns at least as far from the centre as the observed rank sum.

    ``ranks`` holds doubled mid-ranks, so they are whole numbers. The number of patterns that reach each sum is built
    up rank by rank: the counts so far plus the same counts moved up by the rank.
    """
    zero = F.lit(0.0)
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(zero, doubled_total))

    def add(counts: Column, rank: Column) -> Column:
        moved = F.concat(F.array_repeat(zero, rank), F.slice(counts, F.lit(1), F.size(counts) - rank))
        return F.zip_with(counts, moved, lambda a, b: a + b)

    counts = F.aggregate(ranks, start, add)
    far = F.abs(2 * doubled_plus - doubled_total)
    tail = F.transform(counts, lambda c, s: F.when(F.abs(2 * s - doubled_total) >= far, c).otherwise(0.0))
    return F.aggregate(tail, zero, lambda a, b: a + b)


def wilcoxon(df: DataFrame, by: Sequence[str], diff: str, method: str = "exact") -> DataFrame:
    """Two-sided Wilcoxon signed-rank p-value and rank-biserial correlation of each group's differences.

    Zeros are dropped and ties get mid-ranks. ``method`` is ``exact`` (all sign patterns, counted by rank sum; an error for a
    group of more than ``MOST_EXACT`` differences, whose ranks it gathers) or ``normal`` (approximation with tie correction,
    any size); it comes back as ``wilcoxon_method``. Groups with only zeros get NULL.
    """
    if method not in ("exact", "normal"):
        raise ValueError(f"unknown method {method!r}: exact or normal")
    by = list(by)
    moved = df.where(F.col(diff) != 0).select(
        *by, F.col(diff).cast("double").alias("__d"), F.abs(diff).cast("double").alias("__a")
    )
    ranked = mid_ranks(moved, by, {"__a": "__rank"})
    ties = moved.groupBy(*by, "__a").agg(F.count(F.lit(1)).cast("double").alias("t"))
    sizes = ties.groupBy(*by).agg(
        F.sum("t").cast("int").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tied")
    )
    refused = F.raise_error(F.format_string(f"%d differences; the exact test takes {MOST_EXACT} at most", F.col("n"))).cast("int")
    gathered = F.collect_list(F.when(F.col("n") > MOST_EXACT, refused).otherwise((2 * F.col("__rank")).cast("int")))
    if by:
        joined = attach(ranked, sizes, by, "inner")
    else:
        joined = ranked.withColumns({c: sizes.select(c).scalar() for c in ("n", "tied")})
    sums = joined.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.max("tied").alias("tied"),
        *([gathered.alias("ranks")] if method == "exact" else []),
        F.sum(F.when(F.col("__d") > 0, F.col("__rank")).otherwise(0.0)).alias("plus"),
    )
    n, plus = F.col("n"), F.col("plus")
    total = n * (n + 1) / 2.0
    if method == "exact":
        p = _sign_pattern_tail(F.col("ranks"), n * (n + 1), (2 * plus).cast("int")) / F.pow(F.lit(2.0), n)
    else:
        variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("tied") / 48.0
        p = normal_two_sided_p(F.try_divide(plus - total / 2, F.sqrt(variance)))
    tested = sums.select(
        *by,
        p.alias("wilcoxon_p"),
        F.lit(method).alias("wilcoxon_method"),
        ((2 * plus - total) / total).alias("rank_biserial"),
    )
    if not by:
        return tested
    return attach(df.select(*by).distinct(), tested, by)


def paired_comparison(df: DataFrame, by: Sequence[str], a: str, b: str, method: str = "exact") -> DataFrame:
    """A minus B over paired replicates: interval, effect size, paired t-test and Wilcoxon test per group."""
    by = list(by)
    diffs = df.select(*by, (F.col(a) - F.col(b)).alias("diff"))
    base = summarize(diffs, by, "diff")
    varied = (F.col("n") > 1) & (F.col("std") > 0)
    t = F.try_divide(F.col("mean") * F.sqrt("n"), F.col("std"))
    base = base.select(
        *by,
        "n",
        F.col("mean").alias("mean_diff"),
        F.col("ci95_low").alias("diff_ci95_low"),
        F.col("ci95_high").alias("diff_ci95_high"),
        F.when(varied, F.col("mean") / F.col("std")).alias("cohens_dz"),
        F.when(varied, two_sided_p(t, F.col("n") - 1)).alias("t_p"),
        (2.0 / F.pow(F.lit(2.0), F.col("n"))).alias("wilcoxon_min_p"),
    )
    return attach(base, wilcoxon(diffs, by, "diff", method), by)


def holm(df: DataFrame, p: str, row: Sequence[str], family: Sequence[str] = (), out: str = "p_holm") -> DataFrame:
    """Holm step-down adjusted p-values within each family; NULL enters as 1."""
    family = list(family)
    tested = ordered(df.withColumn("__p", F.coalesce(p, F.lit(1.0))), family, ["__p", *row], rank="__rank")
    tests = tested.groupBy(*family).agg(F.count(F.lit(1)).alias("__m"))
    tested = attach(tested, tests, family, "inner") if family else tested.withColumn("__m", tests.scalar())
    raw = (F.col("__m") - F.col("__rank") + 1) * F.col("__p")
    adjusted = running(tested, family, "__rank", raw, "max", "__most")
    return adjusted.withColumn(out, F.least(F.lit(1.0), "__most")).drop("__p", "__rank", "__m", "__block", "__most")


def all_pairs_comparison(runs: DataFrame, condition: str, seed: str, value: str, method: str = "exact") -> DataFrame:
    """Every unordered pair of conditions with at least two shared seeds, Holm-adjusted over the pairs.

    ``runs`` has one row per condition and seed; pairs are formed between conditions of the same seed, so a seed gives
    the square of its conditions, which are few.
    """
    left = runs.select(seed, F.col(condition).alias("a"), F.col(value).alias("value_a"))
    right = runs.select(seed, F.col(condition).alias("b"), F.col(value).alias("value_b"))
    pairs = left.join(right, seed).where(F.col("a") < F.col("b"))
    compared = paired_comparison(pairs, ["a", "b"], "value_a", "value_b", method).where(F.col("n") >= 2)
    return holm(compared, "wilcoxon_p", ["a", "b"])


def headline_table(runs: DataFrame, condition: str, metrics: Sequence[str], digits: int = 4) -> DataFrame:
    """Per condition and metric: count, mean, deviation, interval, and the printed cell."""
    long = runs.unpivot([condition], list(metrics), "metric", "value").where(F.col("value").isNotNull())
    table = summarize(long, [condition, "metric"], "value")
    number = f"%.{digits}f"
    cell = F.when(F.col("std").isNull(), F.format_string(f"{number} (n=1)", "mean")).otherwise(
        F.format_string(f"{number} +/- {number} [{number}, {number}]", "mean", "std", "ci95_low", "ci95_high")
    )
    return table.withColumn("cell", cell)


def across_seeds(df: DataFrame, by: Sequence[str], seed: str, value: str) -> DataFrame:
    """Per group: interval summary, mean magnitude, and whether every report has the same non-zero sign."""
    signs = df.groupBy(*by).agg(
        F.count_distinct(F.col(seed)).alias("reports"),
        F.avg(F.abs(value)).alias("mean_abs"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
    )
    joined = attach(summarize(df, by, value), signs, list(by), "inner")
    one_sign = (F.col("n") == F.col("reports")) & ((F.col("lowest") > 0) | (F.col("highest") < 0))
    return joined.withColumn("same_sign", F.coalesce(one_sign, F.lit(False))).drop("lowest", "highest")
