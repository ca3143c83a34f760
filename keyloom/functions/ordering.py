"""Ranks, running totals and percentiles that never put an unbounded group into one task.

Two devices are used:

* **hash order** (random draws): the hash is uniform, so a group is cut into hash ranges; each range is
  ranked on its own and shifted by the number of rows in the ranges before it;
* **value order** (sorted codes, p-values, percentiles): one range-partitioned sort is written to the
  checkpoint folder together with each row's position, and a table with one row per sort partition and group
  carries totals from one partition to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.hashing import hash_word, seeded_hash
from keyloom.session import cut_lineage

# A group with more rows than this is ranked in several hash ranges.
ROWS_PER_RANGE = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """``left.k <=> right.k`` for every key; null keys form a group like any other."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on ``keys`` that keeps the left key columns."""
    renamed = right.select([F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"__r_{key}" for key in keys])


def hash_rank(
    df: DataFrame,
    by: Sequence[str],
    row: Sequence[str],
    seed: object,
    rank: str = "rank",
    size: str = "size",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Seeded permutation within each ``by`` group: adds the 1-based ``rank`` and the group's ``size``.

    ``row`` names the columns that identify a row inside the table; the order is the hash of the seed and
    these columns, ties broken by the columns themselves.
    """
    by, row = list(by), list(row)
    order = ["__hash", *row]
    hashed = df.withColumn("__hash", seeded_hash(seed, *row))
    if not by:
        wanted = max(1, -(-df.count() // rows_per_range))  # one range for every ``rows_per_range`` rows
        hashed = hashed.withColumn("__range", F.shiftright(hash_word(F.col("__hash")) * F.lit(wanted), 32))
        ranges = hashed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
        before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.select(
            "__range",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
            F.sum("__n").over(Window.partitionBy(F.lit(1))).alias(size),
        )
        ranked = hashed.withColumn("__pos", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
        ranked = ranked.join(ranges, "__range")
        return ranked.withColumn(rank, F.col("__pos") + F.col("__before")).drop("__hash", "__range", "__pos", "__before")

    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__size"))
    hot = sizes.where(F.col("__size") > rows_per_range).withColumn(
        "__ranges", F.ceil(F.col("__size") / F.lit(rows_per_range)).cast("long")
    )
    split = attach(hashed, hot, by).withColumn(
        "__range",
        F.coalesce(F.shiftright(hash_word(F.col("__hash")) * F.col("__ranges"), 32), F.lit(0).cast("long")),
    )
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        split.where(F.col("__ranges").isNotNull())
        .groupBy(*by, "__range")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*by, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    piece = Window.partitionBy(*by, "__range")
    ranked = split.withColumn("__pos", F.row_number().over(piece.orderBy(*order))).withColumn(
        "__piece", F.count(F.lit(1)).over(piece)
    )
    ranked = attach(ranked, offsets, [*by, "__range"])
    return (
        ranked.withColumn(rank, F.col("__pos") + F.coalesce("__before", F.lit(0).cast("long")))
        .withColumn(size, F.coalesce("__size", "__piece"))
        .drop("__hash", "__size", "__ranges", "__range", "__pos", "__piece", "__before")
    )


def ordered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], rank: str = "rank") -> DataFrame:
    """Rows in ``order`` within ``by``: adds the 1-based ``rank`` and ``__block``, the sort partition.

    ``order`` must be unique within the group (add a tie-breaker), so that equal values spread over partitions.
    Runs one sort job and keeps its result in the checkpoint folder.
    """
    by = list(by)
    placed = cut_lineage(df.sort(*by, *order).withColumn("__place", F.monotonically_increasing_id()))
    placed = placed.withColumn("__block", F.shiftright("__place", 33))
    blocks = placed.groupBy(*by, "__block").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(by or [F.lit(1)])).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__n")
    joined = attach(placed, blocks, [*by, "__block"], "inner")
    return joined.withColumn(rank, F.col("__place") - F.col("__first") + F.col("__before") + 1).drop(
        "__place", "__first", "__before"
    )


def running(df: DataFrame, by: Sequence[str], rank: str, value: Column, how: str, out: str, backward: bool = False) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` of ``value`` up to each row (from each row on, if ``backward``).

    ``df`` comes from :func:`ordered`. Each block is scanned on its own; block results carry over.
    """
    by = list(by)
    merge = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    valued = df.withColumn("__value", value)
    blocks = valued.groupBy(*by, "__block").agg(merge("__value").alias("__total"))
    group = by or [F.lit(1)]
    over_blocks = Window.partitionBy(*group).orderBy(F.desc("__block") if backward else F.asc("__block"))
    carry = merge("__total").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*by, "__block", carry.alias("__carry"))
    in_block = Window.partitionBy(*by, "__block").orderBy(F.desc(rank) if backward else F.asc(rank))
    scanned = valued.withColumn("__own", merge("__value").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    joined = attach(scanned, blocks, [*by, "__block"], "inner")
    if how == "sum":
        total = F.col("__own") + F.coalesce(F.col("__carry"), F.lit(0))
    else:
        total = {"min": F.least, "max": F.greatest}[how]("__own", "__carry")
    return joined.withColumn(out, total).drop("__value", "__own", "__carry")


def cumulative_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """One row per distinct non-null value: its count ``__n``, the rows up to it (``__upto``), the group ``__total``.

    Repeated values are merged before the sort, so a value that most rows share does not fill one task.
    """
    by = list(by)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = ordered(distinct, by, [value], rank="__rank")
    counted = running(placed, by, "__rank", F.col("__n"), "sum", "__upto")
    totals = counted.groupBy(*by).agg(F.sum("__n").alias("__total"))
    if by:
        return attach(counted, totals, by, "inner").drop("__rank", "__block")
    return counted.withColumn("__total", totals.scalar()).drop("__rank", "__block")


def percentiles(df: DataFrame, by: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles of ``value`` per group; ``points`` maps column name to fraction."""
    counted = cumulative_counts(df, by, value)
    aggregates = []
    for name, fraction in points.items():
        position = F.lit(fraction) * (F.col("__total") - 1)
        start = F.col("__upto") - F.col("__n")
        for tag, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (start <= at) & (at < F.col("__upto"))
            aggregates.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{tag}_{name}"))
        aggregates.append(F.max(position - F.floor(position)).alias(f"__w_{name}"))
    found = counted.groupBy(*by).agg(*aggregates)
    lo = lambda n: F.col(f"__lo_{n}")
    hi = lambda n: F.col(f"__hi_{n}")
    return found.select(*by, *[(lo(n) + (hi(n) - lo(n)) * F.col(f"__w_{n}")).alias(n) for n in points])


def mid_ranks(df: DataFrame, by: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Adds average ranks within the group, equal values sharing one; ``columns`` maps a value column to its rank.

    All columns are ranked in one sort.
    """
    by = list(by)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*by, F.explode(cells).alias("cell")).select(*by, F.col("cell.c").alias("__c"), F.col("cell.v").alias("__v"))
    ranks = cut_lineage(cumulative_counts(long, [*by, "__c"], "__v"))
    for column, out in columns.items():
        mine = ranks.where(F.col("__c") == column).select(
            *by, F.col("__v").alias(column), (F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / 2.0).alias(out)
        )
        df = attach(df, mine, [*by, column])
    return df


def sorted_codes(keys: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Distinct keys numbered 0..K-1 in sorted order."""
    return ordered(keys.select(key).distinct(), [], [key], rank=code).select(key, (F.col(code) - 1).alias(code))
