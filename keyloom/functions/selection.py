"""The first rows of every group in a seeded order, found by counting: rows are compared with a cut-off, not ranked.

The order is that of the rows' digests. Counts per group and leading hex digits tell in which cell of digests a quota ends;
only cells in which one ends are counted by more digits, or, once they hold few rows, read. So counts and a few digests are
exchanged, never rows, and a group may be of any size. With more groups than can be sent to all tasks rows are ranked instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.hashing import seeded_hash
from keyloom.functions.ordering import attach, hash_rank
from keyloom.session import cut_lineage

# Hex digits by which a cell is split, and rows of a cell whose digests are read.
DIGITS, CELL_ROWS = 3, 1000
# Groups whose cut-offs are sent to all tasks.
MOST_GROUPS = 300_000
NONE, ALL = "", "g"  # below and above all digests


def first_by_hash(
    df: DataFrame, by: Sequence[str], row: str, seed: object, names: Sequence[str], quotas: Callable[[DataFrame], DataFrame],
    most_groups: int | None = None, **options: int,
) -> DataFrame:
    """Adds one boolean per name: whether the row is among the first rows of its group that ``quotas`` asks for.

    ``quotas`` gets one row per group, with its size ``__n``, and adds a number of rows under each name. ``row`` identifies
    a row inside the table. The order is that of :func:`hash_rank`; null groups are groups.
    """
    by, names = list(by), list(names)
    hashed = df.withColumn("__hash", seeded_hash(seed, row))
    narrow = hashed.select(*by, "__hash")
    cell = F.substring("__hash", 1, DIGITS).alias("__cell")
    cells = cut_lineage(narrow.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("__c")))
    wanted = quotas(cells.groupBy(*by).agg(F.sum("__c").alias("__n")))
    wanted = cut_lineage(wanted.select(*by, "__n", *names))
    if wanted.count() > (MOST_GROUPS if most_groups is None else most_groups):
        ranked = attach(hash_rank(df, by, [row], seed, "__rank", "__size", **options), wanted, by)
        return ranked.select(*df.columns, *[(F.col("__rank") <= F.col(n)).alias(n) for n in names])

    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("__name"), F.col(n).cast("long").alias("__want")) for n in names])).alias("e")
    open_ends = wanted.select(*by, "__n", ends).select(*by, "__n", "e.*").where("__want > 0 and __want < __n").drop("__n")
    found = None
    digits = DIGITS
    inside = [*by]
    while True:
        before = Window.partitionBy(*inside).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** DIGITS cells at most
        counted = cells.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        ending = attach(open_ends, counted, inside, "inner").where("__want > __before and __want <= __before + __c")
        ending = cut_lineage(ending.select(*by, "__name", "__cell", (F.col("__want") - F.col("__before")).alias("__want"), "__c"))
        few = ending.where(F.col("__c") <= CELL_ROWS)
        here = F.substring("__hash", 1, digits)
        read = attach(narrow.withColumn("__cell", here), F.broadcast(few.select(*by, "__cell").distinct()), [*by, "__cell"], "left_semi")
        read = read.groupBy(*by, "__cell").agg(F.array_sort(F.collect_list("__hash")).alias("__digests"))  # CELL_ROWS at most
        cuts = attach(few, read, [*by, "__cell"], "inner").select(*by, "__name", F.element_at("__digests", F.col("__want").cast("int")).alias("__cut"))
        found = cuts if found is None else found.unionByName(cuts)
        many = ending.where(F.col("__c") > CELL_ROWS)
        if many.isEmpty():
            break
        # the same group may end in several cells: each is split on its own
        digits += DIGITS
        split = attach(narrow.withColumn("__cell", here), F.broadcast(many.select(*by, "__cell").distinct()), [*by, "__cell"], "left_semi")
        split = split.groupBy(*by, F.col("__cell").alias("__in"), F.substring("__hash", 1, digits).alias("__cell")).agg(F.count(F.lit(1)).alias("__c"))
        cells, inside = cut_lineage(split), [*by, "__in"]
        open_ends = many.select(*by, "__name", F.col("__cell").alias("__in"), "__want")

    picked = found.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == n, F.col("__cut"))).alias(f"__cut_{n}") for n in names])
    cutoffs = attach(wanted, picked, by).select(
        *by, *[F.when(F.col(n) >= F.col("__n"), ALL).when(F.col(n) > 0, F.col(f"__cut_{n}")).otherwise(NONE).alias(f"__cut_{n}") for n in names]
    )
    marked = attach(hashed, F.broadcast(cut_lineage(cutoffs)), by)
    return marked.select(*df.columns, *[(F.col("__hash") <= F.col(f"__cut_{n}")).alias(n) for n in names])
