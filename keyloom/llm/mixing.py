"""Mixing sources to target weights by pivotal dependent rounding in a reduction tree; DataFrame functions only.

A source that must yield ``target`` words of its ``source_size`` takes every document x = target / source_size times: floor(x)
whole copies, and one more with the fractional probability x - floor(x). These probabilities are rounded dependently.
Inside a small bucket, documents stand in order of size, largest first. The first is paired with all smaller ones as a pool;
words are moved at random between the two, without bias, until the document's probability is 0 or 1 or the whole pool's are.
Then the next document faces the rest. So a bucket keeps its expected words exactly and leaves one fractional document, a
small one as a rule. These residuals meet in the next level's buckets, and so on up to one per source, which goes to its nearer side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.ordering import ordered
from keyloom.llm.common import WORD, few, keep, row_key

# Units of a bucket, on average.
FAN = 64
# Repeated rows that one task writes at a time.
PIECE = 10_000
TINY = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, source: str = "source", size: str = "size") -> DataFrame:
    """One row per source: source_size, target, n (rows with words; each stands for ``rows`` documents, if there is such a column).

    Sources in code point order, null last, weigh ``weights`` in turn and divide ``share`` of all words; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight. With caps c and weights w, targets are
    min(c, w * level); in order of c / w, the level is the highest of (words left) / (weight left) before each source.
    """
    each = F.col("rows") if "rows" in sizes.columns else F.lit(1)
    totals = sizes.groupBy(source).agg(F.sum(F.col(size) * each).alias("source_size"), F.count_if(F.col(size) > 0).alias("n"))
    place = Window.orderBy(F.col(source).asc_nulls_last())  # one row per source
    totals = totals.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(place) - 1) % len(weights) + 1))
    totals = totals.withColumn("__cap", F.col("source_size") * F.lit(float(most))).withColumn("__r", F.col("__cap") / F.col("__w"))
    whole = Window.partitionBy(F.lit(1))
    before = Window.orderBy("__r", F.col(source).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    weight_left = F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    totals = totals.withColumn("__level", left / weight_left)
    target = F.least("__cap", F.col("__w") * F.max("__level").over(whole))
    return totals.select(source, "source_size", "n", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


# One step in a bucket. acc: (a, b) maps a unit's first probability p0 to the present one, a * p0 + b; w and m are the pool's
# words and its sum of words * p0; out has 1, 0 or -1 (left fractional) per unit; rest is the fractional unit's probability.
_STEP = f"""
  (acc, u) -> transform(
    transform(
      transform(
        array(named_struct('p', greatest(0D, least(1D, acc.a * u.p + acc.b)), 'w', acc.w - u.w, 'm', acc.m - u.w * u.p)),
        x -> named_struct('p', x.p, 'w', x.w, 'm', x.m,
          'mass', if(x.w <= 0, 0D, greatest(0D, least(x.w, acc.a * x.m + acc.b * x.w))))),
      x -> named_struct('p', x.p, 'w', x.w, 'm', x.m, 'mass', x.mass, 'room', if(x.w <= 0, 0D, x.w - x.mass),
        'whole', x.p <= {TINY} OR x.p >= 1 - {TINY},
        'up', least(u.w * (1 - x.p), x.mass), 'down', least(u.w * x.p, if(x.w <= 0, 0D, x.w - x.mass)))),
    x -> if(x.whole,
      named_struct('a', acc.a, 'b', acc.b, 'w', x.w, 'm', x.m, 'out', concat(acc.out, array(if(x.p > 0.5, 1, 0))), 'rest', acc.rest),
      if(u.draw * (x.up + x.down) < x.down,
        named_struct('a', if(x.mass > 0, acc.a * (1 - x.up / x.mass), acc.a), 'b', if(x.mass > 0, acc.b * (1 - x.up / x.mass), acc.b), 'w', x.w, 'm', x.m,
          'out', concat(acc.out, array(if(x.p + x.up / u.w >= 1 - {TINY}, 1, -1))), 'rest', if(x.p + x.up / u.w >= 1 - {TINY}, acc.rest, x.p + x.up / u.w)),
        named_struct('a', if(x.room > 0, acc.a * (1 - x.down / x.room), acc.a), 'b', if(x.room > 0, acc.b * (1 - x.down / x.room) + x.down / x.room, acc.b), 'w', x.w, 'm', x.m,
          'out', concat(acc.out, array(if(x.p - x.down / u.w <= {TINY}, 0, -1))), 'rest', if(x.p - x.down / u.w <= {TINY}, acc.rest, x.p - x.down / u.w))))
  )[0]
"""  # fmt: skip
_ROUND = f"""
  aggregate(units,
    named_struct('a', 1D, 'b', 0D, 'w', aggregate(units, 0D, (s, u) -> s + u.w), 'm', aggregate(units, 0D, (s, u) -> s + u.w * u.p),
      'out', cast(array() AS array<int>), 'rest', cast(null AS double)),
    {_STEP})
"""


def _level(units: DataFrame, carried: Sequence[str], seed: int, level: int) -> DataFrame:
    """Rounds each (source, bucket); the rows come back with out and, where out is -1, the new p."""
    fields = ["__w", "__p", *carried]
    unit = F.struct(
        (-F.col("__w")).alias("order"), F.xxhash64(F.lit(seed), F.lit(level), *[F.col(c) for c in carried]).alias("tie"), F.col("__w").alias("w"), F.col("__p").alias("p"),
        _uniform(F.lit(seed + 1), F.lit(level), *[F.col(c) for c in carried]).alias("draw"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)],
    )
    grouped = units.groupBy("__source", "__bucket").agg(F.sort_array(F.collect_list(unit)).alias("units"))
    done = grouped.withColumn("done", F.expr(_ROUND)).select("__source", "__bucket", F.col("done.rest").alias("__rest"), F.explode(F.arrays_zip("units", F.col("done.out").alias("out"))).alias("u"))
    columns = [F.col("u.units.w").alias("__w"), F.when(F.col("u.out") == -1, F.col("__rest")).otherwise(F.col("u.units.p")).alias("__p")]
    columns += [F.col(f"u.units.c{i}").alias(c) for i, c in enumerate(carried)]
    assert len(columns) == len(fields)
    return done.select("__source", "__bucket", *columns, F.col("u.out").alias("__out"))


def decisions(sizes: DataFrame, row: Sequence[str], weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """(row..., source, size, source_size, target, rows, base, extra), one row for documents that agree in all of row, source
    and size: each of its ``rows`` documents is copied ``base`` times, and ``extra`` of them once more.

    Of the expected number of further copies the whole ones are given, and only the rest is rounded. So documents that
    repeat are one unit, however many there are, and a bucket's units are different. Each level is written once.
    """
    row = list(row)
    sizes = sizes.select(*row, F.col("source").alias("__source"), F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    sizes = keep(sizes.groupBy(*row, "__source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-sizes")
    sources = keep(source_targets(sizes, weights, share, most, "__source"), "mix-sources")
    largest = sources.agg(F.max("n")).first()[0] or 0
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sizes.join(sources.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    joined = joined.withColumn("__x", x).withColumn("base", F.floor("__x").cast("long"))
    further = F.col("rows") * (F.col("__x") - F.col("base"))
    joined = joined.withColumn("__further", further).withColumn("__given", F.floor("__further").cast("long")).withColumn("__p", F.col("__further") - F.col("__given"))
    carried = [*row, "size", "source_size", "target", "rows", "base", "__given"]
    empty = joined.where("size = 0").withColumns({"base": F.lit(0).cast("long"), "__given": F.lit(0).cast("long")}).select("__source", *carried, F.lit(0).alias("__out"))
    buckets = F.ceil(F.col("n") / FAN)
    units = joined.where("size > 0").select("__source", F.pmod(F.xxhash64(F.lit(seed + 2), *row, "size"), buckets).alias("__bucket"), F.col("size").cast("double").alias("__w"), "__p", *carried)
    parts, left = [empty], math.ceil(largest / FAN)
    level = 0
    while True:
        done = keep(_level(units, carried, seed, level), "mix-level")
        parts.append(done.where("__out >= 0").select("__source", *carried, "__out"))
        units = done.where("__out < 0").drop("__out")
        if left <= 1:
            break
        left, level = math.ceil(left / FAN), level + 1
        units = units.withColumn("__bucket", F.expr(f"__bucket div {FAN}"))
    last = (F.col("__p") >= 0.5).cast("int")
    parts.append(units.select("__source", *carried, last.alias("__out")))
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select(*row, F.col("__source").alias("source"), "size", "source_size", "target", "rows", "base", (F.col("__given") + F.col("__out")).alias("extra"))


def mix(sizes: DataFrame, row: Sequence[str] = ("doc_id",), weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """From (row..., source, size): row..., source, size, source_size, target, copies, taken.

    ``row`` columns identify a document and drive the draws, so that reruns agree. Every row is a document of its own, also
    when rows repeat or ids are null. Documents without words are never taken; a null source is a source like any other.
    copies is floor(x) or one more, hence at most ``most``, rounded up; taken is copies * size. A source's taken words miss
    its target by half of one document at most, as a rule a small one.
    """
    decided = decisions(sizes, row, weights, share, most, seed)
    columns = [*row, "source", "size", "source_size", "target"]
    single = decided.where("rows = 1").select(*columns, (F.col("base") + F.col("extra")).alias("copies"))
    # rows that repeat: first their pieces, dealt out to tasks, then the rows of each piece
    begins = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(PIECE).cast("long"))).alias("__from")
    pieces = decided.where("rows > 1").select(*columns, "rows", "base", "extra", begins).repartition(*row, "size", "__from")
    nth = F.explode(F.sequence(F.col("__from"), F.least("rows", F.col("__from") + PIECE - 1))).alias("__nth")
    many = pieces.select(*columns, "base", "extra", nth).select(*columns, (F.col("base") + (F.col("__nth") <= F.col("extra")).cast("long")).alias("copies"))
    return single.union(many).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, row: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix itself: every taken document once per copy, with all its columns and copy (from 1; a column of that name is replaced).

    Rows that agree in id, text and source are documents of their own with the same chances. Which of them are taken once
    more follows from their places in one sorted order, so that no task holds all of them.
    """
    own = [c for c in docs.columns if c != "copy"]
    key = ["__k1", "__k2"]
    k1, k2 = row_key(F.col(row), F.col(text), F.col(source))
    decided = keep(decisions(sizes_of(docs, [k1, k2], text, source), key, weights, share, most, seed).select(*key, "rows", "base", "extra"), "mix-copies")
    keyed = docs.select(*own, k1, k2)
    single = keyed.join(decided.where("rows = 1"), key).withColumn("__n", F.col("base") + F.col("extra"))
    several = keyed.join(few(decided.where("rows > 1")), key).withColumn("__tie", F.monotonically_increasing_id())
    placed = ordered(several, key, ["__tie"], "__nth")
    repeated = placed.withColumn("__n", F.col("base") + (F.col("__nth") <= F.col("extra")).cast("long"))
    chosen = single.select(*own, "__n").union(repeated.select(*own, "__n")).where("__n > 0")
    return chosen.select(*own, F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("copy"))


def sizes_of(docs: DataFrame, row: Sequence[Column | str], text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(*row, F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
