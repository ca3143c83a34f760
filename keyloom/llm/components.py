"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import keep


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes that have an edge (a, b); component is the smallest node reachable.

    Alternates two steps until nothing changes. Large star: every node links its larger neighbours to its smallest one.
    Small star: every node links its smaller neighbours and itself to the smallest of them. Both keep what is connected,
    and the rounds grow with the logarithm of the size of the largest component. Smallest neighbours come from partial
    aggregation, and a hub's rows are joined with one row, which adaptive execution can split. Every round is written once.
    """
    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).select("u", "m")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: every node points at the smallest node of its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
