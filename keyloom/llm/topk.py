"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists, block by block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import keep

# Rows of a block; a task holds one block of queries and one of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 2048, 8192
# Queries of a block that go down the lists together.
TOGETHER = 256
FIRST_DEPTH = 32
# Beyond this, sums of float products may be inexact and whole-number arithmetic is used.
EXACT = 2.0**53


def quantised(table: DataFrame, row: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(row, vector) with components floor(scale * x) as longs. Null vectors, empty vectors, null ids and vectors with null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.col(row).isNotNull() & (F.size(vector) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.where(fine).select(F.col(row).alias("row"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")).alias("vector"))


class Lists:
    """A block of candidates as one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")  # smallest first
        self.sorted = np.take_along_axis(self.vectors, self.order, axis=0)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of the k highest scores of each query in this block, itself left out.

        Sorted access goes down all lists at once, from the top for positive and from the bottom for negative query
        components, to doubling depths. Whatever comes up first in any list is scored at once for all queries still
        active. A query ends when no unseen candidate can reach its k-th score: the sum of its components times the
        values at this depth is below it. A tie could still win by its id, so equality goes on.
        """
        n = len(self.ids)
        kind = np.float64 if exact else np.int64
        vectors, queries = self.vectors.astype(kind), queries.astype(kind)
        seen = np.zeros(n, bool)
        active = np.arange(len(queries))
        top_at = np.full((len(queries), k), -1, np.int64)
        top_score = np.full((len(queries), k), -np.inf if exact else np.iinfo(np.int64).min, kind)
        depth, done = min(FIRST_DEPTH, n), 0
        while len(active):
            signs = queries[active]
            fresh = np.zeros(n, bool)
            above, below = (signs > 0).any(axis=0), (signs < 0).any(axis=0)
            fresh[self.order[n - depth : n - done, above].ravel()] = True
            fresh[self.order[done:depth, below].ravel()] = True
            if depth == n:
                fresh[:] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            if len(new):
                scores = signs @ vectors[new].T
                own = query_ids[active][:, None] == self.ids[new][None, :]
                scores[own] = -np.inf if exact else np.iinfo(np.int64).min
                at = np.concatenate([top_at[active], np.broadcast_to(new, (len(active), len(new)))], axis=1)
                scores = np.concatenate([top_score[active], scores], axis=1)
                at[np.isneginf(scores) if exact else scores == np.iinfo(np.int64).min] = -1
                # the k best: everything above the k-th score, and of those equal to it the smallest ids
                kth = np.partition(scores, -k, axis=1)[:, -k][:, None]
                rank = np.where(scores >= kth, at, n)
                higher = scores > kth
                room = k - higher.sum(axis=1)
                equal = np.where((scores == kth) & (at >= 0), rank, n)
                cut = np.sort(np.partition(equal, min(k, equal.shape[1]) - 1, axis=1)[:, :k], axis=1)
                limit = np.where(room > 0, cut[np.arange(len(active)), np.maximum(room, 1) - 1], -1)[:, None]
                chosen = higher | ((scores == kth) & (at >= 0) & (at <= limit) & (equal < n))
                top_at[active], top_score[active] = -1, (-np.inf if exact else np.iinfo(np.int64).min)
                q, c = np.nonzero(chosen)
                slot = np.arange(len(q)) - np.searchsorted(q, q, "left")
                top_at[active[q], slot], top_score[active[q], slot] = at[q, c], scores[q, c]
            if depth == n:
                break
            upper = self.sorted[n - depth].astype(kind)  # what the next entries of the lists can have at most
            lower = self.sorted[depth - 1].astype(kind)
            bound = np.maximum(signs, 0) @ upper + np.minimum(signs, 0) @ lower
            full = (top_at[active] >= 0).all(axis=1)
            active = active[~(full & (bound < top_score[active].min(axis=1)))]
            depth, done = min(2 * depth, n), depth
        q, slot = np.nonzero(top_at >= 0)
        return q, self.ids[top_at[q, slot]], top_score[q, slot].astype(np.int64)


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy()
    return flat.reshape(rows, len(flat) // rows) if rows else np.zeros((0, 0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query (all, if there are fewer).

    Both inputs are (row, vector) as ``quantised`` gives them. Vectors of equal length are compared; candidates with the
    query's own id are left out; ties go to smaller ids; repeated rows are candidates of their own, while repeated queries
    are answered once. Fewer than one candidate gives no row. Queries and candidates are cut into blocks of about fixed size by hash. Every pair of blocks is one group of one task, so that neither side
    is ever whole in a task; a pair yields k rows per query at most.
    """
    vectors = keep(vectors.withColumn("mark", F.lit(0).cast("long")), "vectors")
    queries = keep(queries.dropDuplicates(["row", "vector"]).withColumn("mark", F.xxhash64("vector")), "queries")
    columns = math.ceil(vectors.count() / CANDIDATE_ROWS) or 1
    bands = math.ceil(queries.count() / QUERY_ROWS) or 1
    length = F.size("vector").alias("length")
    place = F.rand(17)  # spreads repeated ids over blocks as well; a block may hold any row

    def cells(side: DataFrame, own: int, other: int, first: bool) -> DataFrame:
        mine = F.floor(place * own).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        side = keep(side.select("row", "vector", "mark", length, mine.alias("mine")), "blocks").select("row", "vector", "mark", "length", "mine", others.alias("theirs"))
        return side.withColumnsRenamed({"mine": "band", "theirs": "column"} if first else {"mine": "column", "theirs": "band"})

    left, right = cells(queries, bands, columns, True), cells(vectors, columns, bands, False)
    schema = pa.schema([("query_id", pa.int64()), ("mark", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def pair(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        q, c = _matrix(asked["vector"], asked.num_rows), _matrix(held["vector"], held.num_rows)
        # the largest product a component can give, times the number of components
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < EXACT
        ids, marks, lists, parts = asked["row"].to_numpy(), asked["mark"].to_numpy(), Lists(held["row"].to_numpy(), c), []
        for i in range(0, len(ids), TOGETHER):
            at, found, score = lists.best(ids[i : i + TOGETHER], q[i : i + TOGETHER], k, exact)
            parts.append(pa.table([pa.array(ids[i + at]), pa.array(marks[i + at]), pa.array(found), pa.array(score)], schema=schema))
        return pa.concat_tables(parts)

    keys = ["length", "band", "column"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
