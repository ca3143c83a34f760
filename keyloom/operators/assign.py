"""Assignment of rows to synthetic or natural keys: ``(row, client)``.

Dirichlet proportions are gamma numbers drawn from hashes in Spark; every row finds its client from its seeded rank
within its class. Only equal-size plans are fitted on the driver, from one number per client and class.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.hashing import derive_seed, hash_word, seeded_hash
from keyloom.functions.ordering import hash_rank, ordered, running, sorted_codes
from keyloom.functions.random import gamma
from keyloom.session import cut_lineage
from keyloom.sources.sinks import write_once

# Draws that are looked at in one job.
DRAWS_AT_ONCE = 16


def iid_assign(df: DataFrame, row: str, clients: int, seed: object) -> DataFrame:
    """Deals shuffled rows into ``clients`` keys whose sizes differ by at most one."""
    ranked = hash_rank(df.select(row), [], [row], seed)
    place, share = F.col("rank") - 1, F.floor(F.col("size") / clients)
    larger = F.col("size") % clients
    edge = larger * (share + 1)
    client = F.when(place < edge, F.floor(place / (share + 1))).otherwise(larger + F.floor((place - edge) / share))
    return ranked.select(row, client.cast("int").alias("client"))


def _class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; one number per class reaches the driver."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect()
    return {r[label]: r["n"] for r in rows}


def _redraw(
    counts: DataFrame, label: str | None, clients: int, alpha: float, seed: object, min_size: int, max_tries: int
) -> tuple[DataFrame, int]:
    """Intervals ``(label, client, lo, hi, width)`` of the first draw that gives every client ``min_size`` rows, and its number.

    ``counts`` has the rows ``n`` of each class. A draw is one gamma number per class and client, a function of seed, draw,
    class and client; shares are running sums within the class. Draws are looked at ``DRAWS_AT_ONCE`` at a time in one
    job; only their smallest clients reach the driver.
    """
    label = label or "__label"
    if label not in counts.columns:
        counts = counts.withColumn(label, F.lit(0))
    counts = cut_lineage(counts.select(F.col(label).alias("label"), "n"))  # one row per class
    for first in range(1, max_tries + 1, DRAWS_AT_ONCE):
        draws = range(first, min(first + DRAWS_AT_ONCE, max_tries + 1))
        grid = counts.select("label", "n", F.explode(F.array(*[F.lit(d) for d in draws])).alias("draw"))
        grid = grid.repartition("label", "draw").select("label", "n", "draw", F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias("client"))
        drawn = grid.withColumn("g", gamma(alpha, F.lit(f"assign|{seed}"), F.col("draw"), F.col("label"), F.col("client")))
        placed = running(ordered(drawn, ["draw", "label"], ["client"], "__at"), ["draw", "label"], "__at", F.col("g"), "sum", "upto")
        placed = cut_lineage(placed.select("draw", "label", "client", "n", "g", "upto"))
        total = placed.groupBy("draw", "label").agg(F.max("upto").alias("total"))
        cut = placed.join(total, ["draw", "label"])
        hi = F.when(F.col("client") == clients - 1, F.col("n")).otherwise(F.floor(F.col("upto") / F.col("total") * F.col("n"))).cast("long")
        before = Window.partitionBy("draw", "label").orderBy("client")
        edges = cut.select("draw", "label", "client", "n", hi.alias("hi"))
        edges = cut_lineage(edges.withColumn("lo", F.coalesce(F.lag("hi").over(before), F.lit(0).cast("long"))))
        smallest = edges.groupBy("draw", "client").agg(F.sum(F.col("hi") - F.col("lo")).alias("size")).groupBy("draw").agg(F.min("size").alias("least"))
        good = smallest.where(F.col("least") >= min_size).agg(F.min("draw")).first()[0]
        if good is not None:
            width = F.greatest(F.lit(1), F.floor(F.col("n") / clients)).cast("long").alias("width")
            return edges.where(F.col("draw") == good).select("label", "client", "lo", "hi", width), good
    raise RuntimeError(f"no draw gave every one of {clients} clients {min_size} rows in {max_tries} tries")


def _interval_table(spark: SparkSession, rows: list[tuple], label_type: str) -> DataFrame:
    return spark.createDataFrame(rows, f"label {label_type}, client int, lo long, hi long, width long")


def assign_by_intervals(ranked: DataFrame, row: str, label: str | None, intervals: DataFrame) -> DataFrame:
    """Range join ``lo <= place < hi`` as an equi-join on grid cells.

    Every interval is listed under the cells it touches (about two per client and class), so a row meets only the
    intervals of its own cell.
    """
    cells = intervals.where(F.col("hi") > F.col("lo")).select(
        "label", "client", "lo", "hi", "width",
        F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width")))).alias("cell"),
    )
    widths = intervals.select("label", "width").distinct()
    placed = ranked.select(row, (F.col(label) if label else F.lit(0)).alias("label"), (F.col("rank") - 1).alias("place"))
    placed = placed.join(widths, "label").withColumn("cell", F.floor(F.col("place") / F.col("width"))).drop("width")
    inside = (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
    return placed.join(cells, ["label", "cell"]).where(inside).select(row, "client")


def _from_cuts(df: DataFrame, row: str, label: str | None, cuts: dict, seed: object) -> DataFrame:
    by = [label] if label else []
    ranked = hash_rank(df.select(row, *by), by, [row], seed)
    rows = []
    for c, edges in cuts.items():
        width = max(1, int(edges[-1]) // max(1, len(edges) - 1))
        rows += [(c, k, int(edges[k]), int(edges[k + 1]), width) for k in range(len(edges) - 1)]
    label_type = dict(df.dtypes)[label] if label else "int"
    return assign_by_intervals(ranked, row, label, _interval_table(df.sparkSession, rows, label_type))


def dirichlet_assign(
    df: DataFrame, row: str, label: str, clients: int, alpha: float, seed: object, min_size: int = 10, max_tries: int = 1000
) -> tuple[DataFrame, int]:
    """Label skew: each class is cut among the clients in Dirichlet proportions.

    Redrawn until every client has ``min_size`` rows; also returns the number of draws.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    intervals, draws = _redraw(counts, label, clients, alpha, seed, min_size, max_tries)
    return assign_by_intervals(hash_rank(df.select(row, label), [label], [row], seed), row, label, intervals), draws


def quantity_skew_assign(
    df: DataFrame, row: str, clients: int, beta: float, seed: object, min_size: int = 10, max_tries: int = 1000
) -> tuple[DataFrame, int]:
    """Unequal client sizes in Dirichlet proportions, labels not looked at."""
    intervals, draws = _redraw(df.agg(F.count(F.lit(1)).alias("n")), None, clients, beta, seed, min_size, max_tries)
    return assign_by_intervals(hash_rank(df.select(row), [], [row], seed), row, None, intervals), draws


def fitted(preferences: np.ndarray, rows: np.ndarray, columns: np.ndarray, passes: int = 500) -> np.ndarray:
    """Scales a positive table until its row and column sums are the given ones (iterative proportional fitting)."""
    table = preferences.astype(float)
    for _ in range(passes):
        table *= (columns / table.sum(axis=0))[None, :]
        table *= (rows / table.sum(axis=1))[:, None]
    return table


def rounded_table(table: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whole numbers near ``table`` with exactly these row and column sums.

    Everything is rounded down first. Column by column, the one with the most units missing first, units go to the rows that
    miss most, then to those with the largest remainders.
    """
    whole = np.floor(table + 1e-9).astype(np.int64)
    excess = np.maximum(whole.sum(axis=0) - columns, 0)
    for j in np.flatnonzero(excess):  # a fit that has not settled: take back from the largest cells
        for i in np.argsort(-whole[:, j], kind="stable")[: excess[j]]:
            whole[i, j] -= 1
    missing, open_rows = columns - whole.sum(axis=0), rows - whole.sum(axis=1)
    for j in np.argsort(-missing, kind="stable"):
        while missing[j] > 0:
            order = np.lexsort((-(table[:, j] - whole[:, j]), -open_rows))
            served = order[: missing[j]][open_rows[order[: missing[j]]] > 0]
            whole[served, j] += 1
            open_rows[served] -= 1
            missing[j] -= len(served)
    return whole


def equal_size_plan(counts: dict, clients: int, alpha: float, seed: object) -> dict:
    """Rows of each class given to each client, as running edges per class.

    All clients draw their class preferences at once. The table of preferences is fitted to the class totals and to client
    sizes that differ by one at most, and rounded without changing either.
    """
    rng = np.random.default_rng(derive_seed("assign", seed))
    totals = np.array(list(counts.values()), dtype=np.int64)
    sizes = np.full(clients, totals.sum() // clients) + (rng.permutation(clients) < totals.sum() % clients)
    shares = rng.dirichlet(np.full(len(totals), alpha), size=clients) * totals + 1e-9 * totals.sum()
    held = np.flatnonzero(totals)
    plan = np.zeros((clients, len(totals)), np.int64)
    full = sizes > 0
    if full.any():
        some = fitted(shares[np.ix_(full, held)], sizes[full], totals[held])
        plan[np.ix_(full, held)] = rounded_table(some, sizes[full], totals[held])
    return {c: np.concatenate([[0], np.cumsum(plan[:, j])]) for j, c in enumerate(counts)}


def dirichlet_equal_assign(df: DataFrame, row: str, label: str, clients: int, alpha: float, seed: object) -> DataFrame:
    """Label skew with equal client sizes; class pools are used without replacement."""
    return _from_cuts(df, row, label, equal_size_plan(_class_counts(df, label), clients, alpha, seed), seed)


def natural_assign(df: DataFrame, key: str, row: str, min_size: int = 1, ignored: object = -1) -> DataFrame:
    """One client per key value with at least ``min_size`` rows, numbered in key order."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key) != F.lit(ignored))).select(row, key)
    kept = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    codes = sorted_codes(kept, key, "client").select(key, F.col("client").cast("int").alias("client"))
    return rows.join(codes, key).select(row, "client")


def describe_assignment(
    assigned: DataFrame, label: str, classes: int, role: str | None = None, roles: Sequence[int] = (0, 1, 2)
) -> DataFrame:
    """Rows, class counts and role counts of every client; ``assigned`` carries client, label and role."""
    sums = [F.count(F.lit(1)).alias("size")]
    sums += [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in range(classes)]
    if role:
        sums += [F.count_if(F.col(role) == r).alias(f"role_{r}") for r in roles]
    return assigned.groupBy("client").agg(*sums)


def _digest_sums(digest: Column) -> list[Column]:
    return [F.sum(hash_word(digest, w).cast("decimal(38,0)")).alias(f"__w{w}") for w in range(4)]


def client_fingerprints(assignment: DataFrame, row: str) -> DataFrame:
    """Digest of each client's set of rows: sums of row hashes, so that no row list is ever collected."""
    hashed = assignment.groupBy("client").agg(
        F.count(F.lit(1)).alias("size"), *_digest_sums(seeded_hash("row", "client", row))
    )
    words = [F.col(f"__w{w}").cast("string") for w in range(4)]
    return hashed.select("client", "size", F.sha2(F.concat_ws("|", "client", "size", *words), 256).alias("digest"))


def assignment_fingerprint(assignment: DataFrame, row: str) -> DataFrame:
    """One digest for the whole assignment, with its clients and rows."""
    whole = client_fingerprints(assignment, row).agg(
        F.count(F.lit(1)).alias("clients"), F.sum("size").alias("rows"), *_digest_sums(F.md5("digest"))
    )
    words = [F.col(f"__w{w}").cast("string") for w in range(4)]
    return whole.select("clients", "rows", F.sha2(F.concat_ws("|", "clients", "rows", *words), 256).alias("fingerprint"))


def save_assignment(assignment: DataFrame, row: str, path: str) -> DataFrame:
    """Writes an assignment once, with its fingerprint beside it; an existing one is never replaced."""
    stored = write_once(assignment, f"{path}/rows")
    write_once(assignment_fingerprint(stored, row), f"{path}/fingerprint")
    return stored


def load_assignment(spark: SparkSession, row: str, path: str, expected_rows: int | None = None) -> DataFrame:
    """Reads a saved assignment and refuses it if its content or size changed. Never creates one."""
    stored = spark.read.parquet(f"{path}/rows")
    actual = assignment_fingerprint(stored, row).first()
    saved = spark.read.parquet(f"{path}/fingerprint").first()
    if actual["fingerprint"] != saved["fingerprint"]:
        raise RuntimeError(f"assignment {path}: stored fingerprint {saved['fingerprint'][:12]} differs from {actual['fingerprint'][:12]}")
    if expected_rows is not None and actual["rows"] != expected_rows:
        raise RuntimeError(f"assignment {path} was made for {actual['rows']} rows, not {expected_rows}")
    return stored
