"""Product codes of vectors by Lloyd's rounds whose members stay where they are.

Every part of every vector lives in a table that is dealt out by (position, entry, salt): the owners of an entry. Owners sum
their resident members, a codebook follows from one row per owner. Only parts whose nearest entry is another one are
shuffled, to that entry's owners, and form the next table; a part that has left is recognised in its old table by comparing
it with the codebooks since. Salts bound the members of an owner, whatever share of the rows one entry has.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import few, keep

# Members of an owner, about, and owners of a partition.
OWNER_ROWS, PARTITION_ROWS = 100_000, 1_000_000
# Whole numbers are kept within this, so that sums of squares stay exact.
LIMIT = 1 << 24
EXACT = 2.0**53
# Parts that are compared with a codebook at once.
AT_ONCE = 1 << 14
MEMBER = "row long, vec_id long, part int, entry int, values array<int>"


def prepared(table: DataFrame, row: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(row, vec_id, label, vector) of usable vectors: floor(scale * x), and a number of its own for each row. Written once."""
    x = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.lit(float(scale)) * v))).cast("int"))
    rows = table.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(row).alias("vec_id"), F.col(label).alias("label"), whole.alias("vector"))
    return keep(rows, "vectors")


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book``, ties to the lower index; both exact."""
    small = 4.0 * max(np.abs(values).max(initial=0), np.abs(book).max(initial=0)) ** 2 * max(1, book.shape[1]) < EXACT
    kind = np.float64 if small else np.int64  # float products of small whole numbers are exact and faster
    book = book.astype(kind)
    index, distance = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    for i in range(0, len(values), AT_ONCE):
        some = values[i : i + AT_ONCE].astype(kind)
        square = (some * some).sum(axis=1)
        all_of = square[:, None] - 2 * (some @ book.T) + (book * book).sum(axis=1)[None, :]
        at = all_of.argmin(axis=1)
        index[i : i + AT_ONCE], distance[i : i + AT_ONCE] = at, all_of[np.arange(len(at)), at]
    return index, distance


def _each(rows: DataFrame, since: list[np.ndarray], last: np.ndarray | None, step: Callable, schema: str) -> DataFrame:
    """``step(batch, values, resident, now, distance)`` for each batch: resident are rows whose entry is the nearest in all
    books of ``since``; now and distance are what ``last`` gives, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column("values").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            part, entry = batch.column("part").to_numpy(), batch.column("entry").to_numpy()
            places = [(p, part == p) for p in np.unique(part)]
            resident, now, distance = np.ones(n, bool), np.empty(n, np.int64), np.empty(n, np.int64)
            for book in since:
                for p, mine in places:
                    resident[mine] &= nearest(values[mine], book[p])[0] == entry[mine]
            if last is not None:
                for p, mine in places:
                    now[mine], distance[mine] = nearest(values[mine], last[p])
            yield from step(batch, values, resident, now, distance)

    return rows.mapInArrow(run, schema)


class Members:
    """Tables of members, each dealt out by owner, and the codebooks that came after each was written."""

    def __init__(self, parts: int, salts: int, partitions: int):
        self.parts, self.salts, self.partitions = parts, salts, partitions
        self.tables: list[DataFrame] = []
        self.books: list[np.ndarray] = []  # books[k] is what tables[k] was assigned by

    def settle(self, rows: DataFrame, book: np.ndarray) -> None:
        """Rows that have come to a new entry, to its owners."""
        salt = F.pmod(F.xxhash64("row"), F.lit(self.salts)).alias("salt")
        dealt = rows.repartition(self.partitions, "part", "entry", salt).sortWithinPartitions("part", "entry")
        self.tables.append(keep(dealt, "members"))
        self.books.append(book)

    def movers(self, book: np.ndarray) -> DataFrame:
        """Resident members of all tables whose nearest entry in ``book`` is not theirs, with that entry."""

        def step(batch, values, resident, now, distance):
            gone = resident & (now != batch.column("entry").to_numpy())
            left = batch.filter(pa.array(gone))
            yield pa.RecordBatch.from_arrays([left.column(c) for c in ("row", "vec_id", "part")] + [pa.array(now[gone], pa.int32()), left.column("values")], ["row", "vec_id", "part", "entry", "values"])

        return self.union(lambda table, since: _each(table, since, book, step, MEMBER))

    def sums(self) -> DataFrame:
        """(part, entry, n, total): sums over resident members, one row per owner and task before they are added up."""

        def step(batch, values, resident, now, distance):
            part, entry = batch.column("part").to_numpy()[resident], batch.column("entry").to_numpy()[resident]
            keys, where = np.unique(part.astype(np.int64) << 32 | entry, return_inverse=True)
            total = np.zeros((len(keys), values.shape[1]), np.int64)
            np.add.at(total, where, values[resident])
            made = [pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(np.bincount(where, minlength=len(keys)), pa.int64()), pa.array(list(total), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["part", "entry", "n", "total"])

        found = self.union(lambda table, since: _each(table, since, None, step, "part int, entry int, n long, total array<long>"))
        width = self.books[-1].shape[2]
        added = [F.sum(F.col("total")[i].cast("decimal(38,0)")).cast("string").alias(f"t{i}") for i in range(width)]
        return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added)

    def union(self, made: Callable[[DataFrame, list[np.ndarray]], DataFrame]) -> DataFrame:
        """``made(table, books since it was written)`` of all tables together."""
        found = [made(table, self.books[k + 1 :]) for k, table in enumerate(self.tables)]
        return reduce(DataFrame.union, found)


def codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(row, vec_id, label, code, error) of every row of ``prepared``, and the codebooks as (part, entry, component).

    Codebooks start as the vectors of the ``entries`` smallest ids (ties by content, null ids last; all, if there are
    fewer). Each round assigns parts to the nearest entry, ties to the lower index, and replaces entries by the floor of
    their members' mean; an entry without members stays. code has the indexes of a last assignment in two hex digits per
    part (four beyond 256 entries), error the squared distances summed over the parts.

    Vectors shorter than the longest, rounded up to a multiple of ``parts``, count as padded with zeros, empty ones too.
    Components beyond 2 ** 24 after scaling count as that. Repeated rows are coded each, repeated ids as well. No rows give no
    rows and empty codebooks. The driver holds the codebooks only: parts x entries x components of a part.
    """
    spark = vectors.sparkSession
    digits = 2 * max(1, -(-(max(2, entries) - 1).bit_length() // 8))
    seen = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    count, width = seen[0], -(-max(1, seen[1] or 0) // parts)
    if not count:
        return spark.createDataFrame([], "row long, vec_id long, label " + vectors.schema["label"].dataType.simpleString() + ", code string, error long"), np.zeros((parts, 0, width), np.int64)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector", "row").limit(entries).select("vector").collect()
    book = np.zeros((len(first), parts * width), np.int64)
    for k, r in enumerate(first):
        book[k, : len(r["vector"])] = r["vector"]
    book = np.ascontiguousarray(book.reshape(len(first), parts, width).transpose(1, 0, 2))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lists = batch.column("vector")
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((n, parts * width), np.int32)
            whole[np.arange(parts * width)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            pieces = whole.reshape(n, parts, width)
            for p in range(parts):
                index, _ = nearest(pieces[:, p].astype(np.int64), book[p])
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                values = pa.ListArray.from_arrays(offsets, pa.array(pieces[:, p].ravel()))
                made = [batch.column("row"), batch.column("vec_id"), pa.array(np.full(n, p, np.int32)), pa.array(index, pa.int32()), values]
                yield pa.RecordBatch.from_arrays(made, ["row", "vec_id", "part", "entry", "values"])

    members = Members(parts, max(1, math.ceil(count / OWNER_ROWS)), max(1, math.ceil(count * parts / PARTITION_ROWS), spark.sparkContext.defaultParallelism))
    members.settle(vectors.select("row", F.col("vec_id").cast("long").alias("vec_id"), "vector").mapInArrow(cut, MEMBER), book)
    for k in range(rounds):
        if k:
            members.settle(members.movers(book), book)
        new = book.copy()
        for r in members.sums().collect():  # one row per entry
            new[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
        book = new

    def last(batch, values, resident, now, distance):
        kept = batch.filter(pa.array(resident))
        made = [kept.column("row"), kept.column("part"), pa.array(now[resident], pa.int32()), pa.array(distance[resident], pa.int64())]
        yield pa.RecordBatch.from_arrays(made, ["row", "part", "entry", "error"])

    final = members.union(lambda table, since: _each(table, since, book, last, "row long, part int, entry int, error long"))
    texts = F.array_sort(F.collect_list(F.struct("part", F.lower(F.lpad(F.hex("entry"), digits, "0")).alias("x"))))
    coded = final.groupBy("row").agg(F.concat_ws("", F.transform(texts, lambda s: s["x"])).alias("code"), F.sum("error").alias("error"))
    return keep(vectors.select("row", "vec_id", "label").join(coded, "row"), "codes"), book


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: error summed over rows of the same label, nulls together. Labels that repeat are summed before anything is joined."""
    totals = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "__label")
    return coded.join(few(totals), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")


def digest(book: np.ndarray) -> str:
    """sha256 of all components in the order part, entry, position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
