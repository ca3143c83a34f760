"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.session import ensure_checkpoint_dir

# Words are runs of anything but a space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of text that a Python task holds at once, besides one document.
BATCH_BYTES = 8 << 20
# Bytes of a batch that an executor sends to a Python task. Spark's 64 MB are held several times over, outside the heap.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below the checkpoint folder, which the driver and all executors reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def keep(df: DataFrame, kind: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: the lineage ends there and survives lost executors.

    Meanwhile Python tasks get batches of ``ARROW_BYTES``, unless the session says how large they are.
    """
    folder = shared_folder(df.sparkSession, kind)
    conf, bytes_per_batch = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    own = conf.get(bytes_per_batch, None) is None
    if own:
        conf.set(bytes_per_batch, str(ARROW_BYTES))
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        if own:
            conf.unset(bytes_per_batch)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def few(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most_rows`` rows (counted now); otherwise Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= most_rows else df


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in no fold and gives null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of the columns. Rows that agree in both are taken to be equal in all of them."""
    return [F.xxhash64(*columns).alias("__k1"), F.xxhash64(F.lit("second"), *columns).alias("__k2")]


def text_batches(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts Arrow batches so that each holds about ``BATCH_BYTES`` of ``column`` at most, or one row."""
    for batch in batches:
        start, size = 0, 0
        values = batch.column(column)
        lengths = pa.compute.binary_length(values).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > BATCH_BYTES:
                part = batch.slice(start, i - start)
                yield part, part.column(column).to_pylist()
                start, size = i, 0
            size += n
        if start < len(lengths):
            part = batch.slice(start)
            yield part, part.column(column).to_pylist()
        pa.default_memory_pool().release_unused()  # a worker outlives its task and would keep what earlier batches took
