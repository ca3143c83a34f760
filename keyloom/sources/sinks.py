"""Write-once tables, CSV and JSON output, and content fingerprints."""

from __future__ import annotations

import hashlib
import sys
import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.hashing import hash_word, sized_cell
from keyloom.session import ship_with_tasks


ship_with_tasks(sys.modules[__name__])


def row_digest(cols: Sequence[str]) -> Column:
    """Digest of one row. Each cell is its length, a colon and its text, or ``n`` for NULL, so different rows never read alike."""
    return F.md5(F.concat(F.lit(""), *[sized_cell(F.col(c)) for c in cols]))


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row count and content digest, independent of row order and partitioning.

    Row digests are added up word by word as decimals, which no number of rows overflows, so the aggregation keeps five
    numbers per task. Include a position column to make the order count.
    """
    cols = list(cols or df.columns)
    digests = df.select(row_digest(cols).alias("d"))
    sums = digests.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(hash_word(F.col("d"), w).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"w{w}") for w in range(4)],
    )
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", "w0", "w1", "w2", "w3"), 256).alias("fingerprint"))


def _digest_of_sums(*columns: str) -> Column:
    """Digest of a number of rows and the sums of their digests' words."""
    return F.sha2(F.concat_ws("|", *columns, "w0", "w1", "w2", "w3"), 256)


def bucket_digests(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """``(bucket, rows, digest)``: leaves of a hash tree. A row's bucket is how its digest begins (``digits`` hex digits).

    Digests do not depend on the order of rows or their partitions; one row per bucket and task is exchanged.
    """
    digests = df.select(row_digest(list(cols or df.columns)).alias("d"))
    sums = digests.groupBy(F.substring("d", 1, digits).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(hash_word(F.col("d"), w).cast("decimal(38,0)")).cast("string").alias(f"w{w}") for w in range(4)],
    )
    return sums.select("bucket", "rows", _digest_of_sums("bucket", "rows").alias("digest"))


def root_digest(buckets: DataFrame) -> DataFrame:
    """``(rows, fingerprint)`` of the tree over :func:`bucket_digests`: buckets in order, a fixed number at most."""
    leaves = F.array_sort(F.collect_list(F.struct("bucket", "digest")))
    return buckets.agg(
        F.coalesce(F.sum("rows"), F.lit(0).cast("long")).alias("rows"),
        F.sha2(F.concat_ws("|", F.transform(leaves, lambda x: F.concat(x["bucket"], F.lit(":"), x["digest"]))), 256).alias("fingerprint"),
    )


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(bucket, rows_before, rows_after)`` of the buckets in which two tables differ; which rows did is found inside these."""
    both = before.select("bucket", F.col("rows").alias("rows_before"), F.col("digest").alias("was")).join(
        after.select("bucket", F.col("rows").alias("rows_after"), F.col("digest").alias("is")), "bucket", "full"
    )
    differ = both.where(~F.col("was").eqNullSafe(F.col("is")))
    return differ.select("bucket", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("rows_before", "rows_after")])


# Files of more bytes than this are hashed in parts.
WHOLE_BYTES = 16 << 20
LINE_END = b"\n"
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
# How the name of a file ends that a codec could claim: a reader of lines unpacks files by it.
EXTENSION = r"\.[A-Za-z][A-Za-z0-9]*$"


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(file, bytes, sha256)`` of every file below ``path``, hashed byte by byte in the tasks. Empty
    files are not listed. Files above ``WHOLE_BYTES`` may have any size: a task holds a batch of their lines, or one line."""

    def read(kind: str, **options: str) -> DataFrame:
        return spark.read.format(kind).options(recursiveFileLookup="true", pathGlobFilter=pattern, **options).load(path)

    files = read("binaryFile")
    small, large = files.where(F.col("length") <= WHOLE_BYTES), files.where(F.col("length") > WHOLE_BYTES)
    whole = small.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    endings = [r[0] for r in large.select(F.regexp_extract("_metadata.file_name", EXTENSION, 0)).distinct().collect()]
    if not endings:
        return whole
    hashed = reduce(DataFrame.union, [_large_files(read, ending) for ending in sorted(endings)]).mapInArrow(_hash_lines, "uri string, sha256 string")
    listed = large.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("uri"))
    return whole.union(listed.join(hashed, "uri").select("file", "bytes", "sha256"))


def _large_files(read: Callable[..., DataFrame], ending: str) -> DataFrame:
    """``(uri, size, line)`` of the files above ``WHOLE_BYTES`` whose names end so, each with its lines in order in one partition.

    A codec that passes bytes through, and cannot start amid a file, is put in charge of the ending: such a file is read as
    it is, by one task, and nothing is exchanged. Names without an ending have no codec. Their files are read in splits, whose
    lines are put in order again.
    """
    codec = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
    # the key as Hadoop has it, and as it is in the Hadoop that comes with Spark, where packages are renamed
    codec |= {f"{prefix}io.compress.passthrough.extension": ending for prefix in ("", "org.apache.hadoop.shaded.")}
    lines = read("text", lineSep=LINE_END.decode(), **(codec if ending else {}))
    name = F.col("_metadata.file_name")
    lines = lines.where((F.col("_metadata.file_size") > WHOLE_BYTES) & (name.endswith(ending) if ending else ~name.rlike(EXTENSION)))
    place = [] if ending else [F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")]
    lines = lines.select(
        F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_size").alias("size"), *place,
        F.concat(F.col("value").cast("binary"), F.lit(LINE_END)).alias("line"),
    )
    return lines if ending else lines.repartition("uri").sortWithinPartitions("uri", "block", "place").select("uri", "size", "line")


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(uri, sha256)`` of files whose lines follow each other, each ending in a line feed. A byte order mark is no part of the
    first line, and the last one may lack the line feed in the file: what is missing from the file's size tells both."""
    uri, size, seen, plain, marked = None, 0, 0, None, None

    def digest() -> pa.RecordBatch:
        missing = size - seen
        if missing not in (0, -len(LINE_END), len(BYTE_ORDER_MARK), len(BYTE_ORDER_MARK) - len(LINE_END)):
            raise RuntimeError(f"{uri} has {size} bytes, but its lines have {seen}: it was not read as it is, or by several tasks")
        hasher = marked if missing > 0 else plain
        if missing in (0, len(BYTE_ORDER_MARK)):
            hasher.update(LINE_END)
        return pa.RecordBatch.from_pydict({"uri": [uri], "sha256": [hasher.hexdigest()]})

    for batch in (b for b in batches if b.num_rows):
        lines = batch.column("line").cast(pa.binary())
        starts = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
        text, runs, first = memoryview(lines.buffers()[2]), pa.compute.run_end_encode(batch.column("uri")), 0
        for file, last in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            if file != uri:
                if uri is not None:
                    yield digest()
                uri, size, seen, plain, marked = file, batch.column("size")[first].as_py(), 0, hashlib.sha256(), hashlib.sha256(BYTE_ORDER_MARK)
            for hasher in (plain, marked):
                if seen:
                    hasher.update(LINE_END)
                hasher.update(text[starts[first] : starts[last] - len(LINE_END)])
            seen, first = seen + int(starts[last] - starts[first]), last
    if uri is not None:
        yield digest()


def _file_system(df: DataFrame, path: str):
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = (), source: str | None = None) -> DataFrame:
    """Materialises ``df`` as Parquet unless a complete copy is there; an incomplete copy is set aside, not deleted.

    ``source`` says what the copy was made from (a fingerprint, limits, a version). It is kept in a manifest beside the copy;
    a complete copy made from something else is refused. Without it, only the columns are compared.
    """
    spark = df.sparkSession
    files, target = _file_system(df, path)
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    made_from = f"{source or ''}\n{', '.join(sorted(f'{name} {kind}' for name, kind in df.dtypes))}"
    digest = hashlib.sha256(made_from.encode()).hexdigest()
    manifest = f"{path}.manifest"
    if files.exists(target):
        if files.exists(new_path(target, "_SUCCESS")) and files.exists(new_path(new_path(manifest), "_SUCCESS")):
            kept = spark.read.text(manifest).first()[0]
            if kept != digest:
                raise RuntimeError(f"{path} was made from another source: its manifest has {kept[:12]}, not {digest[:12]}")
            return spark.read.parquet(path)
        files.rename(target, new_path(f"{path}.incomplete-{time.time_ns()}"))
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(manifest)
    return spark.read.parquet(path)


def write_bucketed_once(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Materialises ``df`` as a table bucketed by key, so that later joins on the key need no shuffle. Its files lie in
    ``path``, if given, else in the warehouse."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        writer = df.repartition(buckets, key).write.mode("errorifexists").bucketBy(buckets, key).sortBy(key)
        (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


@F.pandas_udf(T.StringType())
def significant(values: pd.Series) -> pd.Series:
    """Numbers with 8 significant digits, rounded from their exact binary value; NaN becomes NULL.

    The JVM formatter rounds the shortest decimal form instead, which differs in the last digit on ties.
    """
    return values.map(lambda v: None if pd.isna(v) else f"{v:.8g}").astype(object)


def printable(df: DataFrame) -> DataFrame:
    """Cells as they are written: short floats, booleans as 0 and 1, NaN as NULL, nested values as JSON."""
    cells = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.FloatType | T.DoubleType):
            column = significant(column.cast("double"))
        elif isinstance(field.dataType, T.BooleanType):
            column = column.cast("int")
        elif isinstance(field.dataType, T.ArrayType | T.StructType | T.MapType):
            column = F.to_json(column)
        cells.append(column.alias(field.name))
    return df.select(*cells)


def union_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their columns; missing cells are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Writes a new table; text formats get :func:`printable` cells. Existing output is never replaced."""
    if fmt == "parquet":
        df.write.mode("errorifexists").parquet(path)
    elif fmt == "csv":
        printable(df).write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")
    elif fmt == "json":
        df.write.mode("errorifexists").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
