"""Review lines: one JSON object per line, read with a position that follows file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.ordering import ordered
from keyloom.sources.sinks import table_fingerprint


def with_position(lines: DataFrame) -> DataFrame:
    """Adds ``seq``, which orders lines by file, then by place in the file, whatever split was read by which task."""
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select(seq.alias("seq"), "value")


def read_review_lines(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Raw lines ``(seq, value)``, the first ``max_records`` of them if given."""
    lines = with_position(spark.read.text(path))
    return lines if max_records is None else head_records(lines, max_records)


def head_records(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The first ``n`` records in source order.

    Positions of :func:`with_position` are counted per file and split, which tells how many records each split gives; no
    record is sorted. For numbers, an approximate quantile bounds what is sorted; others are sorted whole.
    """
    kind = df.schema[seq].dataType
    if isinstance(kind, T.StructType) and kind.names == ["file", "block", "line"]:
        splits = df.groupBy(f"{seq}.file", f"{seq}.block").agg(F.count(F.lit(1)).alias("__n"), F.min(f"{seq}.line").alias("__first"))
        before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split of a file
        splits = splits.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).where(F.col("__before") < n)
        splits = splits.select(F.col("file").alias("__file"), F.col("block").alias("__block"), (F.col("__first") + n - F.col("__before")).alias("__end"))
        there = (F.col(f"{seq}.file") == F.col("__file")) & (F.col(f"{seq}.block") == F.col("__block")) & (F.col(f"{seq}.line") < F.col("__end"))
        return df.join(splits, there, "left_semi")
    early = df
    if isinstance(kind, T.NumericType):
        total = df.agg(F.count(seq)).first()[0]
        if n < total:
            cut = df.agg(F.percentile_approx(seq, F.lit(min(1.0, n / total + 0.001)), F.lit(10_000))).first()[0]
            some = df.where(F.col(seq) <= F.lit(cut))
            early = some if some.agg(F.count(F.lit(1))).first()[0] >= n else df
    return ordered(early, [], [seq], rank="__nth").where(F.col("__nth") <= n).select(*df.columns)


def source_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """Line count and digest of a text source of any size."""
    return table_fingerprint(spark.read.text(path), ["value"])


FIELDS = ("rating", "user_id", "parent_asin", "title", "text")


def _number(json: Column) -> Column:
    return json.rlike("^-?[0-9]")


def _text(json: Column, text: Column) -> Column:
    """The field as text; NULL where it is absent, null, empty, zero, false or an empty list or object."""
    present = (
        F.when(json.startswith('"'), text != "")
        .when(_number(json), json.try_cast("double") != 0)
        .otherwise(~json.isin("null", "false", "[]", "{}"))
    )
    return F.when(present, F.coalesce(text, json))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Typed fields of each line's ``value``, other columns unchanged. A rating counts by its JSON type: ``"5"`` is none.

    Each field is taken out of the parsed line once, as JSON and as text; what follows are decisions on plain strings.
    """
    rest = [c for c in lines.columns if c != "value"]
    parsed = lines.select(*rest, F.try_parse_json("value").alias("json"))
    fields = [F.try_variant_get("json", f"$.{name}", "variant").alias(f"v_{name}") for name in FIELDS]
    time = F.try_variant_get("json", "$.timestamp", "long").alias("timestamp")
    is_object = F.coalesce(F.schema_of_variant("json").startswith("OBJECT"), F.lit(False)).alias("is_object")
    taken = parsed.select(*rest, is_object, time, *fields)
    plain = [F.to_json(f"v_{name}").alias(f"j_{name}") for name in FIELDS]
    plain += [F.try_variant_get(f"v_{name}", "$", "string").alias(f"s_{name}") for name in FIELDS[1:]]
    cells = taken.select(*rest, "is_object", "timestamp", *plain)
    number = F.when(_number(F.col("j_rating")), F.col("j_rating").try_cast("double"))
    rating = F.when(F.col("j_rating") == "true", 1.0).when(F.col("j_rating") == "false", 0.0).otherwise(number)
    texts = [_text(F.col(f"j_{name}"), F.col(f"s_{name}")).alias(name) for name in FIELDS[1:]]
    return cells.select(*rest, "is_object", rating.alias("rating"), *texts, "timestamp")
