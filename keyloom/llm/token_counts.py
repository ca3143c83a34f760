"""Token totals for every context limit from one exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import text_batches

# Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# White space as the pattern has it, in runs that are cut beforehand.
LONG_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
# Lengths are summed in blocks of so many values, so that no task reads the whole histogram.
BLOCK = 64


class Encoder:
    """Token counts of texts of any length. Long runs of white space, on which the pattern would backtrack too deeply, are
    cut as the pattern cuts them: the run without its last character is one piece, unless nothing follows."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})

    def length(self, text: str | None) -> int:
        total, at = 0, 0
        for run in LONG_BLANK.finditer(text or ""):
            end = run.end() if run.end() == len(text) else run.end() - 1
            total += len(self.own.encode_ordinary(text[at : run.start()])) + len(self.piece.encode_ordinary(text[run.start() : end]))
            at = end
        return total + len(self.own.encode_ordinary(text[at:])) if text else 0


def length_histogram(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Documents by encoded length: (n_tokens, n_docs).

    ``vocabulary`` is a file of byte-level BPE ranks that every executor can read at that path. Whole texts are
    encoded as ordinary text, long runs of one kind of character too; null and empty texts have zero tokens; repeated rows count as often as they occur.
    Each task sends one row per distinct length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, found = None, {}
        for _, texts in text_batches(batches, "text"):
            encoder = encoder or Encoder(vocabulary)
            lengths = np.array([encoder.length(t) for t in texts], np.int64)
            for n, c in zip(*np.unique(lengths, return_counts=True), strict=True):
                found[int(n)] = found.get(int(n), 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    return (
        docs.select(F.col(text).alias("text"))
        .mapInArrow(count, "n_tokens long, n_docs long")
        .groupBy("n_tokens")
        .agg(F.sum("n_docs").alias("n_docs"))
    )


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to every length L of the histogram what a context limit of L means.

    docs_at_least and tokens_at_least: documents of L tokens or more, and their tokens. tokens_truncated: all tokens
    that remain if each document is cut to L. quantile: share of documents with L tokens or fewer. An empty histogram
    gives no rows. Sums are built within blocks of lengths and then shifted by the sums of later blocks.
    """
    hist = histogram.withColumn("__block", F.expr(f"n_tokens div {BLOCK}")).withColumn("__tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    blocks = hist.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    blocks = blocks.select(
        "__block",
        F.coalesce(F.sum("__d").over(later), F.lit(0)).alias("__docs_after"),
        F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__tokens_after"),
        F.sum("__d").over(whole).alias("__docs_all"),
        F.sum("__t").over(whole).alias("__tokens_all"),
    )
    inside = Window.partitionBy("__block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.join(blocks, "__block")
        .withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("__docs_after"))
        .withColumn("tokens_at_least", F.sum("__tokens").over(inside) + F.col("__tokens_after"))
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("__tokens_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_truncated"),
            ((F.col("__docs_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("__docs_all")).alias("quantile"),
        )
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: (context, tokens_truncated, docs_cut), with one row per limit, also beyond every length.

    The total at a limit between two lengths follows from the suffix sums of the next length above it.
    """
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context long")
    above = sums.select("n_tokens", "docs_at_least", "tokens_at_least")
    total = sums.agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("__all"))
    matched = F.broadcast(wanted).join(above, F.col("n_tokens") > F.col("context"), "left")  # limits: a stated list
    first = matched.groupBy("context").agg(F.min(F.struct("n_tokens", "docs_at_least", "tokens_at_least")).alias("s"))
    return first.join(F.broadcast(total)).select(  # one row
        "context",
        (F.coalesce("__all", F.lit(0)) - F.coalesce("s.tokens_at_least", F.lit(0)) + F.col("context") * F.coalesce("s.docs_at_least", F.lit(0))).alias("tokens_truncated"),
        F.coalesce("s.docs_at_least", F.lit(0)).alias("docs_cut"),
    )
