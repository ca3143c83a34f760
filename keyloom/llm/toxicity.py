"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from labels of whole documents."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import keep, text_batches

LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
# Words of a piece.
LEAST_WORDS, MOST_WORDS = 10, 40
# A word is seen as itself and by its beginnings, since insults share stems.
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
SLOTS = 1 << 20
START_BIAS = -6.0
# A slot is used if so many sampled documents have it, fewer if fewer than ten times as many are toxic, but two at least; it
# starts at its log odds above START_ODDS, up to START_MOST.
LEAST_DOCUMENTS, START_ODDS, START_MOST = 5, 1.5, 5.0


def pieces(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of every sentence, as positions in ``text``.

    Sentences of fewer than ``LEAST_WORDS`` words are joined with those after them, so that a text of one-word sentences
    has no more pieces than others; a sentence without an end is scored in parts of ``MOST_WORDS`` words.
    """
    begin, words = 0, []
    for sentence in SENTENCE.finditer(text):
        start, end = sentence.span()
        if not words:
            begin = start
        words += LETTERS.findall(text[start:end].lower())
        if len(words) > MOST_WORDS:
            found = list(LETTERS.finditer(text, begin, end))
            cuts = range(0, len(found) - LEAST_WORDS, MOST_WORDS)
            for i, j in zip(cuts, [*cuts[1:], len(found)], strict=True):
                yield found[i].start(), found[j - 1].end(), [m.group().lower() for m in found[i:j]]
            words = []
        elif len(words) >= LEAST_WORDS:
            yield begin, end, words
            words = []
    if words:
        yield begin, len(text), words


def word_slots(word: str) -> list[int]:
    """Weights that a word uses: a hash of itself and of each beginning shorter than it."""
    seen = ["=" + word, *("^" + word[:n] for n in STEM_LENGTHS if len(word) > n)]
    return [zlib.crc32(s.encode()) & (SLOTS - 1) for s in seen]


def _bags(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all pieces, slots per piece, pieces per document (one empty piece at least)."""
    cache: dict[str, list[int]] = {}
    slots, sizes, counts = [], [], []
    for text in texts:
        n = 0
        for _, _, words in pieces(text):
            mine: set[int] = set()
            for word in set(words):
                if word not in cache:
                    cache[word] = word_slots(word)
                mine.update(cache[word])
            slots.extend(sorted(mine))
            sizes.append(len(mine))
            n += 1
        if n == 0:
            sizes.append(0)
            n = 1
        counts.append(n)
    return np.array(slots, np.int64), np.array(sizes, np.int64), np.array(counts, np.int64)


def _batches(texts: list[str], toxic: np.ndarray, rows: int = 32) -> list[tuple]:
    out = []
    for i in range(0, len(texts), rows):
        slots, sizes, counts = _bags(texts[i : i + rows])
        used, where = np.unique(slots, return_inverse=True)
        out.append((used, where.astype(np.int32), sizes, counts, toxic[i : i + rows].astype(float)))
    return out


def slot_counts(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Clean and toxic documents that have each slot."""
    counts = np.zeros((2, SLOTS))
    for text, y in zip(texts, toxic, strict=True):
        counts[y][np.unique(_bags([text])[0])] += 1
    return counts


def start_weights(counts: np.ndarray, clean: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights to start from, and which slots are used at all: rare ones would only fit single documents."""
    used = counts.sum(axis=0) >= min(LEAST_DOCUMENTS, max(2, toxic // 10))
    odds = np.log((counts[1] + 0.5) / (toxic + 1)) - np.log((counts[0] + 0.5) / (clean + 1))
    return np.where(used, np.clip(odds - START_ODDS, 0, START_MOST), 0), used


def fit_shard(texts: list[str], toxic: np.ndarray, weights: np.ndarray, bias: float, squares: np.ndarray, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """A few passes of adaptive gradient steps over one shard of the training documents; ``squares`` is updated in place."""
    weights, bias_square = weights.copy(), 1.0
    batches = _batches(texts, toxic)
    for _ in range(epochs):
        for used, where, sizes, counts, y in batches:
            w = weights[used]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            z = bias + np.bincount(owner, w[where], len(sizes))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            doc = np.repeat(np.arange(len(counts)), counts)
            clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(counts)))
            # d loss / d z: p for a clean document, -p (1 - P) / P for a toxic one
            pull = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-9), 1.0)
            step = p * pull[doc]
            g = np.bincount(where, step[owner], len(used)) / len(y) + decay * w
            squares[used] += g * g
            weights[used] = w - rate * g / np.sqrt(squares[used] + 1e-8)
            b = step.sum() / len(y)
            bias_square += b * b
            bias -= 0.1 * rate * b / math.sqrt(bias_square)
    return weights, bias


class PieceScorer:
    """Scores pieces with fitted weights; remembers the score of words, forgets all when there are too many."""

    MOST_WORDS = 200_000

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= self.MOST_WORDS:
                self.known.clear()
            value = self.known[word] = float(self.weights[word_slots(word)].sum())
        return value

    def document(self, text: str, spans_from: float = 2.0) -> tuple[float, list[dict]]:
        """Noisy-or over the pieces, and the pieces whose own score is ``spans_from`` or more."""
        log_clean, spans, word = 0.0, [], self.word
        for start, end, words in pieces(text):
            z = self.bias + sum(map(word, set(words)))
            z = min(z, 30.0)
            log_clean -= math.log1p(math.exp(z))
            if z > 0 and (p := 1 / (1 + math.exp(-z))) >= spans_from:
                spans.append({"start": start, "end": end, "score": p})
        return -math.expm1(log_clean), spans


def fit(
    docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", row: str = "doc_id",
    max_toxic: int = 4000, max_clean: int = 8000, shards: int = 6, rounds: int = 2, epochs: int = 2, rate: float = 0.3, decay: float = 1e-5,
) -> tuple[np.ndarray, float]:
    """Learns the weights from labels of whole documents (1 toxic, 0 clean; other labels and null ids are ignored).

    The sample is bounded: of the labelled ids that ``docs`` has, at most ``max_toxic`` and ``max_clean``, those whose hash
    is lowest; ids with both labels count as toxic, repeated documents of an id count once, null texts are empty. It is
    written once in ``shards`` parts. Every part counts the documents per slot, which gives the start; in every round each
    part takes ``epochs`` passes from the shared weights, and the weights (a fixed number of slots) are averaged. Without
    toxic or without clean rows all weights stay zero and all scores are low.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(row).isNotNull()).groupBy(F.col(row).alias("row")).agg(F.max(toxic).cast("int").alias("toxic"))
    known = known.join(docs.select(F.col(row).alias("row")).where("row is not null").distinct(), "row", "left_semi")
    known = known.withColumn("rank", F.xxhash64(F.lit("fit"), "row"))
    chosen = known.where("toxic = 1").orderBy("rank", "row").limit(max_toxic).union(known.where("toxic = 0").orderBy("rank", "row").limit(max_clean))
    # the two limits bound what is broadcast
    texts = docs.select(F.col(row).alias("row"), F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), "row")
    sample = texts.groupBy("row", "toxic", "rank").agg(F.min("text").alias("text"))
    sample = sample.withColumn("shard", F.pmod(F.shiftright("rank", 8), F.lit(shards)).cast("int"))
    sample = keep(sample.repartition(shards, "shard"), "toxicity-sample")
    weights, bias = np.zeros(SLOTS, np.float32), START_BIAS
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return weights, bias

    def ordered(part: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        part = part.sort_values(["rank", "row"], kind="stable")
        return part["text"].tolist(), part["toxic"].to_numpy()

    def count(part: pd.DataFrame) -> pd.DataFrame:
        found = slot_counts(*ordered(part))
        return pd.DataFrame({"label": [0, 1], "counts": [zlib.compress(row.astype(np.int32).tobytes(), 1) for row in found]})

    counts = np.zeros((2, SLOTS))
    for part in sample.groupBy("shard").applyInPandas(count, "label int, counts binary").collect():
        counts[part["label"]] += np.frombuffer(zlib.decompress(part["counts"]), np.int32)
    start, used = start_weights(counts, sizes[0], sizes[1])
    weights, fixed = start.astype(np.float32), np.packbits(~used)
    for _ in range(rounds):
        at = spark.sparkContext.broadcast((weights, bias, fixed))  # SLOTS numbers, whatever the input

        def local(part: pd.DataFrame) -> pd.DataFrame:
            begin, b, held = at.value
            squares = np.where(np.unpackbits(held, count=SLOTS), 1e30, 1e-4)
            new, b = fit_shard(*ordered(part), begin.astype(float), b, squares, epochs, rate, decay)
            return pd.DataFrame({"n": [len(part)], "bias": [b], "weights": [zlib.compress(new.astype(np.float32).tobytes(), 1)]})

        parts = sample.groupBy("shard").applyInPandas(local, "n long, bias double, weights binary").collect()
        whole, mean, bias = sum(p["n"] for p in parts), np.zeros(SLOTS), 0.0
        for p in sorted(parts, key=lambda p: (p["n"], p["bias"])):
            mean += np.frombuffer(zlib.decompress(p["weights"]), np.float32) * (p["n"] / whole)
            bias += p["bias"] * p["n"] / whole
        weights = mean.astype(np.float32)
        at.unpersist()
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = 0.7, span_threshold: float = 0.5) -> DataFrame:
    """All columns of ``docs`` but the text, and score (0 to 1), predicted (1 from ``threshold`` on), spans.

    spans lists the offending sentences (start, end as character positions, score). Whole texts are scored; a null or
    empty text has no sentence and scores 0. Columns named like the new ones are replaced.
    """
    new = "score double, predicted int, spans array<struct<start:int,end:int,score:double>>"
    others = [c for c in docs.columns if c not in (text, "score", "predicted", "spans")]
    source = docs.select(*others, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch, texts in text_batches(batches, "__text"):
            scorer = scorer or PieceScorer(shared.value[0].astype(float), shared.value[1])
            found = [scorer.document(t or "", span_threshold) for t in texts]
            scores = [s for s, _ in found]
            spans = pa.array([x for _, x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            columns = [batch.column(c) for c in others] + [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), spans]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "score", "predicted", "spans"])

    return source.mapInArrow(run, f"{fields}, {new}" if fields else new)


