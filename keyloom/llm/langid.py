"""Language of a text by interpolated Kneser-Ney models of characters, kept in sorted arrays of hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import keep, text_batches

ORDER = 4
UNKNOWN = "und"
SLICE = 1 << 19  # characters worked on at once
SPACE = 32
# Share of a language's documents that its rejection limit starts from, and steps of its histogram per nat.
USUAL, STEPS = 0.9, 100
# Letters that a character not seen in learning could be.
LETTERS = 1 << 16


class Alphabet:
    """Maps code points to lower-case letters below 2 ** 16, or to a space; built once per worker."""

    made: Alphabet | None = None

    def __init__(self) -> None:
        table = np.full(0x110000, SPACE, np.uint16)
        for p in range(0x32400):  # no letters stand above
            if (c := chr(p)).isalpha():
                low = c.lower()
                p_low = ord(low) if len(low) == 1 else p
                table[p] = p_low if p_low < 0xFFFF else 0xFFFF  # letters beyond the first plane share one code
        self.table = table

    @classmethod
    def get(cls) -> Alphabet:
        if cls.made is None:
            cls.made = cls()
        return cls.made


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    """(first text, carried characters, texts joined later) so that each has about SLICE characters; long texts alone, cut."""
    group, first, size = [], 0, 0
    for i, text in enumerate(texts):
        text = text or ""
        if len(text) > SLICE:
            if group:
                yield first, 0, group
            for k in range(0, len(text), SLICE):
                yield i, min(k, ORDER - 1), [text[max(0, k - ORDER + 1) : k + SLICE]]
            group, first, size = [], i + 1, 0
            continue
        if size + len(text) > SLICE and group:
            yield first, 0, group
            group, first, size = [], i, 0
        group.append(text)
        size += len(text)
    if group:
        yield first, 0, group


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of all texts packed into 64 bits, the text each belongs to, and its position in the joined text.

    Letters are lower-cased, everything between letters is one space, and each text has a space before and after it.
    """
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owners = np.repeat(np.arange(len(texts)), lengths + 1)
    code = np.empty(len(points) + 2, np.uint16)
    code[0] = code[-1] = SPACE
    code[1:-1] = Alphabet.get().table[points]
    kept = np.empty(len(code), bool)
    kept[0] = True
    kept[1:] = (code[1:] != SPACE) | (code[:-1] != SPACE)
    place = np.flatnonzero(kept)
    code = code[place].astype(np.uint64)
    owner = owners[np.maximum(place - 1, 0)]
    n = len(code) - 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the grams that end at the second, third, ... character; before the first of a text there are spaces only
    codes = np.concatenate([np.full(ORDER - 2, SPACE, np.uint64), code])
    whose = np.concatenate([np.full(ORDER - 2, -1), owner])
    packed = np.zeros(n, np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(16)) | np.where(whose[k : k + n] == owner[1:], codes[k : k + n], np.uint64(SPACE))
    return packed, owner[1:], place[1:]


def _mix(grams: np.ndarray) -> np.ndarray:
    """A one-to-one hash of 64 bits."""
    x = grams ^ (grams >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@dataclass
class HashArray:
    """Sorted hashes with one row of values each, and where every leading-bits range begins."""

    grams: np.ndarray
    values: np.ndarray
    hashes: np.ndarray = field(init=False)
    shift: int = field(init=False)
    starts: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        hashes = _mix(self.grams)
        order = np.argsort(hashes)
        self.hashes, self.grams, self.values = hashes[order], self.grams[order], self.values[order]
        bits = max(4, int(np.ceil(np.log2(len(hashes) + 1))) + 1)
        self.shift = 64 - bits
        self.starts = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(self.shift)).astype(np.int32)
        self.longest = int(np.diff(np.append(self.starts, len(hashes))).max(initial=0))

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Row of each gram, -1 if it is not there."""
        found = np.full(len(grams), -1, np.int32)
        if not len(self.hashes):
            return found
        h = _mix(grams)
        at = self.starts[(h >> np.uint64(self.shift)).astype(np.int64)]
        last = len(self.hashes) - 1
        left = None
        for step in range(self.longest):
            if left is None:
                here = np.minimum(at, last)
                hit = self.hashes[here] == h
                found[hit] = here[hit]
                left = np.flatnonzero(~hit)
            else:
                here = np.minimum(at[left] + step, last)
                there = self.hashes[here]
                hit = there == h[left]
                found[left[hit]] = here[hit]
                left = left[(there < h[left]) & ~hit]
            if not len(left):
                break
        return found


def _unpack(mask_order: int, grams: np.ndarray) -> np.ndarray:
    return grams & np.uint64((1 << (16 * mask_order)) - 1)


@dataclass
class Model:
    """logs[n] has log p(last character | the others) of n-grams for every language, backs[n] the log back-off of n-grams."""

    languages: list[str]
    logs: dict[int, HashArray]
    backs: dict[int, HashArray]
    floor: np.ndarray
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sharpness: float = 1.0

    def parts(self) -> tuple:
        """Plain arrays that a broadcast can hold; a class would have to be installed where they are read."""
        tables = [{n: (t.grams, t.values) for n, t in held.items()} for held in (self.logs, self.backs)]
        return self.languages, *tables, self.floor, self.limits, self.sharpness

    @staticmethod
    def of(parts: tuple) -> Model:
        languages, logs, backs, floor, limits, sharpness = parts
        tables = [{n: HashArray(*t) for n, t in held.items()} for held in (logs, backs)]
        return Model(languages, *tables, floor, limits, sharpness)

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """One row per gram, one column per language, by backing off from four characters to one and to none."""
        out = np.empty((len(grams), len(self.languages)), np.float32)
        rest, extra = np.arange(len(grams)), None
        for n in range(ORDER, 0, -1):
            mine = grams if n == ORDER else _unpack(n, grams[rest])
            row = self.logs[n].find(mine)
            hit = row >= 0
            values = self.logs[n].values[row[hit]]
            out[rest[hit]] = values if extra is None else values + extra[hit]
            if hit.all():
                return out
            miss = ~hit
            rest = rest[miss]
            extra = np.zeros((len(rest), len(self.languages)), np.float32) if extra is None else extra[miss]
            if n > 1:
                context = mine[miss] >> np.uint64(16)
                back = self.backs[n - 1].find(context)
                known = back >= 0
                extra[known] += self.backs[n - 1].values[back[known]]
        out[rest] = self.floor + extra
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character of every text under every language, and the number of characters."""
        total = np.zeros((len(texts), len(self.languages)))
        counted = np.zeros(len(texts), np.int64)
        for first, carried, group in _slices(texts):
            grams, owner, place = _grams(group)
            if carried:  # a later part of a long text: its first characters are context only
                grams, owner = grams[place > carried], owner[place > carried]
            if not len(grams):
                continue
            logs = self.log_p(grams)
            begins = np.flatnonzero(np.diff(owner, prepend=-1))
            total[first + owner[begins]] -= np.add.reduceat(logs, begins, axis=0, dtype=np.float64)
            counted += np.bincount(first + owner, minlength=len(texts))
        return total / np.maximum(counted, 1)[:, None], counted


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of character 4-grams by language over all given documents: (lang, gram, n). Null languages are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            grams = np.concatenate([g for g, _ in parts])
            order = np.argsort(grams, kind="stable")
            grams, n = grams[order], np.concatenate([c for _, c in parts])[order]
            begins = np.flatnonzero(np.diff(grams, prepend=~grams[:1]) != 0) if len(grams) else np.zeros(0, np.int64)
            return grams[begins], np.add.reduceat(n, begins) if len(begins) else n

        def rows(name, parts):
            grams, n = merged(parts)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

        for batch, texts in text_batches(batches, "text"):
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column("lang").to_pylist(), texts, strict=True):
                if t:
                    by.setdefault(name, []).append(t)
            for name, mine in by.items():
                for _, carried, group in _slices(mine):
                    grams, _, place = _grams(group)
                    grams = grams[place > carried] if carried else grams
                    held.setdefault(name, []).append(np.unique(grams, return_counts=True))
                if sum(len(g) for g, _ in held[name]) > 2_000_000:
                    held[name] = [merged(held[name])]
                    if len(held[name][0][0]) > 1_000_000:  # a task holds a bounded number of grams
                        yield rows(name, held.pop(name))
        for name, parts in held.items():
            yield rows(name, parts)

    source = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return source.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _kneser_ney(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> tuple[dict, dict, float]:
    """Per order: grams with probabilities, and contexts with back-off weights, of one language."""
    tables = {ORDER: (grams, counts.astype(float))}
    for n in range(ORDER - 1, 0, -1):  # below the top, a gram counts once per different character before it
        above = tables[n + 1][0]
        tables[n] = tuple(x.astype(t) for x, t in zip(np.unique(_unpack(n, above), return_counts=True), (np.uint64, float), strict=True))
    probabilities: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    backs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    uniform = 1.0 / alphabet
    lowest = uniform
    for n in range(1, ORDER + 1):
        g, c = tables[n]
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context, where = np.unique(g >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(where, c), np.bincount(where)
        back = discount * kinds / total
        if n == 1:
            lower = np.full(len(g), uniform)
            lowest = float(back[0]) * uniform if len(back) else uniform
        else:
            shorter, p = probabilities[n - 1]
            lower = p[np.searchsorted(shorter, _unpack(n - 1, g))]
            backs[n - 1] = (context, back)
        probabilities[n] = (g, np.maximum(c - discount, 0) / total[where] + back[where] * lower)
    return probabilities, backs, lowest


def build(counts: DataFrame) -> Model | None:
    """The models of all languages from complete counts; None if there is no text at all.

    Languages stand in code point order. No gram and no language is left out, so discounts and continuation counts are
    those of all counts. The model has one number per n-gram and language, and the driver and every task hold it whole.
    """
    table = counts.where("n > 0").toPandas()
    if not len(table):
        return None
    names = sorted(set(table["lang"]))
    parts = {}
    for name, mine in table.groupby("lang"):
        mine = mine.sort_values("gram")
        g = mine["gram"].to_numpy().view(np.uint64)
        order = np.argsort(g)
        parts[name] = _kneser_ney(g[order], mine["n"].to_numpy()[order], LETTERS)
    floor = np.array([np.log(parts[name][2]) for name in names], np.float32)
    logs: dict[int, HashArray] = {}
    backs: dict[int, HashArray] = {}
    empty = HashArray(np.zeros(0, np.uint64), np.zeros((0, len(names)), np.float32))
    for n in range(1, ORDER):  # back-off weights; a context that a language has not seen costs nothing
        every = np.unique(np.concatenate([parts[name][1][n][0] for name in names]))
        values = np.zeros((len(every), len(names)), np.float32)
        for k, name in enumerate(names):
            context, back = parts[name][1][n]
            values[np.searchsorted(every, context), k] = np.log(back)
        backs[n] = HashArray(every, values)
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([parts[name][0][n][0] for name in names]))
        if n == 1:
            values = np.tile(floor, (len(every), 1))
        else:
            lower = Model(names, {**logs, **{k: empty for k in range(n, ORDER + 1)}}, {**backs, **{k: empty for k in range(n, ORDER)}}, floor)
            values = lower.log_p(every)  # what backing off gives where a language has not seen the gram
            back = backs[n - 1].find(every >> np.uint64(16))
            known = back >= 0
            values[known] += backs[n - 1].values[back[known]]
        for k, name in enumerate(names):
            g, p = parts[name][0][n]
            values[np.searchsorted(every, g), k] = np.log(p)
        logs[n] = HashArray(every, values)
    return Model(names, logs, backs, floor)


def _usual(docs: DataFrame, shared: Broadcast[tuple]) -> dict[int, float]:
    """Per language with documents of 20 letters or more whose label is predicted: the entropy that ``USUAL`` of them stay below."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        names = np.array(model.languages, object)
        for batch, texts in text_batches(batches, "text"):
            nats, n = model.entropies(texts)
            choice = nats.argmin(axis=1)
            agree = (n >= 20) & (names[choice] == np.array(batch.column("lang").to_pylist(), object))
            steps = np.floor(nats.min(axis=1)[agree] * STEPS).astype(np.int64)
            found, times = np.unique(np.stack([choice[agree], steps], axis=1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(times)], ["k", "step", "n"])

    histogram = docs.mapInArrow(count, "k long, step long, n long").groupBy("k", "step").agg(F.sum("n").alias("n")).toPandas().sort_values(["k", "step"])
    usual = {}
    for k, mine in histogram.groupby("k"):
        below = mine["n"].to_numpy().cumsum()
        usual[int(k)] = float(mine["step"].to_numpy()[np.searchsorted(below, USUAL * below[-1])] + 1) / STEPS
    return usual


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", row: str = "doc_id", calibration_rows: int = 4000, slack: float = 2.0) -> Model | None:
    """Counts all of ``docs``, builds the models and calibrates them, scores on ``calibration_rows`` documents of lowest hash.

    The entropy above which a text is rejected is, per language, that which ``USUAL`` of all documents of 20 letters or more
    stay below, plus ``slack`` nats; documents count if their label is the language predicted for them. So wrongly labelled
    junk does not set it. How sharply scores follow differences of entropy is the sharpness of highest likelihood on the
    sample. Null and empty texts and null languages are not learned from.
    """
    model = build(keep(gram_counts(docs, text, lang), "langid-grams"))
    if model is None:
        return None
    chosen = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(row).alias("row"), F.col(lang).alias("lang"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("calibrate"), "row"), "row").limit(calibration_rows).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # n-grams times languages

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Model.of(shared.value)
        for frame in frames:
            nats, n = held.entropies(frame["text"].tolist())
            yield pd.DataFrame({"lang": frame["lang"], "n": n, "nats": list(nats)})

    texts = docs.select(F.col(row).alias("row"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), ["row", "lang"])
    sample = texts.groupBy("row", "lang").agg(F.min("text").alias("text"))  # an id that is repeated counts once
    rows = [r for r in sample.mapInPandas(measure, "lang string, n long, nats array<double>").collect() if r["n"] > 0]
    known = {name: k for k, name in enumerate(model.languages)}
    nats = np.array([r["nats"] for r in rows]).reshape(len(rows), len(known))
    truth = np.array([known.get(r["lang"], -1) for r in rows], int)
    n = np.array([r["n"] for r in rows], int)
    usual = _usual(docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null"), shared)
    fallback = max(usual.values(), default=np.log(2**16))
    model.limits = np.array([usual.get(k, fallback) + slack for k in range(len(known))])
    levels = 2.0 ** np.arange(-2, 9)
    if len(rows):
        inside = truth >= 0
        chances = [np.log(_posterior(nats[inside], n[inside], s)[np.arange(inside.sum()), truth[inside]] + 1e-9).sum() for s in levels]
        model.sharpness = float(levels[int(np.argmax(chances))])
    shared.unpersist()
    return model


def _posterior(nats: np.ndarray, n: np.ndarray, sharpness: float) -> np.ndarray:
    """Share of each language; differences count more in longer texts, up to 100 characters."""
    weight = sharpness * np.minimum(n, 100)[:, None] / 10
    x = np.exp(-np.minimum(weight * (nats - nats.min(axis=1, keepdims=True)), 700))
    return x / x.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None, text: str = "text", new: tuple[str, str, str, str] = ("lang_pred", "score", "nats", "rejected"), keep_text: bool = False) -> DataFrame:
    """All columns of ``docs``, the text only if asked for, and lang_pred, score, nats, rejected (under the names in ``new``).

    lang_pred is the language of lowest cross-entropy per character over the whole text (ties: first by code point); ``und``
    with score 0 if the text is null or has no letter, or if nothing was learned. score is its calibrated share. rejected:
    ``und``, or a text whose entropy is above its language's limit. Columns named like the new ones are replaced.
    """
    others = [c for c in docs.columns if c not in new and (keep_text or c != text)]
    source = docs.select(*others, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    shared = docs.sparkSession.sparkContext.broadcast(model.parts() if model else None)  # n-grams times languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value) if shared.value else None
        for batch, texts in text_batches(batches, "__text"):
            if model is None:
                names, score, best, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                nats, n = model.entropies(texts)
                choice = nats.argmin(axis=1)
                best = nats[np.arange(len(texts)), choice]
                some = n > 0
                names = [model.languages[k] if s else UNKNOWN for k, s in zip(choice, some, strict=True)]
                score = np.where(some, _posterior(nats, n, model.sharpness)[np.arange(len(texts)), choice], 0.0)
                out = ~some | (best > model.limits[choice])
            columns = [batch.column(c) for c in others] + [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64()), pa.array(out, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, *new])

    return source.mapInArrow(run, ", ".join([*fields, *(f"`{c}` {kind}" for c, kind in zip(new, ("string", "double", "double", "boolean"), strict=True))]))


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is rejected; columns as they are."""
    new = ("__lang", "__score", "__nats", "__rejected")
    return predict(docs, model, text, new, keep_text=True).where(~F.col("__rejected")).select(*docs.columns)
