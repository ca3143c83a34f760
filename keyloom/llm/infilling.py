"""Fill-in-the-middle: segments of a text change places inside one byte buffer by rotations, which can be undone exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import text_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# Bytes that a reversal holds besides the buffer.
SWAP = 1 << 16


def _reverse(buffer: np.ndarray, start: int, end: int) -> None:
    """Reverses ``buffer[start:end]`` in place, from both ends inwards."""
    while end - start > 1:
        n = min(SWAP, (end - start) // 2)
        left = buffer[start : start + n].copy()
        buffer[start : start + n] = buffer[end - n : end][::-1]
        buffer[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchanges the neighbours ``buffer[start:cut]`` and ``buffer[cut:end]`` in place by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    _reverse(view, start, cut)
    _reverse(view, cut, end)
    _reverse(view, start, end)


def cut_points(data: bytes, cuts: tuple[int, int]) -> tuple[int, int]:
    """Byte offsets of code point positions, found by a scan over the bytes that begin a code point."""
    begins = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return tuple(int(begins[c]) if c < len(begins) else len(data) for c in cuts)


def length(data: bytes) -> int:
    """Code points of a text."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def permute(data: bytes, form: str, cuts: tuple[int, int]) -> bytearray:
    """The output for cuts given as byte offsets."""
    buffer = bytearray(data)
    if form == PLAIN:
        return buffer
    first, second = cuts
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle, suffix, len(buffer))  # <P>prefix <S>suffix <M>middle
    if form == SPM:
        rotate(buffer, 0, middle, middle + len(buffer) - suffix)
    return buffer


def restore(output: bytes, form: str) -> bytearray:
    """The text that ``permute`` was given. The text has none of the marks, and no mark can arise across two segments."""
    buffer = bytearray(output)
    if form == PLAIN:
        return buffer
    if form == SPM:
        rotate(buffer, 0, buffer.find(PREFIX), buffer.find(MIDDLE))
    suffix, middle = buffer.find(SUFFIX), buffer.find(MIDDLE)
    first, second = suffix, suffix + len(buffer) - middle  # where the middle and the suffix begin after the rotation
    rotate(buffer, suffix, middle, len(buffer))
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(mark)]
    return buffer


def _draws(row: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(row).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _by_batch(source: DataFrame, others: list[str], text: str, run, made: list[pa.Field]) -> DataFrame:
    """``others`` and the columns that ``run(batch, texts as bytes)`` gives for each batch."""
    names = {"int64": "long", "string": "string"}
    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in others] + [f"`{f.name}` {names[str(f.type)]}" for f in made]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(found, text):
            new = [pa.array(values, f.type) for values, f in zip(run(batch, [x or b"" for x in texts]), made, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + new, names=[*others, *(f.name for f in made)])

    return source.mapInArrow(batches, ", ".join(fields))


def infill(docs: DataFrame, row: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """All columns of ``docs`` but the text, and n, form, prefix_chars, middle_chars, output.

    The text is cut in three at two code points drawn from the sha256 of seed and id, so reruns agree. ``plain`` per cent
    of all texts stay as they are, and so do empty texts and texts that contain a mark (null counts as empty, lengths of
    segments are null then); of the rest, ``spm`` per cent put the suffix first. A text is one buffer, and its segments
    change places in it; whole texts of any length are taken. A null id draws like an empty one, rows that repeat an id
    draw alike. Columns named like the new ones are replaced.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    others = [c for c in docs.columns if c != text and c not in new]
    draws = [h.alias(f"__h{k}") for k, h in enumerate(_draws(row, seed))]
    source = docs.select(*others, F.col(text).cast("binary").alias("__text"), *draws)
    made = [pa.field("n", pa.int64()), pa.field("form", pa.string()), pa.field("prefix_chars", pa.int64()), pa.field("middle_chars", pa.int64()), pa.field("output", pa.string())]

    def run(batch: pa.RecordBatch, texts: list[bytes]) -> list[list]:
        rows = []
        for data, *h in zip(texts, *(batch.column(f"__h{k}").to_pylist() for k in range(4)), strict=True):
            n = length(data)
            if not data or h[2] % 100 >= 100 - plain or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
                rows.append((n, PLAIN, None, None, data))
                continue
            a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            form = SPM if h[3] % 100 < spm else PSM
            rows.append((n, form, a, b - a, bytes(permute(data, form, cut_points(data, (a, b))))))
        return [list(column) for column in zip(*rows, strict=True)] if rows else [[]] * len(new)

    return _by_batch(source, others, "__text", run, made)


def restored(infilled: DataFrame, out: str = "restored") -> DataFrame:
    """All columns of ``infilled`` but output, and ``out``: the exact text, rebuilt from output and form alone."""
    others = [c for c in infilled.columns if c not in ("output", out)]
    source = infilled.select(*others, F.col("output").cast("binary").alias("__output"), F.coalesce("form", F.lit(PLAIN)).alias("__form"))

    def run(batch: pa.RecordBatch, outputs: list[bytes]) -> list[list]:
        return [[bytes(restore(data, form)) for data, form in zip(outputs, batch.column("__form").to_pylist(), strict=True)]]

    return _by_batch(source, others, "__output", run, [pa.field(out, pa.string())])
