"""Near-duplicates by 64-bit similarity fingerprints; pigeonring filtering finds the fingerprints that differ in few bits.

A fingerprint's four segments of 16 bits stand in a ring. If two fingerprints differ in three bits at most, some segment is
the start of a chain in which 1, 2, 3 and 4 consecutive segments together differ in at most 0, 1, 2 and 3 bits: each chain
stays within its proportional share of the three. So the start agrees whole, and of the next segment's two halves one does.
These 24 bits, for each start and half, are the keys under which fingerprints meet.

``first_of_each_group`` asks for shingle sets of Jaccard similarity 0.8, of which near fingerprints are only a hint. Links of
fingerprints are verified on the sets first, which joins large groups cheaply; an exact set join finds the rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import set_join
from keyloom.llm.common import few, keep, row_key, text_batches
from keyloom.llm.components import components

SEED = 42
BITS, SEGMENTS, MOST = 64, 4, 3
WIDTH = BITS // SEGMENTS
# Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
# Fingerprints under one key that are compared with each other; more of them meet again under longer keys.
BUCKET = 4096


def shingle_hashes(text: str | None, words: int = 3) -> Iterator[np.ndarray]:
    """64-bit hashes of all shingles, repeats included, ``AT_ONCE`` at a time; nothing if there are no words.

    A-Z are lower-cased, words are runs of anything but ASCII white space, a text of fewer words is one shingle.
    """
    found = text.encode().lower().split() if text else []
    if not found:
        return
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, AT_ONCE):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[i : i + AT_ONCE], last[i : i + AT_ONCE], strict=True)], np.uint64)


def _majorities(parts: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in parts:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bit b is set if it is set in over half of the hashes of all shingles, repeats included; no words give 0."""
    return _majorities(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """All columns of ``docs`` but the text, and fp: the fingerprint as a signed long."""
    others = [c for c in docs.columns if c not in (text, "fp")]
    source = docs.select(*others, F.col(text).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "__text"):
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(found)], names=[*others, "fp"])

    return source.mapInArrow(run, ", ".join([*fields, "fp long"]))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks that deal ``bits`` out to ``parts`` runs of about equal size."""
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]


def first_masks() -> list[tuple[int, int]]:
    """(start segment, bits that must agree): the start and one half of the segment after it."""
    masks = []
    for start in range(SEGMENTS):
        after = list(range(WIDTH * ((start + 1) % SEGMENTS), WIDTH * ((start + 1) % SEGMENTS) + WIDTH))
        whole = ((1 << WIDTH) - 1) << (WIDTH * start)
        masks += [(start, whole | half) for half in _blocks(after, 2)]
    return masks


def longer_masks(mask: int) -> list[int]:
    """Of the bits outside ``mask``, dealt out to one block more than may differ, one block agrees as well."""
    return [mask | block for block in _blocks([b for b in range(BITS) if not mask >> b & 1], MOST + 1)]


def _linked(start: int, one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Chains of 1, 2, 3 segments from ``start`` within their budgets, then the whole fingerprint."""
    differ = one ^ others
    passed, total = np.ones(len(others), bool), np.zeros(len(others), np.int64)
    for k in range(SEGMENTS):
        at = np.uint64(WIDTH * ((start + k) % SEGMENTS))
        total += np.bitwise_count((differ >> at) & np.uint64((1 << WIDTH) - 1))
        passed &= total <= (k + 1) * MOST // SEGMENTS
    return passed


def _forest(start: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is linked among different fingerprints, one less than members for each group."""
    edges, left = [], np.sort(fps)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _linked(start, at, left)
            if near.any():
                reached = left[near]
                edges += [(int(at), int(x)) for x in reached]
                frontier.extend(reached)
                left = left[~near]
    return edges


def _meet(keys: DataFrame, last: bool) -> DataFrame:
    """Rows (start, mask, key, fp) to links (a, b), and, unless ``last``, the rows of full buckets with ``mask`` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, full = [], None, False
        out: list[tuple] = []

        def flush():
            if len(held) > 1 and not full:
                links = _forest(current[0], np.array(held, np.int64).view(np.uint64))
                signed = np.array(links, np.uint64).reshape(-1, 2).view(np.int64).tolist()
                out.extend((a, b, None, None) for a, b in signed)

        def batch_of(rows):
            a, b, start, mask = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(start, pa.int32()), pa.array(mask, pa.int64())], ["a", "b", "start", "mask"])

        for batch in batches:
            for start, mask, key, fp in zip(*(batch.column(c).to_pylist() for c in ("start", "mask", "key", "fp")), strict=True):
                if (start, mask, key) != current:
                    flush()
                    held, current, full = [], (start, mask, key), False
                if full:
                    out.append((fp, None, start, mask))
                    continue
                held.append(fp)
                if len(held) > BUCKET and not last:
                    full = True
                    out.extend((x, None, start, mask) for x in held)
                    held = []
            if len(out) >= 10_000:
                yield batch_of(out)
                out.clear()
        flush()
        if out:
            yield batch_of(out)

    columns = ["start", "mask", "key"]
    dealt = keys.repartition(*columns).sortWithinPartitions(*columns, "fp")
    return dealt.select(*columns, "fp").mapInArrow(run, "a long, b long, start int, mask long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) among the different values of ``fp``: enough links to connect all that differ in ``MOST`` bits at most.

    Keys that over ``BUCKET`` fingerprints share are split: of the bits not yet fixed, cut in four, one block agrees, too,
    which gives longer keys. The last keys leave 16 bits open, so that no bucket can hold more than 2 ** 16 fingerprints.
    """
    distinct = fps.select("fp").distinct()
    masks = first_masks()
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).cast("long").alias("mask")) for s, m in masks])).alias("x")
    keys = distinct.select("fp", rows).select("fp", "x.start", "x.mask", F.col("x.mask").bitwiseAND(F.col("fp")).alias("key"))
    found = []
    level = sorted({m for _, m in masks})
    while True:
        last = all(BITS - m.bit_count() <= 16 for m in level)
        met = keep(_meet(keys, last), "links")
        found.append(met.where("b is not null").select("a", "b"))
        again = met.where("b is null")
        if last or again.isEmpty():
            break
        longer = {m: longer_masks(m) for m in level}
        pairs = [F.lit(x) for m in level for x in (_signed(m),)]
        lists = [F.array(*[F.lit(_signed(x)).cast("long") for x in longer[m]]) for m in level]
        table = F.map_from_arrays(F.array(*[p.cast("long") for p in pairs]), F.array(*lists))
        keys = again.select(F.col("a").alias("fp"), "start", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
        keys = keys.withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
        level = sorted({x for xs in longer.values() for x in xs})
    whole = found[0]
    for part in found[1:]:
        whole = whole.union(part)
    return whole.distinct()


def near_duplicates(docs: DataFrame, row: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(row, fingerprint, component_id): 16 lowercase hex digits, and the smallest id reachable over links, itself included.

    Texts without words have fingerprint 0 and are linked like any other. Equal fingerprints are merged before anything
    is compared. A null id is a row like any other but never names a component; a component of null ids alone has null.
    """
    fps = keep(fingerprints(docs.select(F.col(row).alias("row"), F.col(text).alias("text"))), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("row").alias("least"))
    groups = components(links(first))
    labelled = keep(first.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("group"), "least"), "groups")
    least = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "group").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("row").alias(row), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame, row: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one of smallest id, nulls last.

    Documents are near-duplicates if their sets of ``words``-word shingles have Jaccard similarity of ``percent`` per cent or
    more; a group is what such pairs connect. Near fingerprints are verified on the sets first; what they leave is found by
    the exact join of :mod:`set_join`. Shingles are compared as 64-bit hashes, and no pair is left out otherwise.
    Documents without words stay, each of them. Of rows that agree in id and text one stays. Columns stay as they are.
    """

    def mark(hashes: np.ndarray) -> int:
        value = _majorities(hashes[i : i + AT_ONCE] for i in range(0, len(hashes), AT_ONCE))
        return value - (1 << BITS) if value >> (BITS - 1) else value

    def hints(sets: DataFrame) -> DataFrame:
        named = keep(sets.groupBy("mark").agg(F.min("sid").alias("rep")), "marks")
        near = links(named.select(F.col("mark").alias("fp")))
        near = near.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        same = sets.select("mark", "sid").join(named, "mark").where("sid <> rep").select(F.col("rep").alias("a"), F.col("sid").alias("b"))
        return near.union(same)

    documents, sets, classes = set_join.joined(docs, set_join.Rule(words, percent), row, text, mark, hints)
    named = sets.select("sid", "h1", "h2", "least").join(classes, "sid")
    least = named.groupBy("group").agg(F.min("least").alias("first"))
    named = named.join(least, "group").select("h1", "h2", "first")
    others = documents.where("n > 0").select("place", "h1", "h2").join(named, ["h1", "h2"]).where(~F.col("place").eqNullSafe(F.col("first")))
    others = keep(others.select("place.__k1", "place.__k2").distinct(), "others")
    keyed = docs.withColumns({"__k1": row_key(F.col(row), F.col(text))[0], "__k2": row_key(F.col(row), F.col(text))[1]})
    left = keyed.join(few(others), ["__k1", "__k2"], "left_anti")
    repeated = documents.where("n > 0").groupBy("place.__k1", "place.__k2").count().where("count > 1").select("__k1", "__k2")
    repeated = few(keep(repeated.join(others, ["__k1", "__k2"], "left_anti"), "repeated"))
    once = left.join(repeated, ["__k1", "__k2"], "left_anti").select(*docs.columns)
    return once.unionByName(left.join(repeated, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select(*docs.columns))
