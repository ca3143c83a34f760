"""Removes lines that are like an earlier line: exact set-similarity join with prefix, positional and length filters.

A line is the set of its words (A-Z lower-cased, parted by ASCII white space). Words are ordered by rarity. Two lines of
Jaccard similarity t or more share one of the n - ceil(t * n) + 1 rarest words of either, so lines meet under these words.
Words are hashes of 48 bits whose upper 16 bits are the rarity rank of the word's bucket: sorting hashes sorts by rarity.
Pairs that pass the filters are compared word by word before anything is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD, few, keep, text_batches

# A line from its first word on.
LINE = r"[^\x20\x09-\x0D][^\n]*"
THRESHOLD = 0.8
BUCKETS = 1 << 16
# Bytes of text whose words are hashed at once, and index rows that a task collects before it sends them.
CHUNK, ROWS = 1 << 18, 100_000
# Index rows of a part, which is what a matching task holds at once, and parts that it reads one after another.
PART_ROWS, PARTS_PER_TASK = 150_000, 2
# A word whose bucket has more occurrences than this meets only together with a second shared word.
HOT = 5_000_000
# Best candidates that a line sends for each of its words in the first round; the rest follow if none of them matches.
FIRST_CANDIDATES = 8
# Words of 64 parity bits by which candidates are filtered before their texts are fetched.
WIDE = 4
# Removed lines whose places, and words of undecided lines that, are broadcast; more of them are shuffled or not singled out.
MOST_SENT = 1_000_000
# Pairs that are filtered at once.
PAIRS = 1 << 18
INDEX = [("word", np.uint64), ("sid", np.uint64), ("sig", np.uint64), ("sig2", np.uint64), ("oid", np.int64), ("line", np.uint32), ("size", np.uint32), ("pos", np.uint32), ("asks", np.uint8)]
_SPACE = bytes(1 if c in (9, 10, 11, 12, 13, 32) else 0 for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]
# An odd number and its inverse modulo 2 ** 64.
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64; kept up to the length of usual chunks."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        factors = np.full(max(n, 2 * CHUNK), base, np.uint64)
        factors[0] = 1
        powers = np.cumprod(factors, dtype=np.uint64)
        if n > 2 * CHUNK:
            return powers
        _POWERS[base] = powers
    return _POWERS[base][:n]


def _words(text: bytes, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(line, word hash of 48 bits, or of 64) of all words: polynomials of their bytes, as differences of one running sum."""
    data = np.frombuffer(text, np.uint8)
    blank = np.frombuffer(b"\1" + text.translate(_SPACE) + b"\1", np.bool_)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begins, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = np.take(_BYTE, data)
    terms *= _powers(_BASE, len(data))
    np.cumsum(terms, out=sums[1:])
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(data))
    hashes = _mix((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64))
    hashes = hashes if whole else hashes >> np.uint64(16)
    cuts = np.searchsorted(begins, np.flatnonzero(data == 10))
    lines = np.repeat(np.arange(len(cuts) + 1), np.diff(np.concatenate([[0], cuts, [len(begins)]])))
    return lines, hashes


def _sets(lines: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words by line and code, each once."""
    if not len(lines) or lines[-1] < 1 << 16:
        both = (lines.astype(np.uint64) << np.uint64(48)) | codes
        both.sort()
        both = both[np.diff(both, prepend=~both[:1]) != 0]
        return (both >> np.uint64(48)).astype(np.int64), both & np.uint64((1 << 48) - 1)
    order = np.lexsort((codes, lines))
    lines, codes = lines[order], codes[order]
    new = (np.diff(lines, prepend=-1) != 0) | (np.diff(codes, prepend=codes[0]) != 0)
    return lines[new], codes[new]


def _chunks(texts: list[str | None], oids: list[int]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(text of whole lines, document and line number of each of its lines)."""
    held, owners, numbers, size = [], [], [], 0
    for text, oid in zip(texts, oids, strict=True):
        data = (text or "").encode()
        at, number = 0, 0
        while True:
            if len(data) - at <= CHUNK:
                end = len(data)
            else:  # a long text is cut after the first line that ends beyond a chunk
                end = data.find(b"\n", at + CHUNK)
                end = len(data) if end < 0 else end
            part = data[at:end]
            n = part.count(b"\n") + 1
            held.append(part)
            owners.append(np.full(n, oid, np.int64))
            numbers.append(np.arange(number, number + n, dtype=np.uint32))
            size += len(part)
            number += n
            if size >= CHUNK:
                yield b"\n".join(held), np.concatenate(owners), np.concatenate(numbers)
                held, owners, numbers, size = [], [], [], 0
            if end >= len(data):
                break
            at = end + 1
    if held:
        yield b"\n".join(held), np.concatenate(owners), np.concatenate(numbers)


def _set_ids(codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return _mix(np.add.reduceat(_mix(codes), begins) + sizes.astype(np.uint64))


def _identified(docs: DataFrame, row: str, text: str) -> DataFrame:
    """Adds oid, which names a document and orders documents: the id, or a hash beyond all ids if it is null, repeated or no whole number.

    Rows that agree in id and text have the same oid.
    """
    whole = dict(docs.dtypes)[row] in ("bigint", "int", "smallint", "tinyint")
    beyond = F.xxhash64(F.col(row), F.col(text)).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 61))
    if not whole:
        return docs.withColumn("__oid", beyond)
    id = F.col(row).cast("long")
    different = docs.where(F.col(row).isNotNull()).groupBy(id.alias("__id")).agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
    repeated = keep(different.where("a <> b or __id >= 1L << 60").select("__id"), "repeated-ids")
    if repeated.isEmpty():
        return docs.withColumn("__oid", F.coalesce(id, beyond))
    marked = docs.join(few(repeated.withColumn("__again", F.lit(True))), id == F.col("__id"), "left")
    return marked.withColumn("__oid", F.when(F.col("__again").isNull(), F.coalesce(id, beyond)).otherwise(beyond)).drop("__id", "__again")


def _lines(docs: DataFrame) -> DataFrame:
    """One pass over (oid, text): rows (oid, line, sid, size, p0..p3) of all lines with words, and rows (bucket, n) of words per bucket.

    p0..p3 are 256 parities: each word flips one bit, so bits that differ between two lines are words that differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        parities = [f"p{i}" for i in range(WIDE)]
        names = ["oid", "line", "sid", "size", *parities, "bucket", "n"]
        for batch, texts in text_batches(batches, "text"):
            for data, owners, numbers in _chunks(texts, batch.column("oid").to_pylist()):
                lines, codes = _sets(*_words(data))
                if not len(lines):
                    continue
                counts += np.bincount((codes >> np.uint64(32)).astype(np.int64), minlength=BUCKETS)
                begins = np.flatnonzero(np.diff(lines, prepend=-1))
                sizes = np.diff(np.append(begins, len(lines)))
                at = lines[begins]
                sid = _set_ids(codes, begins, sizes).view(np.int64)
                bit = np.uint64(1) << (codes & np.uint64(63))
                group = (codes >> np.uint64(6)) & np.uint64(WIDE - 1)
                wide = [np.bitwise_xor.reduceat(np.where(group == i, bit, np.uint64(0)), begins).view(np.int64) for i in range(WIDE)]
                columns = [owners[at], numbers[at].astype(np.int32), sid, sizes.astype(np.int32), *wide]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.int64())], names)
        some = np.flatnonzero(counts)
        nulls = [pa.nulls(len(some), kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * WIDE)]
        yield pa.RecordBatch.from_arrays([*nulls, pa.array(some.astype(np.int32)), pa.array(counts[some])], names)

    wide = ", ".join(f"p{i} long" for i in range(WIDE))
    return docs.mapInArrow(run, f"oid long, line int, sid long, size int, {wide}, bucket int, n long")


def _index_rows(data: bytes, owners: np.ndarray, numbers: np.ndarray, asks: np.ndarray, by_rarity: np.ndarray, hot: np.ndarray, threshold: float, only: np.ndarray | None = None) -> np.ndarray:
    """Rows of INDEX for the words in each line's prefix; with ``only``, sorted words, those of these words."""
    lines, raw = _words(data)
    rank = np.empty(BUCKETS, np.uint64)
    rank[by_rarity] = np.arange(BUCKETS, dtype=np.uint64)
    if only is not None and not hot.any() and len(lines):  # lines that have none of the words are left out at once
        mine = np.sort((by_rarity[(only >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (only & np.uint64(0xFFFFFFFF)))
        bucket = np.zeros(BUCKETS, bool)
        bucket[(mine >> np.uint64(32)).astype(np.int64)] = True
        near = np.flatnonzero(bucket[(raw >> np.uint64(32)).astype(np.int64)])
        has = np.zeros(lines[-1] + 1, bool)
        if len(near):
            has[lines[near[mine[np.minimum(np.searchsorted(mine, raw[near]), len(mine) - 1)] == raw[near]]]] = True
        stay = has[lines]
        lines, raw = lines[stay], raw[stay]
    codes = (rank[(raw >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (raw & np.uint64(0xFFFFFFFF))
    lines, codes = _sets(lines, codes)
    if not len(lines):
        return np.zeros(0, INDEX)
    begins = np.flatnonzero(np.diff(lines, prepend=-1))
    sizes = np.diff(np.append(begins, len(lines)))
    need = np.ceil(threshold * sizes - 1e-9).astype(np.int64)
    which = np.repeat(np.arange(len(begins)), sizes)
    pos = np.arange(len(lines)) - begins[which]
    sid = _set_ids((by_rarity[(codes >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (codes & np.uint64(0xFFFFFFFF)), begins, sizes)
    bit, second = np.uint64(1) << (codes & np.uint64(63)), (codes >> np.uint64(6)) & np.uint64(1) > 0
    sig, sig2 = (np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0)), begins) for side in (second, ~second))
    place = np.lexsort((numbers[lines[begins]], owners[lines[begins]], sid))
    once = np.zeros(len(begins), bool)  # the first of lines with the same words
    once[place[np.diff(sid[place], prepend=~sid[place[:1]]) != 0]] = True
    many = np.flatnonzero(asks[lines[begins]] > 0)
    asking = np.isin(sid, sid[many]) if 0 < len(many) < len(begins) else np.full(len(begins), len(many) > 0)
    chosen = (pos <= (sizes - need)[which]) & once[which]
    is_hot = hot[(codes >> np.uint64(32)).astype(np.int64)]
    alone = np.flatnonzero(chosen & ~is_hot)
    words, owner, places = [codes[alone]], [which[alone]], [pos[alone]]
    for k in np.unique(which[chosen & is_hot]):
        if need[k] < 2:
            continue  # one word: only equal lines can match, which needs no index
        mine = codes[begins[k] : begins[k] + sizes[k] - need[k] + 2]
        heats = is_hot[begins[k] : begins[k] + len(mine)]
        pairs = {(min(a, b), max(a, b)) for i, a in enumerate(mine.tolist()) if heats[i] and i <= sizes[k] - need[k] for b in mine.tolist() if a != b}
        both = np.array(sorted(pairs), np.uint64).reshape(-1, 2)
        words.append((_mix(both[:, 0] * np.uint64(3) + _mix(both[:, 1])) >> np.uint64(16)) | np.uint64(1 << 48))
        owner.append(np.full(len(both), k))
        places.append(np.zeros(len(both), np.int64))
    owner = np.concatenate(owner)
    out = np.zeros(len(owner), INDEX)
    at = lines[begins][owner]
    for name, value in (("word", np.concatenate(words)), ("sid", sid[owner]), ("sig", sig[owner]), ("sig2", sig2[owner]), ("oid", owners[at]), ("line", numbers[at]), ("size", sizes[owner]), ("pos", np.concatenate(places)), ("asks", asking[owner])):
        out[name] = value
    return out if only is None else out[np.isin(out["word"], only)]


def _earliest(rows: np.ndarray) -> np.ndarray:
    """Of rows of the same word and set, the first in document order; it asks if any of them does."""
    word, sid = rows["word"].copy(), rows["sid"].copy()
    order = np.argsort(word + _mix(sid))  # brings equal pairs together
    word, sid = word[order], sid[order]
    begins = np.flatnonzero((np.diff(word, prepend=~word[:1]) != 0) | (np.diff(sid, prepend=~sid[:1]) != 0))
    sizes = np.diff(np.append(begins, len(rows)))
    out = rows[order[begins]]
    many = np.flatnonzero(sizes > 1)
    if len(many):
        group = np.repeat(np.arange(len(many)), sizes[many])
        same = order[np.repeat(sizes > 1, sizes)]
        out["asks"][many] = np.maximum.reduceat(rows["asks"][same], np.cumsum(sizes[many]) - sizes[many])
        ordered = np.lexsort((rows["line"][same], rows["oid"][same], group))
        first = same[ordered[np.flatnonzero(np.diff(group, prepend=-1))]]
        for name in ("oid", "line"):
            out[name][many] = rows[name][first]
    return out


def _pack(rows: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(rows[name].tobytes() for name, _ in INDEX))


def _unpack(blob: bytes, n: int) -> np.ndarray:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, np.zeros(n, INDEX)
    for name, kind in INDEX:
        size = n * np.dtype(kind).itemsize
        out[name] = np.frombuffer(data[at : at + size], kind)
        at += size
    return out


def _candidates(rows: np.ndarray, threshold: float, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later row, earlier row, whether more were left out) of pairs under one word that pass the filters.

    Length: the smaller set has ``threshold`` of the larger at least. Position: the words left from here can still make the
    overlap. Parity: bits that differ between the lines' parities are words that differ. Per later row and word the
    ``most`` that differ least stay, the earliest first. ``rows`` come from ``_earliest``, sorted here by word and size.
    """
    rows_at = np.lexsort((rows["size"], rows["word"]))
    size, pos, sig = rows["size"][rows_at].astype(np.int32), rows["pos"][rows_at].astype(np.int32), rows["sig"][rows_at]
    sig2 = rows["sig2"][rows_at]
    place = np.empty(len(rows), np.int64)
    place[np.lexsort((rows["line"], rows["oid"]))] = np.arange(len(rows))  # document order
    place, asks = place[rows_at], rows["asks"][rows_at] > 0
    word = np.cumsum(np.diff(rows["word"][rows_at], prepend=rows["word"][rows_at][:1]) != 0)
    wide = int(size.max(initial=0)) + 1
    key = word * wide + size
    low = np.searchsorted(key, word * wide + np.ceil(threshold * size - 1e-9).astype(np.int64))
    counts = np.arange(len(rows)) - low
    ends = np.cumsum(counts)
    later, earlier, far = (np.zeros(0, np.int64) for _ in range(3))
    more = np.zeros(len(rows), bool)

    def pruned(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((place[b], far, a))
        a, b, far = a[order], b[order], far[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        more[a[nth >= most]] = True
        return a[nth < most], b[nth < most], far[nth < most]

    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS)))
        n = counts[i:j]
        a = np.repeat(np.arange(i, j, dtype=np.int32), n)
        b = np.arange(len(a), dtype=np.int32) + np.repeat((low[i:j] - np.cumsum(n) + n).astype(np.int32), n)
        both = size[a] + size[b]
        room = both * ((1 - threshold) / (1 + threshold)) + 1e-6
        ok = np.flatnonzero(np.bitwise_count(sig[a] ^ sig[b]) <= room)
        a, b, both, room = a[ok].astype(np.int64), b[ok].astype(np.int64), both[ok], room[ok]
        differ = np.bitwise_count(sig[a] ^ sig[b]).astype(np.int64) + np.bitwise_count(sig2[a] ^ sig2[b])
        ok = (differ <= room) & (np.minimum(size[a] - pos[a], size[b] - pos[b]) >= np.ceil(threshold / (1 + threshold) * both - 1e-9))
        a, b, differ = a[ok], b[ok], differ[ok]
        swap = place[a] < place[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        ok = asks[a]
        later, earlier, far = (np.concatenate(x) for x in ((later, a[ok]), (earlier, b[ok]), (far, differ[ok])))
        if most is not None and len(later) > PAIRS:
            later, earlier, far = pruned(later, earlier, far)
        i = j
    if most is not None:
        later, earlier, far = pruned(later, earlier, far)
    return rows_at[later], rows_at[earlier], more[later]


def _search(docs: DataFrame, by_rarity: np.ndarray, hot: np.ndarray, parts: int, threshold: float, most: int | None) -> DataFrame:
    """One pass over (oid, text, asked): candidates (oid, line, sid, like_oid, like_line, more).

    With ``most`` all lines ask, and send that many candidates per word. Without, only the line numbers in asked do, and send all.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((by_rarity.astype(np.uint16), np.packbits(hot)))  # BUCKETS values
    only = None

    def asked_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rarity, hot = shared.value[0], np.unpackbits(shared.value[1]).astype(bool)
        for batch, texts in text_batches(batches, "text"):
            oids, ask = batch.column("oid").to_pylist(), dict(zip(batch.column("oid").to_pylist(), batch.column("asked").to_pylist(), strict=True))
            for data, owners, numbers in _chunks(texts, oids):
                asks = np.array([n in (ask[o] or ()) for o, n in zip(owners.tolist(), numbers.tolist(), strict=True)], np.uint8)
                rows = _index_rows(data, owners, numbers, asks, by_rarity, hot, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(rows["word"][rows["asks"] > 0]).view(np.int64))], ["word"])

    if most is None:
        words = keep(docs.where("asked is not null").mapInArrow(asked_words, "word long").distinct(), "asked-words")
        if words.count() <= MOST_SENT:  # else every word stays in the index
            only = context.broadcast(np.sort(np.array([r["word"] for r in words.collect()], np.int64).view(np.uint64)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rarity, hot = shared.value[0], np.unpackbits(shared.value[1]).astype(bool)
        held, size = [], 0

        def parted() -> pa.RecordBatch:
            rows = np.concatenate(held)
            part = (_mix(rows["word"]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
            rows, part = rows[order], part[order]
            begins = np.flatnonzero(np.diff(part, prepend=-1))
            cuts = np.split(rows, begins[1:])
            return pa.RecordBatch.from_arrays([pa.array(part[begins]), pa.array([len(x) for x in cuts], pa.int64()), pa.array([_pack(x) for x in cuts], pa.binary())], ["part", "n", "rows"])

        for batch, texts in text_batches(batches, "text"):
            oids, asked = batch.column("oid").to_pylist(), batch.column("asked").to_pylist()
            ask = {o: a for o, a in zip(oids, asked, strict=True) if a is not None}
            for data, owners, numbers in _chunks(texts, oids):
                if ask:
                    some = {(o, n) for o in np.unique(owners).tolist() for n in ask.get(o, ())}
                    asks = np.array([(o, n) in some for o, n in zip(owners.tolist(), numbers.tolist(), strict=True)], np.uint8)
                else:
                    asks = np.full(len(owners), most is not None, np.uint8)
                rows = _index_rows(data, owners, numbers, asks, by_rarity, hot, threshold, only.value if only is not None else None)
                if len(rows):
                    held.append(rows)
                    size += len(rows)
                if size >= ROWS:
                    yield parted()
                    held, size = [], 0
        if held:
            yield parted()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of a task one after another: only one is held, however many the task has."""

        def pairs(rows: np.ndarray) -> pa.RecordBatch:
            rows = _earliest(rows)
            later, earlier, more = _candidates(rows, threshold, most)
            arrays = [rows["oid"][later], rows["line"][later].astype(np.int32), rows["sid"][later].view(np.int64), rows["oid"][earlier], rows["line"][earlier].astype(np.int32), more]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["oid", "line", "sid", "like_oid", "like_line", "more"])

        held, part = [], None
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for now, n, rows in zip(*(batch.column(c) for c in ("part", "n", "rows")), strict=True):
                if held and now.as_py() != part:
                    whole = np.concatenate(held)
                    held = []
                    yield pairs(whole)
                part = now.as_py()
                held.append(_unpack(rows.as_buffer(), n.as_py()))
        if held:
            whole = np.concatenate(held)
            held = []
            yield pairs(whole)

    sent = docs.mapInArrow(send, "part long, n long, rows binary")
    schema = "oid long, line int, sid long, like_oid long, like_line int, more boolean"
    found = sent.repartition(-(-parts // PARTS_PER_TASK), "part").sortWithinPartitions("part").mapInArrow(match, schema)
    pairs = found.groupBy("oid", "line", "sid", "like_oid", "like_line").agg(F.count(F.lit(1)).alias("shared"), F.max("more").alias("more"))
    return keep(pairs, "candidates")


def _filtered(pairs: DataFrame, seen: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose wide parities leave room for enough shared words; nth numbers those of a line, the best first."""
    places = pairs.select("oid", "line").union(pairs.select("like_oid", "like_line")).distinct()
    columns = ["size", *[f"p{i}" for i in range(WIDE)]]
    marks = seen.where("bucket is null").select("oid", "line", *columns).join(few(keep(places, "places")), ["oid", "line"], "left_semi").distinct()
    marks = few(keep(marks, "parities"))
    likes = marks.withColumnsRenamed({c: f"like_{c}" for c in ["oid", "line", *columns]})
    both = pairs.join(marks, ["oid", "line"]).join(likes, ["like_oid", "like_line"])
    differ = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"like_p{i}"))) for i in range(1, WIDE)), F.bit_count(F.col("p0").bitwiseXOR(F.col("like_p0"))))
    total = F.col("size") + F.col("like_size")
    both = both.where(differ <= total * ((1 - threshold) / (1 + threshold)) + 1e-6)
    best = Window.partitionBy("sid").orderBy(F.desc("shared"), "like_oid", "like_line")
    return keep(both.select("oid", "line", "sid", "like_oid", "like_line", "shared").withColumn("nth", F.row_number().over(best)), "filtered")


def _line_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of line number and word, line) of the different words of each line."""
    lines, hashes = _words("\n".join(texts).encode(), whole=True)
    keys = _mix(hashes + _mix(lines.astype(np.uint64)))
    keys, first = np.unique(keys, return_index=True)
    return keys, lines[first]


def _similar(texts: list[str], likes: list[str], threshold: float) -> np.ndarray:
    """Whether the words of two lines, compared as hashes of 64 bits, have the similarity."""
    (a, at), (b, bt) = _line_words(texts), _line_words(likes)
    sizes = np.bincount(at, minlength=len(texts)) + np.bincount(bt, minlength=len(texts))
    shared = np.bincount(at[np.isin(a, b, assume_unique=True)], minlength=len(texts))
    return shared * (1 + threshold) >= threshold * sizes - 1e-9


def _verified(docs: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """(sid, like_oid, like_line): the earliest candidate of each line whose words really are similar enough."""
    wanted = candidates.select("oid", "line").union(candidates.select("like_oid", "like_line")).distinct()
    wanted = keep(wanted.groupBy("oid").agg(F.collect_list("line").alias("lines")), "wanted-lines")
    taken = docs.select("oid", "text").join(few(wanted, 200_000), "oid")
    lines = taken.select("oid", F.split("text", "\n", -1).alias("all"), F.explode("lines").alias("line"))
    lines = keep(lines.select("oid", "line", F.get("all", F.col("line")).alias("text")), "wanted-texts")
    likes = lines.select(F.col("oid").alias("like_oid"), F.col("line").alias("like_line"), F.col("text").alias("like_text"))
    pairs = candidates.select("oid", "line", "sid", "like_oid", "like_line").join(lines, ["oid", "line"]).join(likes, ["like_oid", "like_line"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, begin, size = [batch.column(c).to_pylist() for c in ("text", "like_text")], 0, 0
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or size > CHUNK:
                    good = _similar(texts[0][begin:i], texts[1][begin:i], threshold)
                    yield batch.slice(begin, i - begin).filter(pa.array(good)).select(["sid", "like_oid", "like_line"])
                    begin, size = i, 0
                if i < batch.num_rows:
                    size += len(texts[0][i]) + len(texts[1][i])

    same = pairs.select("sid", "like_oid", "like_line", "text", "like_text").mapInArrow(check, "sid long, like_oid long, like_line int")
    return same.groupBy("sid").agg(F.min(F.struct("like_oid", "like_line")).alias("like")).select("sid", "like.like_oid", "like.like_line")


def removals(docs: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, first: int = FIRST_CANDIDATES) -> DataFrame:
    """From (oid, text): (oid, line, like_oid, like_line) of every line to remove, from line 0.

    Lines are ordered by oid, then line number. A line goes if any earlier line has Jaccard similarity ``threshold`` or more
    with it, kept or not. like is the first line with the same words, else an earlier one that is similar. Lines without
    words stay. Rows that repeat an oid are one document.
    """
    seen = keep(_lines(docs), "lines")
    counts = np.zeros(BUCKETS, np.int64)
    for r in seen.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[r["bucket"]] = r["n"]
    by_rarity = np.argsort(counts, kind="stable")
    heat = counts[by_rarity] > hot
    parts = max(8 * PARTS_PER_TASK, int(counts.sum() * (1 - threshold) * 1.2) // PART_ROWS)
    raw = _search(docs.withColumn("asked", F.lit(None).cast("array<int>")), by_rarity, heat, parts, threshold, first)
    candidates = _filtered(raw, seen, threshold)
    # most lines match the candidate with which they share the most words; the others try the rest
    found = keep(_verified(docs, candidates.where("nth = 1"), threshold), "matches")
    untried = keep(candidates.where("nth > 1").join(found, "sid", "left_anti"), "untried")
    if not untried.isEmpty():
        found = keep(found.union(_verified(docs, untried, threshold)), "matches")
    undecided = raw.where("more").select("oid", "line", "sid").distinct().join(found, "sid", "left_anti")
    undecided = keep(undecided.groupBy("oid").agg(F.collect_list("line").alias("asked")), "undecided-lines")
    if not undecided.isEmpty():
        rest = _search(docs.join(few(undecided, 200_000), "oid", "left"), by_rarity, heat, parts, threshold, None)
        rest = _filtered(rest.join(raw.select("sid", "like_oid", "like_line"), ["sid", "like_oid", "like_line"], "left_anti"), seen, threshold)
        found = keep(found.union(_verified(docs, rest, threshold)), "matches")
    lines = seen.where("bucket is null").select("oid", "line", "sid")
    place = F.struct("oid", "line")
    sets = lines.groupBy("sid").agg(F.min(place).alias("first"), (F.min(place) != F.max(place)).alias("repeated")).join(found, "sid", "left")
    sets = keep(sets.where("repeated or like_oid is not null"), "removals")
    gone = lines.join(few(sets), "sid").withColumn("again", F.struct("oid", "line") != F.col("first")).where("again or like_oid is not null")
    like_oid, like_line = (F.when(F.col("again"), F.col(f"first.{a}")).otherwise(F.col(f"like_{a}")).alias(f"like_{a}") for a in ("oid", "line"))
    return gone.select("oid", "line", like_oid, like_line)


def _without(text: Column, gone: Column) -> Column:
    """The lines whose numbers are not in ``gone``, joined again."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull() | (F.size(gone) == 0), text).otherwise(F.array_join(kept, "\n"))


def _marked(docs: DataFrame, row: str, text: str, threshold: float, hot: int, first: int) -> DataFrame:
    """``docs`` and __gone: what to remove from each row, null if nothing."""
    keyed = _identified(docs, row, text)
    gone = removals(keyed.select(F.col("__oid").alias("oid"), F.coalesce(text, F.lit("")).alias("text")), threshold, hot, first)
    per_doc = gone.groupBy(F.col("oid").alias("__oid")).agg(F.array_sort(F.collect_set(F.struct("line", "like_oid", "like_line"))).alias("__gone"))
    per_doc = keep(per_doc, "removed-lines")
    removed = per_doc.agg(F.sum(F.size("__gone"))).first()[0] or 0
    return keyed.join(F.broadcast(per_doc) if removed <= MOST_SENT else per_doc, "__oid", "left").drop("__oid")


def deduplicated(docs: DataFrame, row: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, hot: int = HOT, first: int = FIRST_CANDIDATES) -> DataFrame:
    """All columns of ``docs`` with the text without removed lines, and n_lines, n_removed, removed (line, like_oid, like_line).

    Documents are ordered by id; null and repeated ids and ids that are no whole numbers come last, by hash (like_oid then has
    that hash). Rows that agree in id and text are one document. n_lines counts lines with words. Every row comes back, also
    one that has lost all lines (its text is then empty); null texts stay null. Columns named like the new ones are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    joined = _marked(docs.select(*own), row, text, threshold, hot, first)
    numbers = F.transform("__gone", lambda x: x.line)
    wordy = F.coalesce(F.regexp_count(text, F.lit(LINE)), F.lit(0))
    removed = F.coalesce("__gone", F.array().cast("array<struct<line:int,like_oid:bigint,like_line:int>>"))
    kept = [_without(F.col(c), numbers).alias(c) if c == text else F.col(c) for c in own]
    return joined.select(*kept, wordy.alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"))


def without_repeats(docs: DataFrame, row: str = "doc_id", text: str = "text", length: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the repeated lines and without documents that lose all their words; columns as they are.

    ``length``, if there is such a column, is set to the characters that are left.
    """
    joined = _marked(docs, row, text, threshold, HOT, FIRST_CANDIDATES)
    joined = joined.withColumn("__left", _without(F.col(text), F.transform("__gone", lambda x: x.line)))
    joined = joined.where(F.col("__gone").isNull() | F.col("__left").rlike(WORD))
    new = {text: F.col("__left")}
    if length in docs.columns:
        new[length] = F.when(F.col("__gone").isNull(), F.col(length)).otherwise(F.length("__left")).cast(docs.schema[length].dataType)
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])
