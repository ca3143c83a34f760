"""Exact Jaccard join of word shingle sets by prefixes whose tokens are combined where they are frequent.

Tokens are the hashes of a document's different shingles, rare ones first. Two sets of similarity t or more share
ceil(t * n) tokens of either, so the k first tokens that they share lie in the n - ceil(t * n) + k first tokens of either: the
k-prefix. Sets meet under single tokens of the 1-prefix. Groups of similar sets would meet under every token, all with all,
so each set is first compared with one set only, the one that it meets most often under a token's first set (its pivot). Sets
linked that way form classes, and a token matters only if different classes meet under it. Of those, a token that too many
sets of different classes share is frequent: there sets meet under pairs of it and a later token of the 2-prefix, then under
triples. What meets in different classes, and is not ruled out by sizes, places and parity bits, is verified on whole sets.
Where a set has many such candidates under a key, its closest ones are verified first: what they link becomes one class, so that
a large group of near copies is not paired all with all. What is still in different classes then follows, up to the last pair.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import few, keep, row_key, text_batches
from keyloom.llm.components import components
from keyloom.llm.line_dedup import _mix, _words

# Bytes of text whose words are hashed at once.
CHUNK = 1 << 18
# A token is listed if it occurs so often in a task's batch and over all; the most frequent ones are listed. The list sets the order only.
LOCAL, TOTAL, LISTED = 4, 16, 1 << 18
# Sets that one task compares under a key with each other; half the pairs of different classes per set beyond which a token is frequent.
GROUP = 2048
# Sets under a key that are paired without a look at their parities; keys of more are marked when sets meet.
LARGE = 32
# Tokens of a combination at most; what still meets too often is compared in blocks.
MOST_TOKENS = 3
# Random orders of sets, which give a set so many pivots or fewer.
ORDERS = 8
# Sets under a listed token that share a pivot; pairs verified together with one set.
PIVOT_ROWS, STAR = 100_000, 256
# Parity bits: at least these many, and this many for each token; groups are compared by the least number.
LEAST_BITS, BITS_PER_TOKEN = 512, 4
# Candidates that a task collects before it sends them.
PAIRS = 100_000
# Closest candidates of a set under a key that are verified before its others; so many times more in each next round.
CLOSEST = 4
MORE = 8
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Rule:
    """Sets of ``words``-word shingles are linked if of * shared >= part * united."""

    words: int
    part: int
    of: int = 100

    def prefix(self, n, k: int = 1):
        """Tokens that hold the k first shared ones: numbers, arrays or columns."""
        if isinstance(n, Column):
            return n - F.ceil(n * self.part / F.lit(float(self.of))) + k
        return n + self.part * n // -self.of + k  # n - ceil(part * n / of) + k

    def shared(self, both):
        """Least shared tokens of sets that have ``both`` tokens together."""
        return -(-(self.part * both) // (self.part + self.of))


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > CHUNK:
        blank = _BLANK.search(data, at + CHUNK)
        end = blank.end() if blank else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def _hashed_words(texts: list[bytes]) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words, A-Z lower-cased; short texts are hashed together."""
    held: list[bytes] = []

    def flush() -> Iterator[np.ndarray]:
        lines, hashes = _words(b"\n".join(held), whole=True)
        ends = np.cumsum([t.count(b"\n") + 1 for t in held])
        yield from np.split(hashes, np.searchsorted(lines, ends[:-1]))
        held.clear()

    size = 0
    for text in texts:
        if len(text) > CHUNK:
            if held:
                yield from flush()
                size = 0
            yield np.concatenate([_words(piece, whole=True)[1] for piece in _pieces(text)])
            continue
        held.append(text)
        size += len(text)
        if size > CHUNK:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def shingles(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's shingles in order, repeats included; a text of fewer words is one, none give none."""
    for hashes in _hashed_words([(t or "").encode() for t in texts]):
        width = min(words, len(hashes))
        if not width:
            yield hashes
            continue
        n = len(hashes) - width + 1
        found = np.full(n, width, np.uint64)
        for k in range(width):
            found = found * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        yield _mix(found)


def _once(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.diff(values, prepend=~values[:1]) != 0]


def parities(tokens: np.ndarray) -> bytes:
    """One bit for each class of tokens: whether their number is odd. Sets that differ in d tokens differ in d bits at most."""
    bits = max(LEAST_BITS, 1 << (max(1, BITS_PER_TOKEN * len(tokens)) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> int:
    """Parities for ``size`` bytes, a whole fraction of what there are."""
    value, n = int.from_bytes(bits, "little"), len(bits)
    while n > size:
        n //= 2
        value = (value >> (8 * n)) ^ (value & ((1 << (8 * n)) - 1))
    return value


def frequent(docs: DataFrame, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens in ascending order, texts that have them): the ``LISTED`` most frequent of all tokens that recur within a task's batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches, "text"):
            tokens, n = np.unique(np.concatenate([_once(t) for t in shingles(texts, words)] or [np.zeros(0, np.uint64)]), return_counts=True)
            often = n >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= TOTAL).orderBy(F.desc("n"), "token").limit(LISTED).collect()
    tokens, n = np.array([r["token"] for r in found], np.int64).view(np.uint64), np.array([r["n"] for r in found], np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def signed(docs: DataFrame, text: str, rule: Rule, listed: tuple[np.ndarray, np.ndarray], mark: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """All columns but the text, and h1, h2 (the set's identity), n (its size), odd (parities), prefix (rarest first), mark of all shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(listed)  # LISTED pairs of numbers at most
    others = [c for c in docs.columns if c != text]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = shared.value
        for batch, texts in text_batches(batches, text):
            rows = []
            for every in shingles(texts, rule.words):
                tokens = _once(every)
                n = len(tokens)
                many = np.zeros(n, np.int64)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                    many = np.where(known[at] == tokens, times[at], 0)
                prefix = tokens[np.argsort(many, kind="stable")[: min(n, rule.prefix(n, MOST_TOKENS))]]
                mixed = _mix(tokens)
                ids = [int(x) for x in np.array([mixed.sum(dtype=np.uint64), _mix(mixed + np.uint64(n)).sum(dtype=np.uint64)]).view(np.int64)]
                rows.append((*ids, n, parities(tokens), prefix.view(np.int64), mark(every) if mark else 0))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64())
            made = [pa.array(list(x), kind) for x, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + made, names=[*others, "h1", "h2", "n", "odd", "prefix", "mark"])

    return docs.select(*others, text).mapInArrow(run, ", ".join([*fields, "h1 long, h2 long, n long, odd binary, prefix array<long>, mark long"]))


def distinct_sets(documents: DataFrame) -> DataFrame:
    """(sid, h1, h2, n, odd, prefix, mark, least) of different sets with tokens; least is the first of its documents."""
    merged = documents.where("n > 0").groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("n", "odd", "prefix", "mark")], F.min("place").alias("least"))
    return keep(merged.withColumn("sid", F.monotonically_increasing_id()), "sets")


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def meetings(sets: DataFrame, rule: Rule, listed: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, sid, n, last, pivot): tokens of 1-prefixes that several sets share, last their place, pivot one of these sets.
    A row of sid -1 says that over ``LARGE`` sets share the token.

    Sets under a token that is known to be very frequent are dealt to several pivots, whose own meeting is kept as well.
    """
    rows = sets.select("sid", "n", F.posexplode(F.slice("prefix", 1, rule.prefix(F.col("n")).cast("int"))).alias("last", "key"))
    hot = [(int(t), int(-(-n // PIVOT_ROWS))) for t, n in zip(listed[0].view(np.int64), listed[1], strict=True) if n > PIVOT_ROWS]
    salt = F.lit(0)
    if hot:
        table = F.broadcast(sets.sparkSession.createDataFrame(hot, "key long, salts long"))  # LISTED rows at most
        rows = rows.join(table, "key", "left")
        salt = F.when(F.col("salts").isNotNull(), 1 + F.pmod(F.xxhash64("sid"), F.col("salts"))).otherwise(0).cast("int")
    names = ["key", "sid", "n", "last", "pivot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, pivot, count = None, 0, 0  # the last row, if it is its key's only one so far; else its key's pivot and rows
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, salt, sid, n, last = (batch.column(c).to_numpy().astype(np.int64) for c in ("key", "salt", "sid", "n", "last"))
            if waiting is not None:
                key, salt, sid, n, last = (np.concatenate([[w], x]) for w, x in zip(waiting, (key, salt, sid, n, last), strict=True))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            goes_on = waiting is None and before == (key[0], salt[0])
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            sizes, earlier = np.bincount(run_of), np.zeros(len(starts), np.int64)
            first = sid[starts]
            if goes_on:
                first[0], earlier[0] = pivot, count
            several = (sizes + earlier > 1) | (salt[starts] > 0)
            large = ((sizes + earlier > LARGE) & (earlier <= LARGE)) | ((salt[starts] > 0) & (earlier == 0))
            shown = several[run_of]
            waiting = None if several[-1] else tuple(x[-1] for x in (key, salt, sid, n, last))
            before, pivot, count = (key[-1], salt[-1]), first[-1], sizes[-1] + earlier[-1]
            if shown.any():
                marks = np.zeros(int(large.sum()), np.int64)
                rows = (key[shown], sid[shown], n[shown], last[shown], first[run_of][shown])
                yield _batch(names, [np.concatenate(x) for x in zip(rows, (key[starts[large]], marks - 1, marks, marks, marks - 1), strict=True)])

    order = F.xxhash64("sid", F.pmod("key", F.lit(ORDERS)))
    dealt = rows.select("key", salt.alias("salt"), "sid", "n", "last").repartition("key", "salt").sortWithinPartitions("key", "salt", order, "sid")
    return keep(dealt.mapInArrow(run, "key long, sid long, n long, last long, pivot long"), "meetings")


def pivot_pairs(met: DataFrame, rule: Rule, salted: bool) -> DataFrame:
    """(a, b): each set and its pivots, those of enough of its tokens, and the pivots of one token. A hint only: no pair of
    similar sets need be among them."""
    votes = met.where("sid >= 0 and sid <> pivot").groupBy("sid", "n", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    often = F.col("votes") * 2 * ORDERS >= rule.prefix(F.col("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("votes", "pivot")), asc=False), 1, ORDERS)  # of a set's own tokens
    best = votes.where(often).groupBy("sid").agg(best.alias("best")).select(F.explode("best.pivot").alias("a"), F.col("sid").alias("b"))
    if not salted:
        return best
    pivots = met.where("sid >= 0").select("key", "pivot").distinct()
    least = pivots.groupBy("key").agg(F.min("pivot").alias("a"))
    return best.union(pivots.join(least, "key").select("a", F.col("pivot").alias("b")).where("a <> b").distinct())


def verified(pairs: DataFrame, sets: DataFrame, keyed: DataFrame, text: str, rule: Rule) -> DataFrame:
    """Those of the pairs (a, b) that the rule links. Parities rule most others out; then each set is sent once to the
    pairs that it is the second of, and once to each star of ``STAR`` pairs that it is the first of."""
    pairs = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    asked = few(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    some = sets.select("sid", "n", "odd").join(asked, "sid", "left_semi")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                size = min(len(x), len(y))
                good.append((folded(x, size) ^ folded(y, size)).bit_count() <= n + m - 2 * rule.shared(n + m))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = some.select(F.col("sid").alias("a"), F.col("n"), F.col("odd").alias("x"))
    other = some.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("odd").alias("y"))
    left = keep(pairs.join(one, "a").join(other, "b").mapInArrow(possible, "a long, b long"), "possible")
    stars = left.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("stars"))
    dealt = keep(left.join(stars, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("stars")).cast("int").alias("star")), "stars")
    sent = dealt.select("a", "star", F.col("b").alias("sid"), F.lit(1).alias("second"))
    sent = sent.union(dealt.select("a", "star").distinct().select("a", "star", F.col("a").alias("sid"), F.lit(0).alias("second")))
    sent = keep(sent.join(sets.select("sid", "least.__k1", "least.__k2"), "sid"), "sent")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text"):
            made = [_once(t).tobytes() for t in shingles(texts, rule.words)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "star", "second", "sid")] + [pa.array(made, pa.binary())], ["a", "star", "second", "sid", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            found = []
            for a, star, second, sid, tokens in zip(*(batch.column(c) for c in ("a", "star", "second", "sid", "tokens")), strict=True):
                mine = np.frombuffer(tokens.as_buffer(), np.uint64)
                if not second.as_py():
                    held, first = (a.as_py(), star.as_py()), mine.copy()
                    continue
                assert held == (a.as_py(), star.as_py())
                same = len(np.intersect1d(first, mine, assume_unique=True))
                if rule.of * same >= rule.part * (len(first) + len(mine) - same):
                    found.append((a.as_py(), sid.as_py()))
            yield _batch(["a", "b"], list(np.array(found, np.int64).reshape(-1, 2).T))

    texts = keyed.select("__k1", "__k2", F.col(text).alias("text")).join(few(sent), ["__k1", "__k2"]).select("a", "star", "second", "sid", "text")
    made = texts.mapInArrow(cut, "a long, star int, second int, sid long, tokens binary")
    stars = made.repartition("a", "star").sortWithinPartitions("a", "star", "second")
    return keep(stars.mapInArrow(compare, "a long, b long").distinct(), "links")


def _classes(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(sid, group) of all sets."""
    found = components(links).withColumnRenamed("node", "sid")
    return sets.select("sid").join(found, "sid", "left").select("sid", F.coalesce("component", "sid").alias("group"))


def _close_by(links: DataFrame, rounds: int = 2) -> DataFrame:
    """(sid, group) of linked sets: the smallest set reachable over ``rounds`` + 1 links. Sets of one group are connected, but what
    is connected may have several groups: enough to know which pairs need not be looked at."""
    both = keep(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    group = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("group"))
    for _ in range(rounds):
        group = keep(group.select(F.col("a").alias("b"), "group"), "close-by")
        group = both.join(few(group), "b").groupBy("a").agg(F.min("group").alias("group"))
    return keep(group.withColumnRenamed("a", "sid"), "close-by")


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows (key, sid, n, last, group) under keys at which different groups meet, and sets, crossing: the key's sets, and its pairs of different groups."""
    each = rows.groupBy("key", "group").agg(F.count(F.lit(1)).cast("double").alias("c"))
    keys = each.groupBy("key").agg(F.sum("c").alias("sets"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.count(F.lit(1)).alias("groups"))
    keys = keep(keys.where("groups > 1").select("key", "sets", ((F.col("sets") * F.col("sets") - F.col("squares")) / 2).alias("crossing")), "keys")
    return keep(rows.join(few(keys), "key"), "mixed")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows, each once for every pair of blocks that it is compared in: (key, x, y, side) with side 0 or 1, or 2 inside a block.

    A group of more than ``GROUP`` sets under a key has blocks of its own, which need not be compared with each other; other
    groups share blocks. A block has about ``GROUP`` sets.
    """
    sizes = rows.groupBy("key", "group").agg(F.count(F.lit(1)).alias("c"))
    large = F.when(F.col("c") > GROUP, F.col("group"))
    sizes = sizes.withColumn("own", large)
    rest = sizes.where("own is null").groupBy("key").agg(F.ceil(F.sum("c") / GROUP).alias("rest"))
    sizes = sizes.join(rest, "key", "left").select("key", "group", "own", F.coalesce(F.when(F.col("own").isNotNull(), F.ceil(F.col("c") / GROUP)), "rest").alias("of"))
    piece = F.when(F.col("own").isNotNull(), F.pmod(F.xxhash64("sid"), F.col("of"))).otherwise(F.pmod(F.xxhash64(F.lit("block"), "group"), F.col("of")))
    placed = keep(rows.join(sizes, ["key", "group"]).withColumn("piece", piece).withColumn("block", F.xxhash64("own", "piece")), "blocks")
    blocks = placed.select("key", "block", "own").distinct()
    left, right = blocks.toDF("key", "x", "own"), blocks.toDF("key", "y", "other")
    met = left.join(right, "key").where(((F.col("x") < F.col("y")) & ~F.coalesce(F.col("own") == F.col("other"), F.lit(False))) | ((F.col("x") == F.col("y")) & F.col("own").isNull()))
    sides = met.select("key", "x", "y", F.explode(F.array(F.struct(F.col("x").alias("block"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side")), F.struct(F.col("y").alias("block"), F.when(F.col("x") == F.col("y"), 2).otherwise(1).alias("side")))).alias("s"))
    sides = sides.select("key", "x", "y", "s.block", "s.side").distinct()
    return placed.join(sides, ["key", "block"]).select("key", "x", "y", "side", "sid", "n", "last", "group")


def _closest(found: np.ndarray, most: int) -> np.ndarray:
    """Rows (a, b, differ, ..) that are among the ``most`` of least difference for a or for b."""
    stays = np.zeros(len(found), bool)
    for one, other in ((0, 1), (1, 0)):
        order = np.lexsort((found[:, other], found[:, 2], found[:, one]))
        mine = found[order, one]
        stays[order[np.arange(len(mine)) - np.searchsorted(mine, mine) < most]] = True
    return stays


def _crossing(rows: DataFrame, sets: DataFrame, rule: Rule, k: int, signs: bool = True, most: int | None = None) -> DataFrame:
    """(a, b) of different groups that meet in (key, x, y) and that sizes, places and, with ``signs``, folded parities do not rule out.

    With ``most``, a pair stays only if it is among the closest of one of its sets in (key, x, y); a row (key, null) names each
    key under which pairs were left out.
    """
    width = LEAST_BITS // 64 if signs else 0
    columns = ["key", "x", "y", "side", "sid", "n", "last", "group", *(f"p{i}" for i in range(width))]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [folded(x, LEAST_BITS // 8) for x in batch.column("odd").to_pylist()]
            made = np.array([[x >> (64 * i) & (2**64 - 1) for i in range(width)] for x in bits], np.uint64).reshape(-1, width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("sid")] + [pa.array(made[:, i]) for i in range(width)], ["sid", *(f"p{i}" for i in range(width))])

    if signs:
        asked = few(keep(rows.select("sid").distinct(), "asked"))
        odd = sets.select("sid", "odd").join(asked, "sid", "left_semi")
        odd = keep(odd.mapInArrow(fold, "sid long, " + ", ".join(f"p{i} long" for i in range(width))), "folded")
        rows = rows.join(few(odd, 150_000), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        out: list[np.ndarray] = []
        left: list[np.ndarray] = []

        def pairs(key, x, y, side, sid, n, last, group, *p):
            place = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
            at, d = np.arange(len(key)), 0
            close: list[np.ndarray] = []  # rows of this call by place: a row is one set in one (key, x, y)
            waiting = 0

            def thin() -> int:
                found = np.concatenate(close)
                stays = _closest(found, most)
                left.append(np.unique(key[found[~stays, 0]]))
                close[:] = [found[stays]]
                return len(close[0])

            while len(at):  # rows of a place stand in order of size: once a row's partner is too large, so are all after it
                d += 1
                at = at[at + d < len(key)]
                at = at[(place[at] == place[at + d]) & (rule.of * n[at] >= rule.part * n[at + d])]
                a, b = at, at + d
                good = (group[a] != group[b]) & ((side[a] != side[b]) | (side[a] == 2))
                a, b = a[good], b[good]
                both = n[a] + n[b]
                good = k + np.minimum(n[a] - 1 - last[a], n[b] - 1 - last[b]) >= rule.shared(both)
                a, b, both = a[good], b[good], both[good]
                differ = np.zeros(len(a), np.int64)
                if p:
                    differ = sum(np.bitwise_count(q[a].view(np.uint64) ^ q[b].view(np.uint64)).astype(np.int64) for q in p)
                    good = differ <= both - 2 * rule.shared(both)
                    a, b, differ = a[good], b[good], differ[good]
                if not len(a):
                    continue
                if most is None:
                    u, v = sid[a], sid[b]
                    out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))
                    continue
                close.append(np.stack([a, b, differ], axis=1))
                if sum(map(len, close)) > max(PAIRS, 2 * waiting):
                    waiting = thin()
            if close:
                thin()
                a, b = close[0][:, 0], close[0][:, 1]
                u, v = sid[a], sid[b]
                out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1))

        def sent(least: int) -> Iterator[pa.RecordBatch]:
            if sum(map(len, out)) > least:
                both = np.unique(np.concatenate(out), axis=0)
                out.clear()
                yield _batch(["a", "b"], [both[:, 0].copy(), both[:, 1].copy()])
            if sum(map(len, left)):
                keys = np.unique(np.concatenate(left))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.int64())], ["a", "b"])
            left.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in columns]
            new = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(new[-1]) + 1 if len(new) else 0  # the last place may go on in the next batch
            if cut or (held and any(held[-1][i][-1] != rows[i][0] for i in range(3))):
                pairs(*[np.concatenate(z) for z in zip(*held, [z[:cut] for z in rows], strict=True)])
                held = []
                yield from sent(PAIRS)
            held.append([z[cut:] for z in rows])
        if held:
            pairs(*[np.concatenate(z) for z in zip(*held, strict=True)])
        yield from sent(0)

    dealt = rows.select(*columns).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "n", "sid")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _settled(rows: DataFrame, links: DataFrame, sets: DataFrame, rule: Rule, k: int, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(candidates not verified yet, links): those of :func:`_crossing`, the closest of each set first.

    Under keys where others were left out, what was found is verified, sets that links connect become one group, and the sets
    of such keys meet again with more room. No key is given up before it has no pair of different groups left out.
    """
    most = CLOSEST
    while True:
        found = keep(_crossing(rows, sets, rule, k, most=most), "crossing")
        pairs, open_keys = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("key")).distinct()
        if open_keys.isEmpty():
            return pairs, links
        links = keep(links.union(verify(pairs)), "links")
        rows = rows.join(few(open_keys), "key", "left_semi").drop("group").join(few(_classes(sets, links)), "sid")
        rows, most = keep(rows, "open"), most * MORE


def crossing_pairs(met: DataFrame, links: DataFrame, sets: DataFrame, rule: Rule, verify: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(candidates, links): all candidates of different groups, by single tokens, by combinations of frequent ones, then in
    blocks; or, of sets with many candidates, what ``verify`` has added to ``links``."""
    groups = _close_by(links)
    large = few(met.where("sid < 0").select("key").distinct())
    rows = met.where("sid >= 0").select("key", "sid", "n", "last").join(few(groups), "sid", "left").withColumn("group", F.coalesce("group", "sid"))
    whole = {"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long"), "side": F.lit(2)}
    found = [keep(_crossing(rows.join(large, "key", "left_anti").withColumns(whole), sets, rule, 1, signs=False), "crossing")]
    rows = _mixed(rows.join(large, "key", "left_semi"))
    for k in range(1, MOST_TOKENS + 1):
        pairs, links = _settled(rows.where(F.col("sets") <= GROUP).withColumns(whole), links, sets, rule, k, verify)
        found.append(pairs)
        many = rows.where(F.col("sets") > GROUP)
        if many.isEmpty():
            break
        often = (F.col("crossing") > 2 * GROUP * F.col("sets")) if k < MOST_TOKENS else F.lit(False)
        blocked = many.where(~often)
        if not blocked.isEmpty():
            pairs, links = _settled(_blocks(blocked), links, sets, rule, k, verify)
            found.append(pairs)
        combined = many.where(often)
        if combined.isEmpty():
            break
        later = F.slice("prefix", F.col("last").cast("int") + 2, F.greatest(F.lit(0), rule.prefix(F.col("n"), k + 1) - F.col("last") - 1).cast("int"))
        longer = combined.join(sets.select("sid", "prefix"), "sid").select("key", "sid", "n", "last", "group", F.posexplode(later).alias("after", "token"))
        rows = _mixed(longer.select(F.xxhash64("key", "token").alias("key"), "sid", "n", (F.col("last") + 1 + F.col("after")).alias("last"), "group"))
    return reduce(DataFrame.union, found).distinct(), links


def joined(docs: DataFrame, rule: Rule, row: str, text: str, mark: Callable[[np.ndarray], int] | None = None, hints: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sets, classes) of ``docs``: documents have place (null flag, row, row's two hashes), h1, h2 and n; classes
    are (sid, group) where group names what links connect. ``hints(sets)`` are pairs of sets that are compared at first, besides the pivots."""
    keyed = docs.select(*[k for k in row_key(F.col(row), F.col(text))], F.col(row).alias("row"), F.col(text).alias("text"))
    listed = frequent(keyed, "text", rule.words)
    place = F.struct(F.col("row").isNull().alias("no_id"), "row", "__k1", "__k2").alias("place")
    documents = keep(signed(keyed.select(place, "text"), "text", rule, listed, mark), "documents")
    sets = distinct_sets(documents)
    met = meetings(sets, rule, listed)
    first = pivot_pairs(met, rule, bool((listed[1] > PIVOT_ROWS).any()))

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(pairs, sets, keyed, "text", rule)

    pairs, links = crossing_pairs(met, verify(first.union(hints(sets)) if hints else first), sets, rule, verify)
    return documents, sets, _classes(sets, links.union(verify(pairs)))


def near_duplicates(docs: DataFrame, row: str = "doc_id", text: str = "text", rule: Rule = Rule(4, 85)) -> DataFrame:
    """(row, n_shingles, component_id): size of the shingle set, and the smallest id reachable over links, itself included.

    A-Z are lower-cased, words are parted by ASCII white space; a text of fewer words than a shingle is one shingle. Texts
    that are null or have no words have no shingles and are linked with nothing. Equal sets are one set from the start, so
    copies are never compared. Shingles are compared by 64-bit hashes. A null id never names a component, unless all ids
    of it are null; repeated ids and rows are documents like others. No rows give no rows; other columns are not looked at.
    """
    documents, sets, classes = joined(docs, rule, row, text)
    named = sets.select("sid", "h1", "h2", "least.row").join(classes, "sid")
    least = named.groupBy("group").agg(F.min("row").alias("component_id"))
    named = named.join(least, "group").select("h1", "h2", "component_id")
    out = documents.select(F.col("place.row").alias("row"), F.col("n").alias("n_shingles"), "h1", "h2")
    some = out.where("n_shingles > 0").join(named, ["h1", "h2"]).select(F.col("row").alias(row), "n_shingles", "component_id")
    return some.union(out.where("n_shingles = 0").select("row", "n_shingles", F.col("row").alias("component_id")))
