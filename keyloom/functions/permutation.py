"""Keyed pseudo-random permutations of positions in column arithmetic: any number of shuffles of one ranking, without sorting again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.hashing import hash_word

ROUNDS = 4
# Positions outside the range are permuted again. Fewer than sqrt(size) positions are outside, one in sqrt(size).
MOST_WALKS = 64


def _whole(dividend: Column, divisor: Column) -> Column:
    return ((dividend - dividend % divisor) / divisor).cast("long")


def _rounds(place: Column, width: Column, height: Column, key: list[Column]) -> Column:
    """One pass of a Feistel network over ``width`` x ``height`` positions: each half moves by a hash of the other."""
    low, high = place % width, _whole(place, width)
    for k in range(ROUNDS):
        moving, fixed, size = (low, high, width) if k % 2 == 0 else (high, low, height)
        drawn = hash_word(F.md5(F.concat_ws("|", *[c.cast("string") for c in (*key, F.lit(k), fixed)])))
        moved = (moving + drawn) % size
        low, high = (moved, high) if k % 2 == 0 else (low, moved)
    return high * width + low


def permuted(place: Column, size: Column, *key: Column) -> Column:
    """Where the keyed permutation of 0 .. ``size`` - 1 sends ``place``; another key is another permutation.

    The network works on the least rectangle of about square shape that has ``size`` positions; what falls outside ``size``
    walks on until it is inside, so that the result is a permutation of the positions themselves.
    """
    width = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    height = _whole(size + width - 1, width)
    first = _rounds(place, width, height, list(key))

    def walk(at: Column, _: Column) -> Column:
        return F.when(at < size, at).otherwise(_rounds(at, width, height, list(key)))

    inside = F.when(first < size, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(MOST_WALKS)), first, walk))
    return F.when(inside < size, inside).otherwise(F.raise_error(F.lit("a position did not come back into its range")).cast("long"))
