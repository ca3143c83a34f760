"""Seeded draws as hashes: the same rows are drawn whatever the partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_hash(seed: object, *cols: str | Column) -> Column:
    """32 hex digits that order rows at random, fixed by the seed and the row's own identity."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sized_cell(value: Column) -> Column:
    """Length, colon and text of a value, or ``n`` for NULL: cells of different values differ, also when joined."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def hash_word(digest: Column, word: int = 0) -> Column:
    """The ``word``-th 32-bit word (8 hex digits) of a hex digest as a non-negative long."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")


def derive_seed(*parts: object) -> int:
    """Seed for driver-side draws: SHA-256 of the parts joined by ``|``, first four bytes, little-endian."""
    text = "|".join(str(part) for part in parts)
    return int.from_bytes(hashlib.sha256(text.encode("utf-8")).digest()[:4], "little")


def derive_seed_column(*cols: str | Column) -> Column:
    """Column form of :func:`derive_seed`."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    swapped = F.concat(*[F.substring(digest, start, 2) for start in (7, 5, 3, 1)])
    return F.conv(swapped, 16, 10).cast("long")
