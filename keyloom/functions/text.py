"""Token and n-gram expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: runs of at least two word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Fixed value: Unicode white space at either end of a string.
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Removes white space of every kind at both ends; NULL becomes the empty string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), EDGE_SPACE, "")


def tokens(text: Column) -> Column:
    """Lower-case word tokens in text order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(words: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of ``low`` to ``high`` adjacent words, joined by a space, shorter ones first."""
    if not 1 <= low <= high:
        raise ValueError("need 1 <= low <= high")
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(words)
            continue
        span = F.greatest(F.size(words) - (n - 1), F.lit(0))
        grams = F.slice(words, 1, span)
        for shift in range(1, n):
            grams = F.zip_with(grams, F.slice(words, shift + 1, span), lambda a, b: F.concat_ws(" ", a, b))
        parts.append(grams)
    return F.concat(*parts) if len(parts) > 1 else parts[0]
