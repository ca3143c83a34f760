"""Random numbers as column expressions: functions of a key, the same in every run and on every machine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.hashing import hash_word

# Attempts of the rejection method; one is accepted with probability over 0.95.
ATTEMPTS = 16


def uniform(*key: Column, word: int = 0) -> Column:
    """A number in (0, 1): the middle of one of 2 ** 32 equal steps."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    return (hash_word(digest, word) + 0.5) * F.lit(2.0**-32)


def gamma(shape: float, *key: Column) -> Column:
    """Gamma number of the given shape and scale 1, by Marsaglia and Tsang's method.

    Each attempt has a normal and a uniform number from one digest; the first that is accepted counts. Shapes below 1 are
    drawn from shape + 1 and shrunk by a power of one more uniform number.
    """
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def attempt(number: Column) -> Column:
        u = [uniform(*key, number, word=w) for w in range(3)]  # of one digest
        x = F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])
        v = F.pow(1 + c * x, F.lit(3.0))
        accepted = (v > 0) & (F.log(u[2]) < 0.5 * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))
        return F.when(accepted, d * v)

    tried = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("double"), lambda found, k: F.coalesce(found, attempt(k)))
    drawn = F.coalesce(tried, F.lit(d))
    return drawn if shape >= 1 else drawn * F.pow(uniform(*key, F.lit("power")), F.lit(1 / shape))
