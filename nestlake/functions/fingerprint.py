"""Bit fingerprints as arrays of 64-bit words, compared inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def words_of(bits: list[int], size: int) -> list[int]:
    """Signed 64-bit words with the given bits set."""
    out = [0] * (-(-size // 64))
    for b in bits:
        out[b // 64] |= 1 << (b % 64)
    return [w - (1 << 64) if w >> 63 else w for w in out]


def literal(words: list[int]) -> Column:
    return F.array(*[F.lit(w).cast("long") for w in words])


def popcount(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda a, w: a + F.bit_count(w))


def common_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)


def tanimoto(a: Column, b: Column, count_a: Column, count_b: Column) -> Column:
    """Shared bits over all bits; two empty fingerprints have none in common."""
    both = common_bits(a, b)
    return F.when(count_a + count_b > 0, both / (count_a + count_b - both)).otherwise(F.lit(0.0))


def dice(a: Column, b: Column, count_a: Column, count_b: Column) -> Column:
    return F.when(count_a + count_b > 0, 2 * common_bits(a, b) / (count_a + count_b)).otherwise(F.lit(0.0))


def popcount_bounds(threshold: float, count: int) -> tuple[int, int]:
    """Popcounts that can reach the threshold, widened by one against rounding; the exact test decides."""
    return max(0, math.ceil(threshold * count) - 1), math.floor(count / threshold) + 1


def covers(words: Column, query: Column) -> Column:
    """Every bit of the query is set."""
    return F.forall(F.zip_with(words, query, lambda x, y: x.bitwiseAND(y) == y), lambda ok: ok)


def from_signs(vector: Column) -> Column:
    """One word from the signs of up to 64 numbers."""
    return F.aggregate(
        F.transform(vector, lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, w: a.bitwiseOR(w),
    )
