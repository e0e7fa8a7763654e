"""N-grams, imprints and the Jaccard coefficient as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ngrams(tokens: Column | str, n: int = 3) -> Column:
    """All runs of n tokens; none if there are fewer tokens."""
    t = col(tokens)
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - n + 1, F.lit(1))), lambda i: F.slice(t, i, n))
    return F.filter(every, lambda g: F.size(g) == n)


def unique_ngrams(tokens: Column | str, n: int = 3) -> Column:
    return F.array_distinct(ngrams(tokens, n))


def hashed_ngrams(tokens: Column | str, n: int = 3, unique: bool = False) -> Column:
    """64-bit hashes of the n-grams."""
    t = col(tokens)
    out = F.transform(F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(n)]))
    out = F.when(F.size(t) >= n, out).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(out) if unique else out


def imprints(hashes: Column | str) -> Column:
    """Every k-th hash, where k is the whole part of the binary logarithm of their
    number; null for fewer than two hashes, where the step is undefined."""
    h = col(hashes)
    n = F.size(h)
    # The length of a number in binary less one is the whole part of its logarithm.
    k = F.length(F.bin(n)).cast("int") - 1
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 1, F.greatest(k, F.lit(1))), lambda i: F.get(h, i)))


def jaccard_of_sets(a: Column | str, b: Column | str) -> Column:
    """Size of the intersection over that of the union of two arrays as sets; 0.0 if both are empty."""
    both, every = F.size(F.array_intersect(col(a), col(b))), F.size(F.array_union(col(a), col(b)))
    return F.when(every > 0, both.cast("double") / every).otherwise(F.lit(0.0))


def jaccard(tokens1: Column | str, tokens2: Column | str, n: int = 3) -> Column:
    return jaccard_of_sets(ngrams(tokens1, n), ngrams(tokens2, n))
