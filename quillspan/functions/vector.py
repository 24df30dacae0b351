"""Vector predicates and arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(e: Column, dimension: Column | int) -> Column:
    """The vector is not NULL, of the dimension, free of NULL, NaN and infinite elements, and not all zeros."""
    high, low = F.array_max(e), F.array_min(e)
    finite = (F.size(F.array_compact(e)) == F.size(e)) & (high < float("inf")) & (low > float("-inf"))
    return F.coalesce(e.isNotNull() & (F.size(e) == dimension) & finite & ((high != 0) | (low != 0)), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in element order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if either vector is all zeros."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_normalised(a: Column) -> Column:
    """The vector divided by its length; an all-zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def sign_bits(a: Column) -> Column:
    """One-bit quantisation: 1 where the element is positive, as a string of 0 and 1."""
    return F.array_join(F.transform(a, lambda x: F.when(x > 0, "1").otherwise("0")), "")


def sign_word(a: Column, start: int, width: int = 32) -> Column:
    """Sign bits of elements [start, start + width) as a bigint, first element highest."""
    part = F.slice(a, start + 1, width)
    return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0).cast("bigint"))
