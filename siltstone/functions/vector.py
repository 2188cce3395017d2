"""Vector expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions up to which a dot product with constants is written out, which the JVM compiles.
WRITTEN_OUT = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_with(a: Column, query: Sequence[float]) -> Column:
    """Dot product with a constant vector."""
    if len(query) <= WRITTEN_OUT:
        return reduce(Column.__add__, [F.get(a, F.lit(k)).cast("double") * F.lit(float(q)) for k, q in enumerate(query)], F.lit(0.0))
    return dot(a, F.array(*[F.lit(float(q)) for q in query]))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance_to(a: Column, query: Sequence[float], unit: bool = False) -> Column:
    """1 - cos to a constant vector; unit: the column's vectors have length 1."""
    length = sum(float(q) ** 2 for q in query) ** 0.5
    if not length:
        return F.lit(None).cast("double")
    near = dot_with(a, [float(q) / length for q in query])
    return 1 - (near if unit else F.try_divide(near, norm(a)))


def is_valid(a: Column, dimensions: int) -> Column:
    return F.coalesce(F.size(a) == dimensions, F.lit(False))


def hashed_embedding(tokens: Column, dimensions: int = 64) -> Column:
    """The offline embedder: signed feature hashing of tokens, of length 1 (zero where there are no tokens)."""
    code = lambda t: (F.pmod(F.xxhash64(t), F.lit(dimensions)) * 2 + F.pmod(F.xxhash64(t, F.lit("sign")), F.lit(2))).cast("int")
    # Bound by arrays of one, so that tokens, codes and sums are worked out once a row and not once a dimension.
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    # How many of a dimension's even codes more than odd ones: each removal leaves the others.
    sums = lambda c: F.array(*[(F.size(F.array_remove(c, 2 * k + 1)) - F.size(F.array_remove(c, 2 * k))).cast("double") for k in range(dimensions)])
    unit = lambda raw: bound(norm(raw), lambda size: F.transform(raw, lambda x: F.coalesce(F.try_divide(x, size), F.lit(0.0)).cast("float")))
    return F.when(tokens.isNotNull(), bound(F.transform(tokens, code), lambda c: bound(sums(c), unit)))
