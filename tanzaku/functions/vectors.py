"""Vector expressions over array<float> or array<double> columns; all stay in the JVM and compute in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a side is null or has no length, as a missing vector is never a zero vector."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v: Column) -> Column:
    """``v`` at length one; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def truncated(v: Column, dims: int) -> Column:
    """The first ``dims`` numbers, at length one again."""
    return unit(F.slice(v, 1, dims))


def fused(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of similarities over the active spaces (weight > 0); a missing similarity counts 0."""
    active = [(c, w) for c, w in parts if w > 0]
    if not active:
        raise ValueError("no active space")
    total = sum(w for _, w in active)
    return reduce(lambda x, y: x + y, [F.coalesce(c, F.lit(0.0)) * F.lit(w / total) for c, w in active])


def min_max(c: Column, low: Column, high: Column) -> Column:
    """``c`` scaled into [0, 1]; 0.5 where all values are one."""
    return F.when(high - low < 1e-9, F.lit(0.5)).otherwise((c - low) / (high - low))
