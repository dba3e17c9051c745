"""Vector functions over arrays, in double precision and JVM-side."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, dim: int) -> Column:
    """Not null, of the length, all finite, not all zero."""
    fine = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(doubles(v), lambda x: x != 0)


def edge_width(score: Column, low: float = 0.90, high: float = 1.0, thin: float = 1.5, thick: float = 8.0) -> Column:
    """Clamped linear map of a score to a line width."""
    t = F.least(F.greatest((score - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return thin + t * (thick - thin)
