"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def similarity(a: Column, b: Column, mode: str) -> Column:
    """cosine, dot or euclidean, the latter as 1 / (distance + 0.001)."""
    if mode == "cosine":
        return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    if mode == "dot":
        return dot(a, b)
    if mode == "euclidean":
        gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
        return 1 / (F.sqrt(gap) + 0.001)
    raise ValueError("mode must be 'cosine', 'dot' or 'euclidean'")
