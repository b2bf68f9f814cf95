"""Vectors: which are usable, classes of equal ones, arrays in and out of Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(col: Column, dim: int) -> Column:
    """``dim`` finite numbers, not all zero."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(col) == dim) & ~bad & F.exists(col, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int, *keep: str) -> DataFrame:
    """(id, vec, *keep) of the rows with a non-null id and a usable vector; -0.0 becomes 0.0."""
    vec = F.transform(F.col(f"`{vec_col}`").cast("array<float>"), lambda x: x + F.lit(0.0).cast("float"))
    cols = [F.col(f"`{id_col}`").cast("string").alias("id"), vec.alias("vec"), *[F.col(f"`{k}`") for k in keep]]
    return df.filter(F.col(f"`{id_col}`").isNotNull() & is_usable(F.col(f"`{vec_col}`"), dim)).select(*cols)


def vector_key(vec: str) -> Column:
    """128 hashed bits of a vector, as text."""
    return F.concat(F.hex(F.xxhash64(vec)), F.lit("-"), F.hex(F.xxhash64(vec, F.lit(1))))


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as an n x dim array."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge numbers would vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lists(x: np.ndarray) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32)), pa.array(np.ascontiguousarray(x, np.float32).ravel()))
