"""Exact, interpolated quantiles without holding a column's values in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.positions import with_positions


def quantiles(df: DataFrame, col: str, at: Sequence[float]) -> list[float]:
    """The quantiles ``at`` (0 .. 1) of a number column; empty if it holds no number.

    Distinct values are counted first and placed by range partitions; only the two
    values around each quantile come to the driver. Nulls and NaN are left out.
    """
    return grouped_quantiles(df.select(F.lit(0).alias("g"), F.col(col).alias("v")), "g", "v", at).get(0, [])


def grouped_quantiles(df: DataFrame, group: str, col: str, at: Sequence[float]) -> dict[object, list[float]]:
    """Quantiles per group, for a number of groups that a driver holds (bands, bins)."""
    values = df.select(F.col(group).alias("g"), (F.col(col).cast("double") + 0.0).alias("v")).filter("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count("*").alias("n"))
    placed = with_positions(values, ["g"], [F.col("v").asc()], out="upto", weight="n")
    out: dict[object, list[float]] = {}
    sizes = {r[0]: r[1] for r in placed.groupBy("g").agg(F.max("upto")).collect()}  # one row a group
    wanted = {g: sorted({i for q in at for i in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}) for g, n in sizes.items()}
    if not wanted:
        return out
    asked = df.sparkSession.createDataFrame([(g, i) for g, places in wanted.items() for i in places], f"g {placed.schema['g'].dataType.simpleString()}, i long")
    held = placed.join(F.broadcast(asked), "g").filter((F.col("i") < F.col("upto")) & (F.col("i") >= F.col("upto") - F.col("n"))).select("g", "i", "v").collect()  # two rows a quantile
    value = {(r[0], r[1]): r[2] for r in held}
    for g, n in sizes.items():
        row = []
        for q in at:
            h = (n - 1) * q
            lo, hi = value[g, math.floor(h)], value[g, math.ceil(h)]
            row.append(lo + (hi - lo) * (h - math.floor(h)))
        out[g] = row
    return out
