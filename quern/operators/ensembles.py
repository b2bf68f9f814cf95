"""Rank combination, cascades, geographic grids, boxes and cell assignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.quantiles import grouped_quantiles, quantiles
from quern.operators.ranks import mean_ranks
from quern.scratch import cut

COMBINERS = ("hmean", "gmean", "mean", "min", "max")


def combine_ranks(frames: Sequence[DataFrame], group: str, item: str, score: str, fill: float, how: str | Callable = "hmean") -> DataFrame:
    """(group, item, score): f over 1/rank of every frame; an absent item has rank ``fill``. See combine_members."""
    rows = reduce(DataFrame.unionByName, [df.select(group, item, score).withColumn("__q_m", F.lit(i)) for i, df in enumerate(frames)])
    return combine_members(rows, "__q_m", group, item, score, fill, how, len(frames))


def combine_members(df: DataFrame, member: str, group: str, item: str, score: str, fill: float, how: str | Callable = "hmean", n: int | None = None) -> DataFrame:
    """(group, item, score): f over 1/rank in every member's list of the group; an absent item has rank ``fill``.

    One grouping instead of a chain of outer joins: the absent ranks enter as a closed form of
    how many of the ``n`` members (by default, all that occur) lack the item. Equal scores share
    their mean rank; repeated rows count once; null ids and null or NaN scores are left out. A
    callable takes a block of rows x members of 1/rank and the axis, as numpy reducers do.
    """
    rows = df.select(member, group, item, F.col(score).cast("double").alias(score)).filter(F.col(score).isNotNull() & ~F.isnan(score)).dropna(subset=[member, group, item]).distinct()
    if n is None:
        rows = cut(rows, "members")
        names = sorted(r[0] for r in rows.select(member).distinct().collect())  # one row a member
    else:
        names = list(range(n))
    ranked = mean_ranks(rows, [group, member], score)
    if callable(how):
        own = ranked.groupBy(group, item).agg(F.map_from_entries(F.collect_list(F.struct(member, "rank"))).alias("m"))
        votes = F.array(*[1 / F.coalesce(F.element_at("m", F.lit(k)), F.lit(float(fill))) for k in names])

        @F.pandas_udf("double")
        def call(v: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(how(np.stack(v.to_numpy()), axis=1), float)) if len(v) else pd.Series(dtype=float)

        return own.select(group, item, call(votes).alias(score))
    total = len(names)
    lack = F.lit(total) - F.count("*")
    gone = F.lit(1.0 / fill)
    some = lack > 0
    forms: dict[str, Column] = {
        "hmean": F.lit(float(total)) / (F.sum("rank") + lack * float(fill)),
        "gmean": F.exp((F.sum(-F.log("rank")) + lack * F.log(gone)) / total),
        "mean": (F.sum(1 / F.col("rank")) + lack * gone) / total,
        "min": F.least(F.min(1 / F.col("rank")), F.when(some, gone)),
        "max": F.greatest(F.max(1 / F.col("rank")), F.when(some, gone)),
    }
    if how not in forms:
        raise ValueError(f"how must be callable or one of {COMBINERS}")
    return ranked.groupBy(group, item).agg(forms[how].alias(score))


def cascade(candidates: DataFrame, scorer: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """The first model's candidates (userid, itemid), scored again by the second, cut to n."""
    from quern.operators.recommend import top_per_user

    return top_per_user(scorer(candidates.select("userid", "itemid")), n)


def in_box(lat: Column, long: Column, box: tuple[float, float, float, float]) -> Column:
    """(min_lat, max_lat, min_long, max_long), inclusive."""
    return lat.between(box[0], box[1]) & long.between(box[2], box[3])


def in_circle(lat: Column, long: Column, centre: tuple[float, float], max_sq_dist: float) -> Column:
    return F.pow(lat - centre[0], 2) + F.pow(long - centre[1], 2) <= max_sq_dist


def in_square(lat: Column, long: Column, centre: tuple[float, float], side: float) -> Column:
    h = side / 2
    return in_box(lat, long, (centre[0] - h, centre[0] + h, centre[1] - h, centre[1] + h))


def clean_places(df: DataFrame) -> DataFrame:
    """lat and long as doubles; rows without a readable lat or long go."""
    out = df.withColumns({c: F.col(c).try_cast("double") for c in ("lat", "long")})
    return out.filter("lat is not null and long is not null and not isnan(lat) and not isnan(long)")


def uniform_grid(df: DataFrame, n_lat: int, n_long: int, margin: float) -> DataFrame:
    """(cell, lat_lo, lat_hi, long_lo, long_hi): equal cells over the bounding box, widened by the margin."""
    box = df.agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("long").alias("c"), F.max("long").alias("d"))
    cells = box.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_lat - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_long - 1))).alias("j"))
    h, w = (F.col("b") - F.col("a")) / n_lat, (F.col("d") - F.col("c")) / n_long
    edge = lambda lo, step, k, sign: F.round(lo + step * (k + (1 if sign > 0 else 0)) + sign * margin, 9)
    return cells.select((F.col("i") * n_long + F.col("j")).alias("cell"), edge(F.col("a"), h, F.col("i"), -1).alias("lat_lo"), edge(F.col("a"), h, F.col("i"), 1).alias("lat_hi"), edge(F.col("c"), w, F.col("j"), -1).alias("long_lo"), edge(F.col("c"), w, F.col("j"), 1).alias("long_hi"))


def equidense_grid(df: DataFrame, n_lat: int, n_long: int, margin: float) -> DataFrame:
    """Latitude bands of equal counts, each cut into longitude bands of equal counts, widened by the margin."""
    steps = lambda n: [i / n for i in range(n + 1)]
    p = quantiles(df, "lat", steps(n_lat))
    bands = [(i, p[i], p[i + 1]) for i in range(n_lat)] if p else []
    kind = "cell int, lat_lo double, lat_hi double, long_lo double, long_hi double"
    spark = df.sparkSession
    if not bands:
        return spark.createDataFrame([], kind)
    inside = df.join(F.broadcast(spark.createDataFrame(bands, "i int, lo double, hi double")), F.col("lat").between(F.col("lo"), F.col("hi")))  # n_lat rows
    longs = grouped_quantiles(inside, "i", "long", steps(n_long))
    cells = [(i * n_long + j, round(lo - margin, 9), round(hi + margin, 9), round(longs[i][j] - margin, 9), round(longs[i][j + 1] + margin, 9)) for i, lo, hi in bands if i in longs for j in range(n_long)]
    return spark.createDataFrame(cells, kind)


def assign_cells(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every cell that holds the row; the grid is a few rows, so the range join is a broadcast."""
    return df.join(F.broadcast(grid), F.col("lat").between(F.col("lat_lo"), F.col("lat_hi")) & F.col("long").between(F.col("long_lo"), F.col("long_hi"))).select(*df.columns, "cell")
