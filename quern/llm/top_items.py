"""Top N items within every group, by a global range-partitioned sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.positions import with_positions


def top_n_per_group(df: DataFrame, groups: Sequence[str], orders: Sequence[Column], n: int, out: str = "position") -> DataFrame:
    """The first ``n`` rows of every group in the order given, with their position.

    Rows are sorted globally on group, score and identifier over range partitions, so
    a group of any size spans as many tasks as it needs; positions are exact prefix
    sums of the groups' counts per partition. Null groups form one group; an empty
    table gives none; repeated rows each take a position; extra columns pass.
    """
    return with_positions(df, groups, orders, out=out, keep=n)


def first_ratings(ratings: DataFrame) -> DataFrame:
    """One row for every exact (userid, itemid) with both non-blank and a real rating.

    The row with the earliest first_timestamp counts (null last), then the higher
    rating; the pair is reduced before the shuffle.
    """
    real = F.col("rating").isNotNull() & ~F.isnan("rating")
    rows = ratings.filter((F.trim("userid") != "") & (F.trim("itemid") != "") & real)
    best = F.min(F.struct(F.col("first_timestamp").isNull().alias("late"), F.col("first_timestamp").alias("ts"), (-F.col("rating")).alias("neg")))
    return rows.groupBy("userid", "itemid").agg(best.alias("b")).select("userid", "itemid", (-F.col("b.neg")).alias("rating"), F.col("b.ts").alias("first_timestamp"))


def best_rated(ratings: DataFrame, n: int = 5) -> DataFrame:
    """Each user's first ``n`` items: rating, then latest first_timestamp (null last), then itemid."""
    orders = [F.col("rating").desc(), F.col("first_timestamp").desc_nulls_last(), F.col("itemid").asc()]
    return top_n_per_group(first_ratings(ratings), ["userid"], orders, n)
