"""Competition ranks with averaged ties, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.positions import with_positions


def mean_ranks(df: DataFrame, groups: Sequence[str], score: str, rank: str = "rank", listed: str | None = None) -> DataFrame:
    """Every row with its rank by score descending within the group, 1 for the highest, ties sharing their mean rank.

    Equal scores are counted first, so a group of any length enters the sort as its distinct
    values; the rank of a value is the running count before it plus the middle of its own ties,
    summed over range partitions. ``listed`` also adds the group's number of rows. Rows whose
    score or group is null are left out.
    """
    keys = list(groups)
    held = df.withColumn("__q_s", F.col(score) + 0.0)
    values = held.groupBy(*keys, "__q_s").agg(F.count("*").alias("__q_n"))
    placed = with_positions(values, keys, [F.col("__q_s").desc()], out="__q_u", weight="__q_n")
    ranks = placed.select(*keys, "__q_s", (F.col("__q_u") - (F.col("__q_n") - 1) / F.lit(2.0)).alias(rank))
    out = held.join(ranks, [*keys, "__q_s"]).drop("__q_s")
    if listed:
        out = out.join(values.groupBy(*keys).agg(F.sum("__q_n").alias(listed)), keys)
    return out.select(*df.columns, rank, *([listed] if listed else []))
