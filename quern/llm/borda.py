"""One ranking from several differently-scaled scores: weighted Borda count."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ranks import mean_ranks


def borda(df: DataFrame, group: str, source: str, item: str, score: str, weights: Mapping[str, float] | None = None, missing: str = "middle") -> DataFrame:
    """(group, item, mean_rank, sources): one order of a group's items, the best first by mean_rank, then item.

    Every source (recommender) of a group ranks the items it scored, the highest score
    first, ties sharing their mean rank. An item that only other sources scored gets the
    middle of the places left over (``missing='middle'``) or the place after the list
    (``missing='after'``). mean_rank is the weighted mean over the sources that have a
    score left in the group; a lower mean rank is a higher number of Borda points.

    Null and NaN scores are left out, -Infinity counts as the lowest; rows with a null
    group, source or item are left out; repeated rows count once, and of several scores
    of one source for one item the highest counts. Sums over absent pairs are closed
    forms, so no item is crossed with the sources that lack it.
    """
    if missing not in ("middle", "after"):
        raise ValueError("missing must be 'middle' or 'after'")
    col = lambda c: F.col(f"`{c}`")
    rows = df.select(col(group).alias("g"), col(source).alias("s"), col(item).alias("i"), (col(score).cast("double") + 0.0).alias("score"))
    rows = rows.filter("g is not null and s is not null and i is not null and score is not null and not isnan(score)")
    rows = rows.groupBy("g", "s", "i").agg(F.max("score").alias("score"))
    ranked = mean_ranks(rows, ["g", "s"], "score", listed="listed")
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("s")), F.lit(1.0))
    ranked = ranked.withColumn("w", w)
    lists = ranked.groupBy("g", "s").agg(F.max("w").alias("w"), F.max("listed").alias("listed"))
    if missing == "after":
        # sum over all sources of w (listed + 1), corrected by those that scored the item
        totals = lists.groupBy("g").agg(F.sum(F.col("w") * (F.col("listed") + 1)).alias("absent"), F.sum("w").alias("all_w"), F.count("*").alias("sources"))
        items = ranked.groupBy("g", "i").agg(F.sum(F.col("w") * (F.col("rank") - F.col("listed") - 1)).alias("own"))
        points = items.join(totals, "g").select("g", "i", ((F.col("own") + F.col("absent")) / F.col("all_w")).alias("mean_rank"), "sources")
    else:
        # the absent items of a list share the places listed+1 .. items of the group
        per_item = ranked.groupBy("g", "i").agg(F.sum(F.col("w") * F.col("rank")).alias("own"), F.sum("w").alias("own_w"), F.sum(F.col("w") * F.col("listed")).alias("own_l"))
        union = per_item.groupBy("g").agg(F.count("*").alias("n"))
        totals = lists.groupBy("g").agg(F.sum(F.col("w") * F.col("listed")).alias("all_l"), F.sum("w").alias("all_w"), F.count("*").alias("sources")).join(union, "g")
        rest = ((F.col("all_l") - F.col("own_l")) + (F.col("all_w") - F.col("own_w")) * (F.col("n") + 1)) / 2
        points = per_item.join(totals, "g").select("g", "i", ((F.col("own") + rest) / F.col("all_w")).alias("mean_rank"), "sources")
    return points.select(F.col("g").alias(group), F.col("i").alias(item), "mean_rank", "sources")


def borda_top(df: DataFrame, group: str, source: str, item: str, score: str, n: int, missing: str = "middle", weights: Mapping[str, float] | None = None) -> DataFrame:
    """The first ``n`` items of every group, with mean_rank and position.

    A row number with a bound is cut to n rows a group in every task before its shuffle, so a
    group of any size arrives as n rows from each of them.
    """
    points = borda(df, group, source, item, score, weights, missing)
    order = Window.partitionBy(f"`{group}`").orderBy(F.col("mean_rank").asc(), F.col(f"`{item}`").asc())
    return points.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
