"""Ranking metrics per user and their report, over any number of tagged test sets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def harmonic(n: Column) -> Column:
    """Approximate harmonic number, defined for fractions."""
    return 0.5772156649015329 + F.log(n) + 0.5 / n - 1 / (12 * n * n) + 1 / (120 * n * n * n * n)


def ideal_dcg(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(0), n.cast("int") - 1), F.lit(0.0), lambda s, i: s + 1 / F.log2(i.cast("double") + 2))


def user_metrics(test: DataFrame, recs: DataFrame, n_items: int, k: int = 10) -> DataFrame:
    """One row per (dataset, userid) with a test item.

    ``test`` is (dataset, userid, itemid), ``recs`` (userid, itemid, rank) with 0-based ranks.
    Test items that were not recommended have no rank and count as misses.
    """
    hits = test.select("dataset", "userid", "itemid").distinct().join(recs.select("userid", "itemid", "rank"), ["userid", "itemid"], "left")
    w = Window.partitionBy("dataset", "userid").orderBy(F.col("rank").asc_nulls_last(), F.col("itemid").asc())
    hits = hits.withColumn("i", F.row_number().over(w) - 1).withColumn("n_hit", F.count("rank").over(Window.partitionBy("dataset", "userid")))
    r, top = F.col("rank"), F.col("rank") < k
    area = F.when(r.isNotNull(), 1 - F.greatest(F.lit(0), r - F.col("i")) / F.nullif(F.lit(n_items) - F.col("n_hit"), F.lit(0)))  # hits only
    g = hits.groupBy("dataset", "userid").agg(
        F.count("*").alias("pos"),
        F.avg(area.cast("double")).alias("auc"),
        F.max(1 / (r + 1)).alias("reciprocal"),
        F.sum(F.when(top, 1 / (r + 1))).alias("rr_k"),
        F.sum(1 / (r + 1)).alias("rr"),
        F.sum(F.when(top, 1 / F.log2(r + F.lit(2.0)))).alias("dcg"),
        F.count_if(top).alias("hit_k"),
    )
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    cap = F.least(F.lit(k), F.col("pos"))
    return g.select(
        "dataset",
        "userid",
        F.coalesce("auc", F.lit(0.5)).alias("auc"),
        zero("reciprocal").alias("reciprocal"),
        (zero("rr_k") / harmonic(cap + 0.001)).alias("n_mrr_at_k"),
        (zero("rr") / harmonic(F.col("pos") + 0.001)).alias("n_mrr"),
        (zero("dcg") / ideal_dcg(cap)).alias("n_dcg_at_k"),
        (F.col("hit_k") / cap).alias("n_precision_at_k"),
        (F.col("hit_k") / F.lit(float(k))).alias("precision_at_k"),
        (F.col("hit_k") / F.col("pos")).alias("recall_at_k"),
        (F.col("hit_k") / cap).alias("n_recall_at_k"),
    )


METRICS = ("auc", "reciprocal", "n_mrr_at_k", "n_mrr", "n_dcg_at_k", "n_precision_at_k", "precision_at_k", "recall_at_k", "n_recall_at_k")


def coverage(test: DataFrame, recs: DataFrame, k: int = 10) -> DataFrame:
    """(dataset, n_coverage_at_k): distinct hit items within k over those an ideal ranking would reach.

    The ideal ranking takes each user's test items in order of itemid.
    """
    pairs = test.select("dataset", "userid", "itemid").distinct()
    hit = pairs.join(recs.filter(F.col("rank") < k).select("userid", "itemid"), ["userid", "itemid"], "left_semi").groupBy("dataset").agg(F.count_distinct("itemid").alias("hit"))
    best = pairs.withColumn("i", F.row_number().over(Window.partitionBy("dataset", "userid").orderBy("itemid"))).filter(F.col("i") <= k).groupBy("dataset").agg(F.count_distinct("itemid").alias("best"))
    return best.join(hit, "dataset", "left").select("dataset", (F.coalesce("hit", F.lit(0)) / F.col("best")).alias("n_coverage_at_k"))


def report(test: DataFrame, recs: DataFrame, n_items: int, k: int = 10, digits: int = 6) -> DataFrame:
    """One row per dataset: means of all metrics over users."""
    means = user_metrics(test, recs, n_items, k).groupBy("dataset").agg(*[F.avg(m).alias(m) for m in METRICS])
    return means.join(coverage(test, recs, k), "dataset").select("dataset", *[F.round(m, digits).alias(m) for m in (*METRICS, "n_coverage_at_k")])


def gini_at_k(recs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(gini): inequality of how often each item is within the first k, items never there included.

    Counts are summed per distinct count first, so the ordering window sees few rows.
    """
    counts = recs.filter(F.col("rank") < k).groupBy("itemid").agg(F.count("*").alias("x"))
    per = items.select("itemid").distinct().join(counts, "itemid", "left").groupBy(F.coalesce("x", F.lit(0)).alias("x")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))  # one row per distinct count
    placed = per.withColumn("last", upto).withColumn("mid", F.col("last") - (F.col("m") - 1) / 2)
    n, total = F.sum("m"), F.sum(F.col("x") * F.col("m"))
    return placed.agg((2 * F.sum(F.col("mid") * F.col("x") * F.col("m")) / F.nullif(n * total, F.lit(0)) - (n + 1) / n).alias("gini"))
