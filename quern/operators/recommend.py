"""Recommendations by joining histories with similarities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_user(scores: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """(userid, itemid, prediction): the n best per user, scores rounded first, ties by itemid."""
    rows = scores.select("userid", "itemid", F.round("prediction", digits).alias("prediction"))
    w = Window.partitionBy("userid").orderBy(F.col("prediction").desc(), F.col("itemid").asc())
    return rows.withColumn("__q_r", F.row_number().over(w)).filter(F.col("__q_r") <= n).drop("__q_r")


def item_scores(train: DataFrame, sim: DataFrame, binary: bool = True) -> DataFrame:
    """score(u, i) = sum over the user's items j of train(u, j) * sim(j, i)."""
    w = F.lit(1.0) if binary else F.col("rating")
    history = train.select("userid", F.col("itemid").alias("itemid_source"), w.alias("r"))
    return history.join(sim, "itemid_source").groupBy("userid", "itemid").agg(F.sum(F.col("r") * F.col("prediction")).alias("prediction"))


def user_scores(train: DataFrame, sim: DataFrame) -> DataFrame:
    """score(u, i) = sum over similar users v of sim(u, v) * train(v, i); sim is (userid, other, prediction)."""
    theirs = train.select(F.col("userid").alias("other"), "itemid", "rating")
    return sim.join(theirs, "other").groupBy("userid", "itemid").agg(F.sum(F.col("rating") * F.col("prediction")).alias("prediction"))


def recommend(scores: DataFrame, n: int, exclude: DataFrame | None = None, users: DataFrame | None = None, items: DataFrame | None = None, keep_excluded: bool = False) -> DataFrame:
    """The n best per user; excluded pairs are dropped, or rank last at -Infinity with ``keep_excluded``."""
    if users is not None:
        scores = scores.join(users.select("userid").distinct(), "userid", "left_semi")
    if items is not None:
        scores = scores.join(items.select("itemid").distinct(), "itemid", "left_semi")
    if exclude is not None and keep_excluded:
        mark = exclude.select("userid", "itemid").distinct().withColumn("__q_x", F.lit(True))
        scores = scores.join(mark, ["userid", "itemid"], "left").select("userid", "itemid", F.when(F.col("__q_x"), F.lit(float("-inf"))).otherwise(F.col("prediction")).alias("prediction"))
    elif exclude is not None:
        scores = scores.join(exclude.select("userid", "itemid"), ["userid", "itemid"], "left_anti")
    return top_per_user(scores, n)


def fill_zero(scores: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Scores of every given user and item, 0 where nothing was reached; for short lists of users."""
    grid = users.select("userid").distinct().crossJoin(items.select("itemid").distinct())
    return grid.join(scores, ["userid", "itemid"], "left").select("userid", "itemid", F.coalesce("prediction", F.lit(0.0)).alias("prediction"))


def predict_for_user(scores: DataFrame, user: str, items: DataFrame, train: DataFrame | None = None, combine_order: bool = False) -> DataFrame:
    """(userid, itemid, prediction) for one user and a list of items (itemid[, pos]).

    Items without a score get null and, with ``train``, the user's known items too, so both
    come last. ``combine_order`` returns the mean of the rank by prediction and by ``pos``.
    """
    own = scores.filter(F.col("userid") == user).select("itemid", "prediction")
    out = items.join(own, "itemid", "left")
    if train is not None:
        seen = train.filter(F.col("userid") == user).select("itemid").distinct().withColumn("__q_x", F.lit(True))
        out = out.join(seen, "itemid", "left").withColumn("prediction", F.when(F.col("__q_x").isNull(), F.col("prediction"))).drop("__q_x")
    if combine_order:
        known = F.coalesce("prediction", F.lit(float("-inf")))
        place = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0  # noqa: E731  one user's list
        out = out.withColumn("prediction", (place(-F.col("pos")) + place(known)) / 2)
    return out.select(F.lit(user).alias("userid"), "itemid", "prediction")


def factor_scores(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Biases plus dot product for (userid, itemid) pairs; factor tables are (id, bias, factors)."""
    from quern.functions.vectors import dot

    u = users.select(F.col("id").alias("userid"), F.col("bias").alias("ub"), F.col("factors").alias("uf"))
    i = items.select(F.col("id").alias("itemid"), F.col("bias").alias("ib"), F.col("factors").alias("if_"))
    value = dot(F.col("uf"), F.col("if_")) + F.coalesce("ub", F.lit(0.0)) + F.coalesce("ib", F.lit(0.0))
    return pairs.join(u, "userid").join(i, "itemid").select(*pairs.columns, value.alias("prediction"))
