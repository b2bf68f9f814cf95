"""Queries over the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import borda, clusters, leaks, neighbours, packing, pairs, sentences, splits, top_items
from quern.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_items.best_rated(table(spark, d, "readable_ratings"), 5).select("userid", "itemid")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty items of every user with rating and position."""
    return top_items.best_rated(table(spark, d, "readable_ratings"), 20).select("userid", "itemid", "rating", "position")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.same_person_pairs(table(spark, d, "readable_ratings"), table(spark, d, "readable_users"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every rating with its person and its train, validation or test part."""
    return splits.person_splits(table(spark, d, "readable_ratings"), table(spark, d, "readable_users")).select("userid", "itemid", "rating", "first_timestamp", "component", "split")


def p2_related(spark: SparkSession, d: str) -> DataFrame:
    """Reviews in parts that neither an author nor a copied body crosses."""
    return splits.related_texts(table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    scores = pairs.item_pairs(table(spark, d, "readable_ratings"), min_pair=5).scores(min_pair=5, min_overlap=0.6, min_lift=4.0)
    return scores.select(F.col("item_a").alias("itemid_a"), F.col("item_b").alias("itemid_b"))


def p3_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with their counts and lift, from the same two batches."""
    scores = pairs.item_pairs(table(spark, d, "readable_ratings"), min_pair=5).scores(min_pair=5, min_overlap=0.6, min_lift=4.0)
    return scores.select(F.col("item_a").alias("itemid_a"), F.col("item_b").alias("itemid_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p3_all_baskets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least three baskets and 0.6 overlap, no basket left out."""
    held = pairs.PairTable(spark, max_basket=None, min_pair=2).apply(table(spark, d, "readable_ratings").select("userid", "itemid"))
    strong = held.scores(min_pair=3, min_overlap=0.6)
    return strong.select(F.col("item_a").alias("itemid_a"), F.col("item_b").alias("itemid_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "calc_dfs_and_combine_scores")
    return borda.borda_top(scores, "groupby_col", "recommender", "item_col", "scores_col", 3, missing="after").select("groupby_col", "item_col")


def p4_order(spark: SparkSession, d: str) -> DataFrame:
    """The whole order of every group, absent items at the middle of the places left over."""
    scores = table(spark, d, "calc_dfs_and_combine_scores")
    return borda.borda(scores, "groupby_col", "recommender", "item_col", "scores_col", missing="middle").select("groupby_col", "item_col", F.round("mean_rank", 6).alias("mean_rank"), "sources")


SIDES = (("item", "item_embeddings", "itemid"), ("user", "user_embeddings", "userid"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = [neighbours.similar_pairs(table(spark, d, t), key, t, 0.985).select(F.lit(side).alias("side"), "id_a", "id_b") for side, t, key in SIDES]
    return found[0].unionByName(found[1])


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of the ids whose hash is divisible by 20."""
    found = [neighbours.nearest_vectors(table(spark, d, t), key, t, k=10).select(F.lit(side).alias("side"), "id", "neighbour", F.round("cosine", 5).alias("cosine"), "place") for side, t, key in SIDES]
    return found[0].unionByName(found[1])


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether p5_neighbours finds nine of ten true neighbours of each side, by comparing its queries with all rows."""
    out = None
    for side, t, key in SIDES:
        found = neighbours.measured_recall(table(spark, d, t), key, t, k=10).select(F.lit(side).alias("side"), (F.col("recall") >= 0.9).alias("good"))
        out = found if out is None else out.unionByName(found)
    return out


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return clusters.item_groups(table(spark, d, "item_embeddings"), table(spark, d, "clusterrecommender"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter(F.col("first") != F.col("id")).select(F.col("first").alias("itemid_a"), F.col("id").alias("itemid_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and three most typical items of every group."""
    return clusters.typical_items(_groups(spark, d), 3).select("segment", F.col("first").alias("grp"), "size", "place", "itemid")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.large_texts(packing.pack_texts(table(spark, d, "documents")))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    """The window of every piece of every text."""
    return packing.pack_texts(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "eval_id")


def p9_places(spark: SparkSession, d: str) -> DataFrame:
    """The longest match of every leak and where it stands in both texts."""
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents without any leaked passage."""
    docs = table(spark, d, "documents")
    return leaks.without_leaks(docs, leaks.find_leaks(docs, table(spark, d, "eval_items"))).select("doc_id", "n_chars")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents")).select(F.col("id").alias("doc_id"), "end_pos")


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence with its place and text."""
    return sentences.sentences(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_top, p2_found, p2_splits, p2_related, p3_found, p3_incremental, p3_all_baskets, p4_found, p4_order, p5_found, p5_neighbours, p5_recall, p7_found, p7_groups, p8_found, p8_windows, p9_found, p9_places, p9_kept, p10_found, p10_sentences)}
