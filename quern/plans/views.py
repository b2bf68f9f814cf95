"""Canonical inputs on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.observations import observations
from quern.operators.places import usable_places
from quern.plans.tables import table

_ORDER = ("l_orderkey", "l_linenumber", "l_quantity")  # l_extendedprice and l_suppkey would only choose between rows of the same rating and ts


def obs(spark: SparkSession, d: str) -> DataFrame:
    """userid, itemid, rating, ts: the first order line of a customer and part."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return observations(both, "o_custkey", "l_partkey", "l_quantity", "o_orderdate", _ORDER)


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """userid, itemid, rating, ts (epoch seconds): the first real rating of every non-blank pair, the default account included."""
    real = F.col("rating").isNotNull() & ~F.isnan("rating") & (F.trim("userid") != "") & (F.trim("itemid") != "")
    return observations(table(spark, d, "readable_ratings").filter(real), "userid", "itemid", "rating", "first_timestamp")


def movies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "readable_movies")


def places(spark: SparkSession, d: str) -> DataFrame:
    """itemid, lat, long of the usable places, one row for every distinct one."""
    return usable_places(table(spark, d, "itemsgeomap"), "property_id").withColumnRenamed("id", "itemid")


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("itemid"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def vec(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "label")


def geo(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("itemid"), e[0].cast("double").alias("lat"), e[1].cast("double").alias("long"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("userid"), F.col("event_type").alias("itemid"), F.col("value").alias("rating"), "ts", "props")


OBS_SQL = """obs as (select userid, itemid, rating, ts from (
  select cast(o_custkey as varchar) userid, cast(l_partkey as varchar) itemid, cast(l_quantity as double) rating, o_orderdate ts,
    row_number() over (partition by o_custkey, l_partkey order by o_orderdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_suppkey) k
  from lineitem join orders on l_orderkey = o_orderkey) where k = 1)"""

RATINGS_SQL = """obs as (select userid, itemid, rating, ts from (
  select userid, itemid, rating, first_timestamp ts, row_number() over (partition by userid, itemid order by first_timestamp nulls last, rating) k
  from readable_ratings where trim(userid) <> '' and trim(itemid) <> '' and rating is not null and not isnan(rating)) where k = 1)"""

PLACES_SQL = """g as (select distinct property_id itemid, lat, long from itemsgeomap where property_id is not null and lat is not null and long is not null
  and not isnan(lat) and not isnan(long) and abs(lat) <= 90 and abs(long) <= 180 and not (lat = 0 and long = 0))"""
