"""Queries over places and regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.places import inside_pairs, near_counts, near_pairs
from quern.plans.tables import table

NEAR_M = 25.0
AROUND_M = 1000.0


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "itemsgeomap")
    near = near_pairs(places, "property_id", NEAR_M).select(F.lit("near").alias("relation"), F.col("id_a").alias("key_a"), F.col("id_b").alias("key_b"))
    inside = inside_pairs(places, "property_id", table(spark, d, "geo_regions")).select(F.lit("inside").alias("relation"), F.col("id").alias("key_a"), F.col("region").alias("key_b"))
    return near.unionByName(inside)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many other usable places lie within 1 km of each."""
    return near_counts(table(spark, d, "itemsgeomap"), "property_id", AROUND_M).withColumnRenamed("id", "property_id")


QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}

_PLACES = """places as (select distinct property_id, lat, long from itemsgeomap where property_id is not null and lat is not null and long is not null
  and not isnan(lat) and not isnan(long) and abs(lat) <= 90 and abs(long) <= 180 and not (lat = 0 and long = 0))"""
_DISTANCE = "2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.long - a.long) / 2), 2))))"

SQL = {
    "p6_found": f"""
with {_PLACES},
near as (select distinct 'near' relation, a.property_id key_a, b.property_id key_b from places a join places b on a.property_id < b.property_id and {_DISTANCE} <= {NEAR_M}),
step as (select region_id, vertex_no, lat y, long x0, long - lag(long) over w d from geo_regions window w as (partition by region_id order by vertex_no)),
turned as (select region_id, vertex_no, y, first_value(x0) over (partition by region_id order by vertex_no)
  + sum(case when d is null then 0 else ((d + 180) % 360 + 360) % 360 - 180 end) over (partition by region_id order by vertex_no) x from step),
edges as (select region_id, y y1, x x1, coalesce(lead(y) over w, first_value(y) over w) y2, coalesce(lead(x) over w, first_value(x) over w) x2, min(x) over (partition by region_id) lo
  from turned window w as (partition by region_id order by vertex_no)),
crossed as (select p.property_id, p.lat, p.long, e.region_id, count(*) filter ((y1 > p.lat) <> (y2 > p.lat)
  and lo + (((p.long - lo) % 360 + 360) % 360) < (x2 - x1) * (p.lat - y1) / nullif(y2 - y1, 0) + x1) n from places p, edges e group by all),
inside as (select distinct 'inside' relation, property_id key_a, region_id key_b from crossed where n % 2 = 1)
select * from near union all select * from inside""",
    "p6_counts": f"""
with {_PLACES}
select a.property_id, a.lat, a.long, count(*) - 1 as neighbours from places a join places b on {_DISTANCE} <= {AROUND_M} group by a.property_id, a.lat, a.long""",
}
