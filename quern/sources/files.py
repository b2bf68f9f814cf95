"""CSV, JDBC, JSON key-value tables, cached results."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text under an explicit schema; separators may be several characters."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query run by the database; partitioning options make the read parallel."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], key: str, read: bool = True, save: bool = True, valid_days: float | None = None) -> DataFrame:
    """The saved result for ``key`` if there is a valid one, else the result of ``make``, saved."""
    at = f"{path}/{hashlib.md5(key.encode()).hexdigest()}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if read and fs.exists(where):
        age = time.time() - fs.getFileStatus(where).getModificationTime() / 1000
        if valid_days is None or age <= valid_days * 86_400:
            return spark.read.parquet(at)
    df = make()
    if not save:
        return df
    df.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_kv(df: DataFrame, path: str, table: str, key: str) -> None:
    """Rows as JSON values under 'table:key:value' names, in hashed buckets for point reads."""
    name = F.concat_ws(":", F.lit(table), F.lit(key), F.col(key).cast("string"))
    rows = df.select(name.alias("name"), F.to_json(F.struct(*df.columns)).alias("value"))
    rows.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(64))).write.mode("append").partitionBy("bucket").parquet(path)


def read_kv(spark: SparkSession, path: str, names: list[str], schema: str) -> DataFrame:
    """(name, columns ..) of the names that exist; only their buckets are read."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string").withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(64)))
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]
    found = spark.read.parquet(path).filter(F.col("bucket").isin(buckets) & F.col("name").isin(names))
    return found.select("name", F.from_json("value", schema).alias("v")).select("name", "v.*")


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A fitted model as its tables."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
