"""Windows and additive statistics over event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str | None = None, value: str = "rating") -> DataFrame:
    """Counts and sums per window and key; tumbling without ``slide``. Works on streams and tables alike."""
    rows = events.withWatermark(ts, late) if late else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return _flat(rows.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")), "w", keys)


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None, value: str = "rating") -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    return _flat(rows.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")), "w", keys)


def _flat(df: DataFrame, window: str, keys: list[str]) -> DataFrame:
    at: Column = F.col(window)
    return df.select(at["start"].alias("window_start"), at["end"].alias("window_end"), *keys, "n", "total")


def keep_counts(stream: DataFrame, keys: list[str], path: str, checkpoint: str, available_now: bool = True):
    """A query that adds each micro-batch's counts to the table at ``path`` as one increment.

    Increments are named by batch, so a batch that runs again replaces its own and counts
    once; readers sum them with :func:`read_counts`.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_counts(spark, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))
