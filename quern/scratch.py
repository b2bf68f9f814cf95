"""Cutting lineage: tables in the folder that the cluster shares.

Iterative operators and operators that read an intermediate result twice write it
once and read it back. The folder is the session's ``spark.checkpoint.dir``; only
where that is unset (tests, a laptop) does the engine set one of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[int, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@atexit.register
def _clean() -> None:
    """Remove what this process left in the shared folder, where Spark still runs."""
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the JVM has gone; the folder's owner cleans up
            return


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as a URI."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    key = id(spark.sparkContext)
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _OWN[key], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN[key])
    return "file://" + _OWN[key]


def new_path(spark: SparkSession, label: str) -> str:
    root = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    _MADE.append((spark, root))
    return f"{root}/{label}"


def cut(df: DataFrame, label: str = "cut", path: str | None = None) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table.

    Columns are stored by position, so names that differ only in case, or occur
    twice, survive. The shuffle files of the write go with its end, not whenever the
    driver collects its garbage.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        plain.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    back = spark.read.schema(plain.schema).parquet(path).toDF(*names)
    back._quern_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete tables written by :func:`cut` that no plan needs any more."""
    for df in frames:
        path = getattr(df, "_quern_path", None)
        if path is not None:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fits_broadcast(df: DataFrame, row_bytes: int, limit: int) -> bool:
    """Whether a counted table stays under ``limit`` bytes at ``row_bytes`` a row.

    One cheap count job; callers take a shuffle join where this is false.
    """
    return df.limit(limit // row_bytes + 1).count() * row_bytes <= limit
