"""A snapshot, then changes: one stream over a walk of all there is and the feed of what happens meanwhile and later.

The token of the feed is taken before the walk begins, and kept; a change during the walk is then in the feed for sure, and
perhaps in the walk as well. Both are read by one query with one checkpoint, so that each row of either goes into the log
once, also if a run ends midway. Rows carry the number of their change; those of the walk come before all changes. The
latest row of each thing is its state, whichever of the two it is from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def start_token(spark: SparkSession, folder: str, take: Callable[[], str]) -> str:
    """The token that changes are read from: taken once, before the first walk, and kept in ``folder``."""
    path = f"{folder}/token"
    if not _exists(spark, f"{path}/_SUCCESS"):
        spark.createDataFrame([(take(),)], "token string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["token"]


def snapshot_then(spark: SparkSession, folder: str, walk: Callable[[], DataFrame], changes: DataFrame) -> DataFrame:
    """A stream of the rows of ``walk``, made once and kept in ``folder``, and of ``changes`` (the same columns). A walk that
    doesn't come to its end is begun again; ``start_token`` must have been called before."""
    path = f"{folder}/snapshot"
    if not _exists(spark, f"{folder}/token/_SUCCESS"):
        raise ValueError("the token of the feed is taken before the walk")
    if not _exists(spark, f"{path}/_SUCCESS"):
        walk().select(*changes.columns).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(changes.schema).parquet(path).unionByName(changes)


def latest(rows: DataFrame, key: str, order: str = "event") -> DataFrame:
    """The row of each ``key`` with the greatest ``order``: rows that came twice are one state."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(key, "r.*")
