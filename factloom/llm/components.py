"""Connected components of links, for operators that only need which rows belong together.

Large stars and small stars by turns, each an aggregate and a join on the node that the star is around. A node with a
great share of all edges is dealt to several tasks (``salted_lookup``), so a hub is no one task's work. Rounds end when
the edges, as an order-free sum of their hashes, are those of the round before. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, salted_lookup, stored


def _print(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(b, m) of rows (a, b) with what ``least`` (a, m, n) says of a; n is the number of rows that have it."""
    return salted_lookup(rows, least.select("a", "m"), "a", least.select("a", "n"), total, ["b"])


def components(links: DataFrame) -> DataFrame:
    """(digest, label) of all ends of ``links`` (a, b): label is the least end of the connected component. Links of an end
    to itself are left out; null ends don't link."""
    spark = links.sparkSession
    edges, path = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    seen = _print(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _star(both.where("b > a"), least, 2 * seen[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, middle = stored(large, "edges")
        lows = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _star(large, lows, seen[0]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select("a", F.col("m").alias("b"))).distinct()
        edges, after = stored(small, "edges")
        forget(spark, path, middle)
        path, now = after, _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("digest"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("digest"), F.col("b").alias("label")).distinct())
