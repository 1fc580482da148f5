"""Regularities in groups of events (group, id, targets array<long>, at): mining, ubiquity, months of a window.

Events are in the order of their ids. All counts are over all events, without a budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The smallest group, coverage that makes a pattern, reach that makes a target ubiquitous, listed exceptions, months.
MIN_GROUP, COVERAGE, UBIQUITY, EXCEPTIONS, MONTHS = 10, 0.8, 0.9, 20, 36


def _best(events: DataFrame) -> DataFrame:
    """The target on most events of each group, of equals the smallest."""
    counts = events.select("group", F.explode(F.array_distinct("targets")).alias("t")).groupBy("group", "t").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group").agg(F.max(F.struct("n", -F.col("t"))).alias("m")).select("group", (-F.col("m.col2")).alias("t"), F.col("m.n").alias("gain"))


def _exceptions(rows: DataFrame, cap: int, parts: int = 64) -> DataFrame:
    """(group, missed, exceptions): how many rows (group, id) there are, and the first ``cap`` ids. The first of each of
    ``parts`` shares of a group are found by themselves, then the first of those."""
    counts = rows.groupBy("group").agg(F.count(F.lit(1)).alias("missed"))
    dealt = rows.select("group", "id", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    first = dealt.withColumn("r", F.row_number().over(Window.partitionBy("group", "part").orderBy("id"))).where(F.col("r") <= cap)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("id"))).where(F.col("r") <= cap)
    listed = first.groupBy("group").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("exceptions"))
    return counts.join(listed, "group")


def mine(events: DataFrame, coverage: float = COVERAGE, min_group: int = MIN_GROUP, cap: int = EXCEPTIONS) -> DataFrame:
    """Groups that one target, or two, cover: group, first, second (or null), support, total, exceptions, omitted, window."""
    sizes = events.groupBy("group").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.min(F.when(F.col("at") > 0, F.col("at"))), F.lit(0)).alias("window_from"), F.coalesce(F.max(F.when(F.col("at") > 0, F.col("at"))), F.lit(0)).alias("window_to")).where(F.col("total") >= min_group)
    one = _best(events).select("group", F.col("t").alias("first"), F.col("gain").alias("gain1")).join(sizes, "group")
    one = one.withColumn("alone", F.col("gain1") / F.col("total") >= coverage)
    left = events.join(one.where("not alone").select("group", "first"), "group").where(~F.array_contains("targets", F.col("first")))
    two = _best(left.select("group", "targets")).select("group", F.col("t").alias("second"), F.col("gain").alias("gain2"))
    found = one.join(two, "group", "left").withColumn("support", F.col("gain1") + F.coalesce("gain2", F.lit(0))).where(F.col("support") / F.col("total") >= coverage)
    missed = events.join(found.select("group", "first", "second"), "group").where(~F.array_contains("targets", F.col("first")) & (F.col("second").isNull() | ~F.array_contains("targets", F.col("second"))))
    out = found.join(_exceptions(missed.select("group", "id"), cap), "group", "left")
    return out.select("group", "first", "second", "support", "total", F.coalesce("exceptions", F.lit("")).alias("exceptions"), F.greatest(F.coalesce("missed", F.lit(0)) - cap, F.lit(0)).alias("omitted"), "window_from", "window_to")


def ubiquitous(events: DataFrame, share: float = UBIQUITY, min_events: int = MIN_GROUP) -> DataFrame:
    """(target, support, total) of targets on so great a share of all events."""
    total = events.agg(F.count(F.lit(1)).alias("total"))
    reach = events.select(F.explode(F.array_distinct("targets")).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("support"))
    return reach.join(F.broadcast(total)).where((F.col("total") >= min_events) & (F.col("support") / F.col("total") >= share))


def scope_patterns(events: DataFrame, demoted: DataFrame, cap: int = EXCEPTIONS) -> DataFrame:
    """``ubiquitous`` targets with the events that lack them: target, support, total, exceptions, omitted, window."""
    at = F.when(F.col("at") > 0, F.col("at"))
    window = events.agg(F.coalesce(F.min(at), F.lit(0)).alias("window_from"), F.coalesce(F.max(at), F.lit(0)).alias("window_to"))
    every = demoted.agg(F.collect_set("target").alias("__all"))  # at most 1 / share targets an event's list is long
    lacking = events.join(F.broadcast(every)).select("id", F.explode(F.array_except("__all", "targets")).alias("group"))
    missed = _exceptions(lacking, cap).withColumnRenamed("group", "target")
    out = demoted.join(missed, "target", "left").join(F.broadcast(window))
    return out.select("target", "support", "total", F.coalesce("exceptions", F.lit("")).alias("exceptions"), F.greatest(F.coalesce("missed", F.lit(0)) - cap, F.lit(0)).alias("omitted"), "window_from", "window_to")


def stripped(events: DataFrame, demoted: DataFrame) -> DataFrame:
    """Events without demoted targets; the events themselves stay."""
    drop = demoted.agg(F.collect_set("target").alias("__drop"))  # at most 1 / share targets an event's list is long
    return events.join(F.broadcast(drop)).withColumn("targets", F.filter("targets", lambda t: ~F.array_contains("__drop", t))).drop("__drop")


def month_starts(start, end, cap: int = MONTHS):
    """Instants of the first days of months in [start, end], the last ``cap`` of them."""
    first = F.date_trunc("month", F.timestamp_seconds(start))
    every = F.transform(F.sequence(first, F.greatest(F.timestamp_seconds(end), first), F.expr("interval 1 month")), lambda m: F.unix_seconds(m))
    inside = F.filter(every, lambda m: (m >= start) & (m <= end))
    inside = F.when((start <= 0) | (end < start), F.slice(inside, 1, 0)).otherwise(inside)
    return F.slice(inside, F.greatest(F.size(inside) - cap + 1, F.lit(1)), F.lit(cap))
