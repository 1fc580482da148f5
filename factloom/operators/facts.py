"""Reads of the fact log: (seq, op, subject, predicate, object, props, valid_from, valid_to, source).

``op`` is ``assert``, ``close`` or ``retract``; ``seq`` is the order of writes. A retract takes an element out with all
that was written of it before: reads of a log that holds any go over ``live``, which is a join that others needn't pay for. The raw head is the last write; the
guarded head and as-of reads go by (valid_from, seq), so that a late arrival doesn't displace a newer value. A value
holds from valid_from up to, without, valid_to; an unset valid_from is 0. Every read is one aggregate with partial
sums, or one window for histories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["subject", "predicate"]
ELEMENT = [*KEYS, "object"]


def _from() -> Column:
    return F.coalesce("valid_from", F.lit(0)).cast("long")


def live(facts: DataFrame) -> DataFrame:
    """Without retracted elements and what was written of them before; closes that name no element stay."""
    gone = facts.where("op = 'retract'").groupBy(*ELEMENT).agg(F.max("seq").alias("__gone"))
    return facts.where("op != 'retract'").join(gone, ELEMENT, "left").where("__gone is null or seq > __gone").drop("__gone")


def winners(facts: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The fact with the greatest ``order`` of each key."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("w")).select(*keys, "w.*")


def raw_head(facts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """What was written last of each key, closed values included."""
    return winners(facts, keys, F.col("seq"))


def guarded_head(facts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return winners(facts, keys, F.struct(_from(), "seq"))


def current(head: DataFrame) -> DataFrame:
    """A head without closed values."""
    return head.where("op = 'assert'")


def point(facts: DataFrame) -> DataFrame:
    """(subject, predicate, object, valid_from, source, closed_from): one has a value or the instant of its close."""
    open_ = F.col("op") == "assert"
    return raw_head(facts).select(*KEYS, F.when(open_, F.col("object")).alias("object"), F.when(open_, F.col("valid_from")).alias("valid_from"), F.when(open_, F.col("source")).alias("source"), F.when(~open_, F.col("valid_from")).alias("closed_from"))


def as_of(facts: DataFrame, at: int | None, keys: list[str] = KEYS) -> DataFrame:
    """The value in effect at an instant; with the keys of an element, the set of them. Nothing is in effect at none."""
    won = winners(facts.where(_from() <= F.lit(at)), keys, F.struct(_from(), "seq"))
    return won.where((F.col("op") == "assert") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(at))))


def as_of_each(facts: DataFrame, instants: DataFrame) -> DataFrame:
    """For each row of ``instants`` (subject, predicate, at) the object in effect: union and last value, one shuffle."""
    known = facts.select(*KEYS, _from().alias("at"), F.lit(0).alias("asks"), "seq", F.struct("object", "op", "valid_to").alias("v"))
    asks = instants.select(*KEYS, "at", F.lit(1).alias("asks"), F.lit(None).cast(facts.schema["seq"].dataType).alias("seq"), F.lit(None).cast(known.schema["v"].dataType).alias("v"))
    w = Window.partitionBy(*KEYS).orderBy("at", "asks", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = known.unionByName(asks).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("asks = 1")
    holds = (F.col("v.op") == "assert") & (F.col("v.valid_to").isNull() | (F.col("v.valid_to") > F.col("at")))
    return rows.select(*KEYS, "at", F.when(holds, F.col("v.object")).alias("object"))


def intervals(facts: DataFrame) -> DataFrame:
    """Each value with the instant at which the next one takes over."""
    w = Window.partitionBy(*KEYS).orderBy(_from(), "seq")
    return facts.withColumn("until", F.lead(_from()).over(w)).where("op = 'assert'").select(*KEYS, "object", _from().alias("valid_from"), F.least("until", "valid_to").alias("until"))


def expand(facts: DataFrame, predicate: str, symmetric: bool = False) -> DataFrame:
    """(subject, object): current elements of a predicate, both ways if it is symmetric: those whose last write asserts them."""
    last = facts.where(F.col("predicate") == predicate).groupBy(*ELEMENT).agg(F.max("seq").alias("last"), F.max(F.when(F.col("op") == "assert", F.col("seq"))).alias("said"))
    edges = last.where("said = last").select("subject", "object")
    return edges.union(edges.select(F.col("object").alias("subject"), F.col("subject").alias("object"))).distinct() if symmetric else edges


def edge_props(facts: DataFrame) -> DataFrame:
    """(subject, predicate, object, key, value) of current elements; properties without a value are none."""
    head = current(raw_head(facts, ELEMENT))
    return head.select(*ELEMENT, F.explode("props").alias("key", "value")).where("value is not null")


def named_nodes(nodes: DataFrame, facts: DataFrame, display: str = "name") -> DataFrame:
    """Nodes with what their display predicate says, else null."""
    names = current(raw_head(facts.where(F.col("predicate") == display))).select(F.col("subject").alias("id"), F.col("object").alias("name"))
    return nodes.join(names, "id", "left")


def overview(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def stats(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: nodes, edges (current elements), changes (length of the log)."""
    edges = current(raw_head(facts, ELEMENT)).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(edges).join(facts.agg(F.count(F.lit(1)).alias("changes")))


def suppressed(batch: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What of a batch changes the current state, and what merely repeats it."""
    head = current(raw_head(facts, ELEMENT)).select(*ELEMENT, "valid_from", "valid_to")
    same = [*ELEMENT, "valid_from", "valid_to"]
    match = None
    for c in same:
        term = F.col(f"b.{c}").eqNullSafe(F.col(f"h.{c}"))
        match = term if match is None else match & term
    match = match & (F.col("b.op") == "assert")
    b, h = batch.alias("b"), head.alias("h")
    return b.join(h, match, "left_anti"), b.join(h, match, "left_semi")


def stamped(batch: DataFrame, source: str) -> DataFrame:
    return batch.withColumn("source", F.coalesce("source", F.lit(source)))


def ndjson(batch: DataFrame) -> DataFrame:
    """A JSON line for each item."""
    return batch.select(F.to_json(F.struct(*[F.col(c) for c in batch.columns])).alias("value"))


def content_store(texts: DataFrame, column: str = "text") -> DataFrame:
    """(digest, text), each text once."""
    return texts.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("digest"), F.col(column).alias("text")).dropDuplicates(["digest"])
