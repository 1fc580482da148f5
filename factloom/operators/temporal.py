"""Histories as intervals, reads of them at many instants, and rules whose hops are read each at its own instant.

An interval is (subject, predicate, object, began, until): a value of a predicate of one holds until the next write of its
key, an element of a predicate of many until the next write of itself; ``valid_to`` may end it sooner. ``until`` is null
while it holds. Both kinds come from one window over the writes of a key, and what reads them doesn't tell them apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facts
from .graph import checkpointed

BUCKET = 30 * 86400


def histories(log: DataFrame, many: bool | Column = False) -> DataFrame:
    """The intervals of a log; those that end before they begin, as a later write of the same instant replaces them, go.
    ``many`` may tell of each row whether its predicate is one of many."""
    began = F.coalesce("valid_from", F.lit(0)).cast("long")
    keys = [*facts.KEYS, F.when(many, F.col("object"))] if isinstance(many, Column) else facts.ELEMENT if many else facts.KEYS
    w = Window.partitionBy(*keys).orderBy(began, "seq")
    rows = log.select("op", *facts.ELEMENT, began.alias("began"), F.least(F.lead(began).over(w), F.col("valid_to")).cast("long").alias("until"))
    return rows.where("op = 'assert' and (until is null or until > began)").drop("op")


def holds(at: Column) -> Column:
    """Whether an interval holds at an instant."""
    return (F.col("began") <= at) & (F.col("until").isNull() | (F.col("until") > at))


def at_instants(intervals: DataFrame, asks: DataFrame, width: int = BUCKET) -> DataFrame:
    """(subject, at, object) of the intervals (subject, object, began, until) that hold at asks (subject, at).

    Asks of one subject and instant are one. Time is cut into buckets of ``width``: an interval goes to those of its
    subject's buckets that are asked for and that it touches, so that asks meet, by an equality, the few intervals of their
    bucket; a subject with very many asks is as many keys as it has buckets.
    """
    c = F.col
    asked = asks.where("at is not null").select("subject", "at", F.floor(c("at") / width).alias("bucket")).distinct()
    buckets = asked.select("subject", "bucket").distinct()
    touched = (c("began") < (c("bucket") + 1) * width) & (c("until").isNull() | (c("until") > c("bucket") * width))
    spans = intervals.select("subject", "object", "began", "until").join(buckets, "subject").where(touched)
    return asked.join(spans, ["subject", "bucket"]).where(holds(c("at"))).select("subject", "at", "object").distinct()


@dataclass(frozen=True)
class Step:
    """A hop to the values of ``predicate``: current ones, or those at the instant that the subject's ``as_of`` names."""

    predicate: str
    as_of: str | None = None
    many: bool = False


@dataclass(frozen=True)
class Rule:
    """Which value ``actual`` must have: one of those that ``required`` leads to. ``scope`` and ``absent_when`` are a
    predicate of the subject and what it must equal."""

    name: str
    required: tuple[Step, ...]
    actual: str
    scope: tuple[str, str] | None = None
    absent_when: tuple[str, str] | None = None


def conformance(log: DataFrame, rule: Rule, subjects: DataFrame) -> DataFrame:
    """(rule, id, verdict, why, required, actual, as_of) of each of ``subjects`` (id).

    Out of scope, or with no required value to be found (a hop leads nowhere, or the subject lacks the instant of one), it
    is NOT_APPLICABLE. Without an actual value it is ABSENT if ``absent_when`` holds and else NOT_APPLICABLE. It is OK if
    the actual value is one of the required ones. Else it is a MISMATCH: ``stale`` if the actual value was what the last
    hop led to before the instant of that hop (at any time, if it has none), else ``wrong``. ``required`` is the least of
    several, ``as_of`` the instant of the last hop that has one.

    What is said of the subjects themselves is one aggregate. Each hop is a join of the distinct frontier, at instants
    over the distinct pairs of node and instant.
    """
    c = F.col
    instants = list(dict.fromkeys(s.as_of for s in rule.required if s.as_of))
    about = list(dict.fromkeys([rule.actual, *instants, *(x[0] for x in (rule.scope, rule.absent_when) if x)]))
    said = facts.current(facts.guarded_head(log.where(c("predicate").isin(about))))
    wide = said.groupBy(c("subject").alias("id")).agg(*[F.max(F.when(c("predicate") == p, c("object"))).alias(f"p{k}") for k, p in enumerate(about)])
    value = lambda p: c(f"p{about.index(p)}")
    equal = lambda pair, default: F.coalesce(value(pair[0]) == pair[1], F.lit(False)) if pair else F.lit(default)
    last = next((s.as_of for s in reversed(rule.required) if s.as_of), None)
    base = subjects.select("id").distinct().join(wide, "id", "left")
    base = base.select("id", equal(rule.scope, True).alias("in_scope"), value(rule.actual).alias("actual"), equal(rule.absent_when, False).alias("absent"), (value(last).try_cast("long") if last else F.lit(None).cast("long")).alias("as_of"), *[value(p).try_cast("long").alias(f"t{k}") for k, p in enumerate(instants)])

    frontier = base.where("in_scope").select("id", F.col("id").alias("node"), *[f"t{k}" for k in range(len(instants))])
    for step in rule.required:
        before, some = frontier.drop("value"), log.where(c("predicate") == step.predicate)
        if step.as_of is None:
            found = facts.current(facts.guarded_head(some, facts.ELEMENT if step.many else facts.KEYS)).where(c("valid_to").isNull()).select(c("subject").alias("node"), c("object").alias("next"))
            met = before.join(found, "node")
        else:
            at = c(f"t{instants.index(step.as_of)}")
            found = at_instants(histories(some, step.many), before.select(c("node").alias("subject"), at.alias("at"))).select(c("subject").alias("node"), c("at").alias("__at"), c("object").alias("next"))
            met = before.join(found, (before["node"] == found["node"]) & (at == c("__at"))).drop("__at").drop(found["node"])
        frontier = met.select("id", c("next").try_cast("long").alias("node"), c("next").alias("value"), *[f"t{k}" for k in range(len(instants))]).distinct()

    required = frontier.select("id", "value").join(base.select("id", "actual"), "id").groupBy("id").agg(F.min("value").alias("required"), F.max(F.coalesce(c("value") == c("actual"), F.lit(False))).alias("fits"))
    step = rule.required[-1]
    held = histories(log.where(c("predicate") == step.predicate), step.many).groupBy(c("subject").alias("node"), c("object").alias("actual")).agg(F.min("began").alias("first"))
    moment = c(f"t{instants.index(step.as_of)}") if step.as_of else F.lit(None).cast("long")
    earlier = before.select("id", "node", moment.alias("moment")).join(base.select("id", "actual").where("actual is not null"), "id").join(held, ["node", "actual"]).where("moment is null or first < moment").select("id", F.lit(True).alias("earlier")).distinct()

    rows = base.join(required, "id", "left").join(earlier, "id", "left")
    missing = F.when(c("absent"), "ABSENT").otherwise("NOT_APPLICABLE")
    verdict = F.when(~c("in_scope") | c("required").isNull(), "NOT_APPLICABLE").when(c("actual").isNull(), missing).when(c("fits"), "OK").otherwise("MISMATCH")
    why = F.when(verdict == "MISMATCH", F.when(c("earlier"), "stale").otherwise("wrong"))
    return rows.select(F.lit(rule.name).alias("rule"), "id", verdict.alias("verdict"), why.alias("why"), c("required").try_cast("long").alias("required"), c("actual").try_cast("long").alias("actual"), F.when(c("in_scope"), c("as_of")).alias("as_of"))


MONTHS, COVERAGE = 36, 0.8
BITS = 60


def _spans(intervals: DataFrame, of: DataFrame, own: DataFrame) -> DataFrame:
    """(pattern_id, id, object, hit, low, high): each interval that holds at any month of a candidate of which its event is one,
    as the places in the candidate's ``months`` that it holds at, from ``low`` up to, without, ``high``.

    ``own`` is (pattern_id, predicate, months, targets), its months in order; ``of`` (id, pattern_id). A row costs two counts of
    months, not a row for each month.
    """
    c = F.col
    rows = intervals.withColumnRenamed("subject", "id").join(of, "id").join(own, ["pattern_id", "predicate"])
    before = lambda at: F.size(F.filter("months", lambda m: m < at))
    rows = rows.select("pattern_id", "id", "object", F.array_contains("targets", c("object")).alias("hit"), before(c("began")).alias("low"), F.when(c("until").isNull(), F.size("months")).otherwise(before(c("until"))).alias("high"))
    return rows.where("low < high")


def _counts(spans: DataFrame) -> DataFrame:
    """(pattern_id, place, population, covered): events with any span at a place, and those with one that is a hit.

    An event's spans are united as bits of words, ``BITS`` places each; events with the same words are counted before words
    are read bit by bit.
    """
    c = F.col
    words = spans.withColumn("word", F.explode(F.sequence(F.expr(f"low div {BITS}"), F.expr(f"(high - 1) div {BITS}"))))
    start = c("word") * BITS
    bits = F.expr(f"shiftleft(1L, cast(least(high - word * {BITS}, {BITS}) as int)) - shiftleft(1L, cast(greatest(low - word * {BITS}, 0) as int))")
    each = words.select("id", "pattern_id", "word", bits.alias("bits"), "hit").groupBy("id", "pattern_id", "word").agg(F.bit_or("bits").alias("any"), F.bit_or(F.when(c("hit"), c("bits")).otherwise(F.lit(0).cast("long"))).alias("hits"))
    same = each.groupBy("pattern_id", "word", "any", "hits").agg(F.count(F.lit(1)).alias("n"))
    placed = same.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))).where("getbit(any, bit) = 1")
    return placed.groupBy("pattern_id", (start + c("bit")).cast("int").alias("place")).agg(F.sum("n").alias("population"), F.sum(F.when(F.getbit("hits", "bit") == 1, c("n")).otherwise(0)).alias("covered"))


def _most(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """(pattern_id, place, most): the object on most events at each place of ``asked`` (pattern_id, places, in order), of equals
    the least. An object's spans in an event don't overlap, so that it is on as many as spans begin up to a place, less those
    that end up to it: a span is two changes, and changes are summed before they are read place by place."""
    c = F.col
    until = lambda at: F.size(F.filter("places", lambda p: p < at))
    rows = spans.select("pattern_id", "object", "low", "high").join(asked, "pattern_id").select("pattern_id", "object", until(c("low")).alias("low"), until(c("high")).alias("high"), F.size("places").alias("all")).where("low < high")
    change = lambda at, n: F.struct(c(at).alias("at"), F.lit(n).cast("long").alias("n"))
    changes = rows.select("pattern_id", "object", "all", F.inline(F.when(c("high") < c("all"), F.array(change("low", 1), change("high", -1))).otherwise(F.array(change("low", 1)))))
    summed = changes.groupBy("pattern_id", "object", "at").agg(F.sum("n").alias("n"), F.first("all").alias("all"))
    w = Window.partitionBy("pattern_id", "object").orderBy("at")
    runs = summed.select("pattern_id", "object", "at", F.sum("n").over(w).alias("n"), F.coalesce(F.lead("at").over(w), "all").alias("end")).where("n > 0")
    each = runs.select("pattern_id", "object", "n", F.explode(F.sequence(c("at"), c("end") - 1)).alias("k"))
    best = each.groupBy("pattern_id", "k").agg(F.max(F.struct("n", -c("object"))).alias("m"))
    return best.join(asked, "pattern_id").select("pattern_id", F.get("places", "k").alias("place"), (-c("m.col2")).alias("most"))


def traces(log: DataFrame, events: DataFrame, candidates: DataFrame, months_of: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(pattern_id, at, population, covered, held, top, measured, months_held) of every candidate and month.

    ``events`` are (template, group, id), ``candidates`` (pattern_id, template, group, predicate, first, second),
    ``months_of`` (pattern_id, months). An event counts at a month if it has any target then, and is covered if one of them
    is of the candidate's; events without a target then shrink the population. ``top`` is the most frequent target of a
    month that doesn't hold, of equals the least. ``measured`` counts the candidate's months with a population,
    ``months_held`` those of them that hold. Candidates of who has nearly every document are of all documents.

    All events of all candidates are read in one plan: what is said of an event, its history and its candidates meet by its
    id, and no interval becomes a row for each month. Targets are counted only for months that don't hold.
    """
    c = F.col
    own = candidates.select("pattern_id", "template", "group", "predicate", F.array_compact(F.array("first", "second")).alias("targets")).join(months_of.select("pattern_id", F.array_sort(F.array_distinct("months")).alias("months")), "pattern_id")
    wide = own.where("template = 'doc-access-scope'").select("pattern_id").withColumn("template", F.lit("doc-access"))
    of = events.select("template", "group", "id").join(own.where("template != 'doc-access-scope'").select("template", "group", "pattern_id"), ["template", "group"]).select("id", "pattern_id")
    of = of.unionByName(events.select("template", "id").join(wide, "template").select("id", "pattern_id")).repartition("id").distinct()
    said = log.where(c("predicate").isin("assigned-to", "commented-by", "can-access")).repartition("subject")  # of an event at once: for its history, its candidates, its words
    every = histories(said, c("predicate") == "can-access").withColumn("object", c("object").cast("long"))
    spans = checkpointed(_spans(every, of, own.select("pattern_id", "predicate", "months", "targets")))  # read twice, an event's next to each other
    points = own.select("pattern_id", F.posexplode("months").alias("place", "at"))
    held = F.coalesce(c("covered") / c("population") >= coverage, F.lit(False))
    counts = checkpointed(points.join(_counts(spans), ["pattern_id", "place"], "left").withColumn("held", held))
    most = _most(spans, counts.where("not held and population > 0").groupBy("pattern_id").agg(F.array_sort(F.collect_list("place")).alias("places")))
    rows = counts.join(most, ["pattern_id", "place"], "left").select("pattern_id", "at", F.coalesce("population", F.lit(0)).alias("population"), F.coalesce("covered", F.lit(0)).alias("covered"), "held", c("most").alias("top"))
    totals = Window.partitionBy("pattern_id")  # a row for each of a candidate's months
    return rows.withColumn("measured", F.count_if(c("population") > 0).over(totals)).withColumn("months_held", F.count_if("held").over(totals))
