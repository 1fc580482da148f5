"""The shared model as tables: declarations, conflicts, additions, bindings; lanes, runs and review records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import BANDS, hash48

RUNS_KEPT = 50


def declarations(predicates: DataFrame, types: DataFrame) -> DataFrame:
    """(name, domain, range, kind, cardinality): an entity range where the target is a known type, else a text value."""
    known = types.select(F.col("name").alias("__t")).distinct()
    joined = predicates.join(known, F.col("to") == F.col("__t"), "left")
    entity = F.col("__t").isNotNull()
    return joined.select("name", F.col("from").alias("domain"), F.when(entity, F.col("to")).otherwise("text").alias("range"), F.when(entity, "entity").otherwise("value").alias("kind"), "cardinality")


def conflicts(layer: DataFrame, proposed: DataFrame) -> DataFrame:
    """(name, message) of proposed declarations that redefine one of the layer."""
    a, b = layer.alias("a"), proposed.alias("b")
    parts = [F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), F.concat(F.lit(f"{c} "), F.col(f"a.{c}"), F.lit(" is not "), F.col(f"b.{c}"))) for c in ("cardinality", "domain", "range")]
    return a.join(b, F.col("a.name") == F.col("b.name")).select(F.col("a.name").alias("name"), F.concat_ws("; ", *parts).alias("message")).where("message != ''")


def additions(layer: DataFrame, proposed: DataFrame) -> DataFrame:
    """What the layer lacks, each name once."""
    return proposed.join(layer.select("name"), "name", "left_anti").dropDuplicates(["name"])


def appended(layer: DataFrame, proposed: DataFrame) -> DataFrame:
    return layer.unionByName(additions(layer, proposed))


def bindings(predicates: DataFrame) -> DataFrame:
    return predicates.select("name", "source")


def composed(layer: DataFrame, bound: DataFrame) -> DataFrame:
    """Bindings with their declarations; an undeclared one is an error when the rows are read."""
    joined = bound.join(layer.withColumn("__declared", F.lit(True)), "name", "left")
    declared = F.when(F.col("__declared"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("undeclared: "), F.col("name"))))
    return joined.withColumn("name", declared).drop("__declared")


def seeded(declared: DataFrame) -> DataFrame:
    """A first layer of static declarations (name, ord, ...): the first of each name."""
    rest = [c for c in declared.columns if c != "name"]
    return declared.groupBy("name").agg(F.min_by(F.struct(*rest), "ord").alias("d")).select("name", "d.*")


def floors(predicates: DataFrame, edits: DataFrame) -> DataFrame:
    """(name, floor) of predicates (name, floor) after human edits (name, floor, at): the last one sets 1 to 255, null or
    0 clears; others are no edits."""
    fine = edits.where("floor is null or floor between 0 and 255")
    last = fine.groupBy("name").agg(F.max_by(F.struct("floor"), "at").alias("e"))
    joined = predicates.join(last, "name", "left")
    return joined.select("name", F.nullif(F.when(F.col("e").isNotNull(), F.col("e.floor")).otherwise(F.col("floor")), F.lit(0)).alias("floor"))


def corrections(proposed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(name, change) of what a reviewer changed: added, removed, or the fields that differ."""
    p, c = proposed.alias("p"), confirmed.alias("c")
    fields = [F.when(~F.col(f"p.{x}").eqNullSafe(F.col(f"c.{x}")), F.lit(x)) for x in ("source", "from", "to", "cardinality")]
    change = F.when(F.col("p.name").isNull(), "added").when(F.col("c.name").isNull(), "removed").otherwise(F.concat_ws(",", *fields))
    return p.join(c, F.col("p.name") == F.col("c.name"), "full_outer").select(F.coalesce("p.name", "c.name").alias("name"), change.alias("change")).where("change != ''")


def lanes(defined: DataFrame, runs: DataFrame) -> DataFrame:
    """(lane, facts, observed, suppressed): totals of defined lanes (lane, ingested) and of their runs (lane, run_no,
    facts, events, suppressed). ``observed`` is null without runs; ``suppressed`` is the latest run's, null if it is."""
    some = runs.groupBy("lane").agg(F.sum("facts").alias("run_facts"), F.sum("events").alias("observed"), F.max_by(F.struct("suppressed"), "run_no").alias("last"))
    out = defined.join(some, "lane", "full_outer")
    return out.select("lane", (F.coalesce("ingested", F.lit(0)) + F.coalesce("run_facts", F.lit(0))).cast("long").alias("facts"), F.col("observed").cast("long").alias("observed"), F.col("last.suppressed").cast("long").alias("suppressed"))


def recent_runs(runs: DataFrame, kept: int = RUNS_KEPT) -> DataFrame:
    return runs.withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("run_no")))).where(F.col("r") <= kept).drop("r")


KEY, NAME, LINE = 200, 120, 500  # fixed values: how much of a key, a name and a line is kept


def review_records(decisions: DataFrame) -> DataFrame:
    """``decisions`` (surface, key, decision, proposal, evidence, reviewer, note, at) with an id for each instance.

    The id is of surface, key, instant and reviewer, so another review of the same is another record.
    """
    name = F.concat_ws("|", "surface", F.left("key", F.lit(KEY)), F.col("at").cast("string"), F.left(F.coalesce("reviewer", F.lit("")), F.lit(NAME)))
    cut = {"decision": NAME, "proposal": LINE, "evidence": LINE, "reviewer": NAME, "note": LINE}
    return decisions.select((hash48(name) + BANDS["review"]).alias("id"), "surface", "key", *[F.left(c, F.lit(n)).alias(c) for c, n in cut.items()], "at")


def review_facts(records: DataFrame, pointers: DataFrame) -> DataFrame:
    """(subject, predicate, object, valid_from) of review records and of (id, kind, node) that they are about; fields
    that are null or empty but for surface, decision and proposal are none."""
    fields = F.array(*[F.struct(F.lit(f"review-{c}").alias("predicate"), F.col(c).alias("object"), F.lit(c in ("surface", "decision", "proposal")).alias("needed")) for c in ("surface", "decision", "proposal", "evidence", "reviewer", "note")])
    said = records.select(F.col("id").alias("subject"), F.col("at").alias("valid_from"), F.explode(fields).alias("f")).where("f.object is not null and (f.needed or f.object != '')")
    about = pointers.join(records.select("id", "at"), "id").select(F.col("id").alias("subject"), F.concat(F.lit("review-of-"), "kind").alias("predicate"), F.col("node").cast("string").alias("object"), F.col("at").alias("valid_from"))
    return said.select("subject", "f.predicate", "f.object", "valid_from").unionByName(about)
