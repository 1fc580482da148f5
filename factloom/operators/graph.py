"""From tables to facts, and paths over facts."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import skip_level
from . import facts


@dataclass(frozen=True)
class Predicate:
    """``source`` is ``table.column`` for a foreign key or value, or a link table's name."""

    name: str
    source: str
    from_type: str
    to: str
    cardinality: str = "one"
    properties: tuple[str, ...] = ()
    valid_end: str | None = None


@dataclass(frozen=True)
class Hop:
    predicate: str
    reverse: bool = False


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is made only in local sessions that name none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Cuts lineage: the rows as a Parquet table in the shared folder, and its path, to ``forget`` when nothing reads it.

    Spark takes the size of such a table from its files. What ``checkpoint`` returns keeps the estimate of the plan that made
    it, in which a join multiplies the sizes of its sides: over rounds of joins, a number whose digits double each round.
    """
    path = f"{shared_folder(df.sparkSession)}/factloom/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Removes tables of ``stored``."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    return stored(df)[0]


def nodes_of(table: DataFrame, key: str, type_: str, base: int = 0, label: str | None = None) -> DataFrame:
    """(id, type, key, label): ids by the order of the key, from ``base``. Tables of a source get bases apart.

    Ids are numbered by ranges: a range's rows by themselves, plus the sizes of the ranges before it.
    """
    keyed = table.select(F.col(key).alias("key"), (F.col(label) if label else F.lit(None)).cast("int").alias("label")).where("key is not null")
    ranged = checkpointed(keyed.repartitionByRange("key").withColumn("part", F.spark_partition_id()))  # read twice, with the same ranges
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("n", number).join(F.broadcast(before), "part").select((F.col("n") + F.col("before") + base).cast("long").alias("id"), F.lit(type_).alias("type"), F.col("key").cast("string").alias("key"), "label")


def fk_facts(table: DataFrame, key: str, column: str, predicate: str, subjects: DataFrame, objects: DataFrame | None, props: tuple[str, ...] = (), valid_end: str | None = None) -> DataFrame:
    """A fact for each row whose subject and object resolve; without ``objects`` the value itself, bare."""
    rows = table.where(F.col(key).isNotNull() & F.col(column).isNotNull())
    s = subjects.select(F.col("id").alias("subject"), F.col("key").alias("__s"))
    rows = rows.join(s, F.col(key).cast("string") == F.col("__s"))
    out = F.lit(predicate).alias("predicate")
    none = F.lit(None).cast("string")
    if objects is None:
        return rows.select("subject", out, F.col(column).cast("string").alias("object"), none.alias("props"), none.alias("valid_to"))
    o = objects.select(F.col("id").alias("object"), F.col("key").alias("__o"))
    rows = rows.join(o, F.col(column).cast("string") == F.col("__o"))
    return rows.select("subject", out, F.col("object").cast("string").alias("object"), properties(props).alias("props"), (F.col(valid_end).cast("string") if valid_end else none).alias("valid_to"))


def link_facts(table: DataFrame, left: str, right: str, predicate: str, subjects: DataFrame, objects: DataFrame, props: tuple[str, ...] = ()) -> DataFrame:
    """A fact for each row of a link table of which both ends resolve; its end instant is a property."""
    return fk_facts(table, left, right, predicate, subjects, objects, props)


def properties(columns: tuple[str, ...]):
    """The scalars that aren't null, as JSON text."""
    return F.to_json(F.struct(*[F.col(c) for c in columns])) if columns else F.lit(None).cast("string")


def gaps(predicates: list[Predicate], types: dict[str, str], tables: set[str]) -> list[tuple[str, str]]:
    """(predicate, what can't be carried over)."""
    out = []
    for p in predicates:
        table, _, column = p.source.partition(".")
        if table not in tables:
            out.append((p.name, "source_unresolved"))
        elif p.from_type not in types.values():
            out.append((p.name, "from_not_entity"))
        elif not column and p.to not in types.values():
            out.append((p.name, "no_fk"))
        if p.valid_end and p.cardinality == "many":
            out.append((p.name, "valid_end_as_prop"))
    return out


def edges_as_of(log: DataFrame, predicates: list[Predicate], at: int | None = None) -> dict[str, DataFrame]:
    """(subject, object) of each predicate in effect at an instant, or now: values of one, elements of many."""
    out = {}
    for p in predicates:
        some, keys = log.where(F.col("predicate") == p.name), facts.KEYS if p.cardinality == "one" else facts.ELEMENT
        held = facts.current(facts.guarded_head(some, keys)) if at is None else facts.as_of(some, at, keys)
        out[p.name] = held.select("subject", F.col("object").cast("long").alias("object"))
    return out


def evaluate(edges: dict[str, DataFrame], hops: list[Hop], starts: DataFrame) -> DataFrame:
    """(start, end) of a derived relation: one join a hop, forward or backward, the frontier kept distinct.

    ``edges_as_of`` makes the edges of an instant, for predicates of one value and of many alike.
    """
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("at"))
    for hop in hops:
        a, b = ("object", "subject") if hop.reverse else ("subject", "object")
        step = edges[hop.predicate].select(F.col(a).alias("at"), F.col(b).alias("next"))
        frontier = frontier.join(step, "at").select("start", F.col("next").alias("at")).distinct()
    return frontier.select("start", F.col("at").alias("end"))


def path_errors(declared: dict[str, tuple[str, str]], hops: list[Hop], from_type: str, to_type: str) -> list[str]:
    """What is wrong with a path's types; nothing if it fits."""
    if not hops:
        return ["the path is empty"]
    at, out = from_type, []
    for hop in hops:
        if hop.predicate not in declared:
            return [*out, f"unknown predicate {hop.predicate}"]
        a, b = declared[hop.predicate][::-1] if hop.reverse else declared[hop.predicate]
        if a != at:
            out.append(f"{hop.predicate} starts at {a}, not {at}")
        at = b
    return out if at == to_type else [*out, f"the path ends at {at}, not {to_type}"]


def compositions(predicates: DataFrame, cap: int = 6) -> DataFrame:
    """Two-hop compositions (name, first, second, from, to, cardinality), those of one value first, at most ``cap``."""
    a = predicates.select(F.col("name").alias("first"), F.col("from"), F.col("to").alias("mid"), F.col("cardinality").alias("ca"), F.col("ord").alias("oa"))
    b = predicates.select(F.col("name").alias("second"), F.col("from").alias("mid"), F.col("to"), F.col("cardinality").alias("cb"), F.col("ord").alias("ob"))
    one = (F.col("ca") == "one") & (F.col("cb") == "one")
    rows = a.join(b, "mid").withColumn("cardinality", F.when(one, "one").otherwise("many"))
    return rows.orderBy(F.desc("cardinality"), "oa", "ob").limit(cap).select(skip_level(F.col("first"), F.col("second")).alias("name"), "first", "second", "from", "to", "cardinality")


def proposed_relations(candidates: DataFrame, predicates: DataFrame) -> DataFrame:
    """Candidates (ord, name, from, to, cardinality, path of predicate and direction) for derived relations that hold.

    Those of a wrong shape go first, then all but the first of a name, then those whose path doesn't lead through the
    types of ``predicates`` (name, from, to) from ``from`` to ``to``.
    """
    c = F.col
    whole = F.forall("path", lambda h: h["predicate"].isNotNull() & F.coalesce(h["direction"].isin("forward", "reverse"), F.lit(False)))
    shaped = candidates.dropna(subset=["name", "from", "to", "cardinality", "path"]).where(c("cardinality").isin("one", "many") & whole)
    first = shaped.groupBy("name").agg(F.min_by(F.struct(*shaped.columns), "ord").alias("r")).select("r.*")
    ends = predicates.select(c("name").alias("predicate"), c("from").alias("a"), c("to").alias("b"))
    hops = first.select("name", F.posexplode("path").alias("at", "hop")).select("name", "at", c("hop.predicate").alias("predicate"), (c("hop.direction") == "reverse").alias("back"))
    typed = hops.join(ends, "predicate", "left").select("name", F.struct("at", F.when(c("back"), c("b")).otherwise(c("a")).alias("start"), F.when(c("back"), c("a")).otherwise(c("b")).alias("end")).alias("hop"))
    ways = typed.groupBy("name").agg(F.sort_array(F.collect_list("hop")).alias("way"))
    leads = F.concat(F.array("from"), c("way.end")) == F.concat(c("way.start"), F.array("to"))
    return first.join(ways, "name").where(leads & ~F.exists("way", lambda h: h["start"].isNull())).select(*candidates.columns)


def role_plan(predicates: DataFrame, types: DataFrame) -> DataFrame:
    """What a mapping's tables are for in matching people with projects, told by structure: a row for each mapping.

    ``types`` (mapping, table, type) names the types of ``employees``, ``projects`` and ``skills``; ``predicates`` are
    (mapping, ord, name, from, to, cardinality, properties, valid_end). The first one from person to skill tells who has
    skills, the first from project to skill who needs them; those from person to project with properties or an end are
    assignments (ord, name, cardinality, end), where a predicate of one value has no end. ``error`` tells what lacks.
    """
    c = F.col
    of = lambda name: F.max(F.when(c("table") == name, c("type")))
    roles = types.groupBy("mapping").agg(of("employees").alias("person"), of("projects").alias("project"), of("skills").alias("skill"))
    rows = roles.join(predicates, "mapping", "full")
    between = lambda a, b: (c("from") == c(a)) & (c("to") == c(b))
    first = lambda a: F.min_by(F.when(between(a, "skill"), c("name")), F.when(between(a, "skill"), c("ord")))
    assigns = between("person", "project") & ((F.size(F.coalesce("properties", F.array())) > 0) | c("valid_end").isNotNull())
    assigned = F.struct("ord", "name", "cardinality", F.when(c("cardinality") != "one", c("valid_end")).alias("end"))
    made = rows.groupBy("mapping", "person", "project", "skill").agg(first("person").alias("has"), first("project").alias("needs"), F.sort_array(F.collect_list(F.when(assigns, assigned))).alias("assigned"))
    error = F.when(c("skill").isNull(), "skills aren't entities").when(c("person").isNull() | c("project").isNull(), "employees or projects aren't entities")
    return made.withColumn("error", error.when(c("has").isNull(), "no predicate from person to skill").when(c("needs").isNull(), "no predicate from project to skill"))


def by_key(rows: DataFrame, lookup: DataFrame, key: str, spread: str, share: int = 1000) -> DataFrame:
    """``rows`` with what ``lookup`` (one row a key) says of their key. Keys of over 1 / ``share`` of all rows are dealt to
    several tasks: their lookup row is repeated, their rows go by the hash of ``spread``. At most ``share`` keys are that hot,
    so that their list is broadcast; ``lookup`` is not, as it grows with the rows and would pass through the driver."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = checkpointed(counts.where(F.col("__n") > 1000))
    if hot.isEmpty():
        return rows.join(lookup.hint("merge"), key)
    step = max(1000, rows.count() // share)
    hot = F.broadcast(hot.where(F.col("__n") > step).select(F.col(key).alias("__key"), F.ceil(F.col("__n") / step).cast("int").alias("__shares")))
    left = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__shares")), F.lit(0)).cast("int")).drop("__key", "__shares")
    right = lookup.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__shares") - 1, F.lit(0))))).drop("__key", "__shares")
    return left.join(right.hint("merge"), [key, "__salt"]).drop("__salt")


def closure(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component of ``edges`` (a, b).

    Least labels spread along edges and through the labels themselves until nothing changes; each round is written
    to the checkpoint folder, so that lineage stays short, and removed when the next one is whole. As labels meet, many rows
    have one root, and a hub has many edges: such keys are dealt to several tasks.
    """
    spark = edges.sparkSession
    both, links = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    roots, path = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "id"))
    while True:  # labels only fall, and a path's length halves each round
        near = by_key(both, roots.select(F.col("id").alias("b"), "root"), "b", "a").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        spread, middle = stored(roots.join(near.hint("merge"), "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old")))
        jump = by_key(spread, roots.select(F.col("id").alias("root"), F.col("root").alias("far")), "root", "id").select("id", F.least("root", "far").alias("root"), "old")
        after, next_ = stored(jump)
        forget(spark, path, middle)
        roots, path, done = after.select("id", "root"), next_, after.where("root != old").isEmpty()
        if done:
            forget(spark, links)
            return roots


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
