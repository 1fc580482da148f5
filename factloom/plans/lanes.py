"""Listings, feeds, cycles of polling, extraction and plans over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import events as sources
from ..sources import listings
from .queries import HASH_SQL, PRED_SQL, declared, query, table

# Documents are files in one or two folders each; a quarter are shortcuts to the next document, some to none.
FILES = f"""f AS (SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN '{listings.SHORTCUT}' ELSE 'text/plain' END AS mime, CASE WHEN doc_id % 12 <> 5 THEN 'd' || (doc_id + 1) END AS target,
CASE WHEN doc_id % 3 <> 0 THEN 'p' || doc_id % 10 END AS permissions, ['f' || doc_id % 10, 'f' || doc_id % 7] AS parents, source AS drive, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 11 = 0 END AS trashed FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id"), lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    return table(spark, sf_dir, "documents").select(
        text("d", i).alias("id"),
        F.when(i % 4 == 1, listings.SHORTCUT).otherwise("text/plain").alias("mime"),
        F.when(i % 12 != 5, text("d", i + 1)).alias("target"),
        F.when(i % 3 != 0, text("p", i % 10)).alias("permissions"),
        F.array(text("f", i % 10), text("f", i % 7)).alias("parents"),
        F.col("source").alias("drive"),
        F.when(i % 5 != 0, i % 11 == 0).alias("trashed"),
    )


@query(f"""WITH {FILES}, s AS (SELECT * FROM f WHERE trashed IS DISTINCT FROM true) SELECT 'folder' AS scope, id FROM s WHERE list_contains(parents, 'f3')
UNION ALL SELECT 'drive', id FROM s WHERE drive = (SELECT min(source) FROM documents) UNION ALL SELECT 'my-drive', id FROM s""")
def src_files(spark, sf_dir):
    some = files(spark, sf_dir)
    drive = some.agg(F.min("drive")).first()[0]
    return graph.union_all([listings.listed(some, kind, scope).select(F.lit(kind).alias("scope"), "id") for kind, scope in (("folder", "f3"), ("drive", drive), ("my-drive", None))])


@query("""WITH c AS (SELECT event_id, 'f' || user_id % 10 AS folder FROM events WHERE event_id % 9 <> 0 AND event_id % 11 <> 0) SELECT 'all' AS lane, event_id AS token FROM c UNION ALL SELECT 'folder', event_id FROM c WHERE folder = 'f3'""")
def src_changes(spark, sf_dir):
    i = F.col("event_id")
    feed = table(spark, sf_dir, "events").select(i.alias("token"), F.when(i % 9 == 0, True).alias("removed"), (i % 11 == 0).alias("trashed"), F.array(F.concat(F.lit("f"), F.col("user_id") % 10)).alias("parents"))
    lane = lambda name, folder: listings.changed(feed, folder).select(F.lit(name).alias("lane"), "token")
    return lane("all", None).unionByName(lane("folder", "f3"))


@query(f"""WITH {FILES}, g AS (SELECT id, 'g' || substr(id, 2) AS given FROM f WHERE substr(id, 2)::BIGINT % 2 = 0),
r AS (SELECT CASE WHEN k.id IS NULL THEN f.id ELSE k.id END AS id, CASE WHEN k.id IS NULL THEN f.mime ELSE k.mime END AS mime, CASE WHEN k.id IS NULL THEN f.permissions ELSE k.permissions END AS permissions,
f.mime = '{listings.SHORTCUT}' AND f.target IS NOT NULL AND k.id IS NULL AS lost FROM f LEFT JOIN f k ON f.mime = '{listings.SHORTCUT}' AND k.id = f.target)
SELECT r.id, mime, coalesce(permissions, CASE WHEN NOT lost THEN given END) AS permissions FROM r LEFT JOIN g ON g.id = r.id""")
def src_hydrate(spark, sf_dir):
    some = files(spark, sf_dir)
    number = F.expr("cast(substr(id, 2) as long)")
    grants = some.where(number % 2 == 0).select("id", F.concat(F.lit("g"), number.cast("string")).alias("permissions"))
    return listings.hydrated(some, some, grants).select("id", "mime", "permissions")


@query(f"SELECT 'assert' AS op, {HASH_SQL.format('n_name')} + 1688849860263936 AS subject, 'folder-name' AS predicate, 'Drive of ' || n_name AS object, n_nationkey AS valid_from FROM nation")
def fs_root(spark, sf_dir):
    return listings.drive_roots(table(spark, sf_dir, "nation").select(F.col("n_name").alias("drive"), F.concat(F.lit("Drive of "), "n_name").alias("name"), F.col("n_nationkey").alias("at")))


POLL = """c AS (SELECT event_type AS scope, CASE WHEN event_type < 'p' THEN min(event_id) + 50 ELSE max(event_id) END AS cursor FROM events GROUP BY event_type),
p AS (SELECT event_type AS scope, event_id AS id FROM events JOIN c ON c.scope = event_type WHERE event_id > cursor AND event_id % 5 IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 100)"""


def cycle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A cycle of polling of each type of event, some of whose cursors stand at the end; the cursors before it."""
    some = table(spark, sf_dir, "events").select(F.col("event_type").alias("scope"), F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("type"))
    cursors = some.groupBy("scope").agg(F.when(F.col("scope") < "p", F.min("id") + 50).otherwise(F.max("id")).alias("cursor"))
    return listings.polled(some, cursors), cursors


@query(f"WITH {POLL} SELECT * FROM p")
def src_poll(spark, sf_dir):
    return cycle(spark, sf_dir)[0].drop("type")


@query(f"WITH {POLL} SELECT c.scope, greatest(c.cursor, coalesce(max(id), c.cursor)) AS cursor FROM c LEFT JOIN p USING (scope) GROUP BY c.scope, c.cursor")
def src_cursor(spark, sf_dir):
    return listings.next_cursors(*cycle(spark, sf_dir))


# Extraction: a document tells its language and, as a value, its number.

NAMED = "d AS (SELECT doc_id, source, lang FROM documents WHERE source <> '' AND lang <> '')"
ENTITY = HASH_SQL.format("({0} || '|' || lower(trim({1})))") + " + 2251799813685248"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = lambda subject, predicate, obj, type_: F.struct(subject.alias("subject"), F.lit("Source").alias("subjectType"), F.lit(predicate).alias("predicate"), obj.alias("object"), F.lit(type_).alias("objectType"))
    c, i = F.col, F.col("doc_id")
    spelled = F.when(i % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit(" "), "source"))
    facts_ = F.array(fact(spelled, "written-in", c("lang"), "Language"), fact(c("source"), "number", i.cast("string"), "Number"), fact(c("source"), "empty", F.lit(""), "Number"))
    return table(spark, sf_dir, "documents").where("source <> '' and lang <> ''").select(i.alias("doc"), F.concat(F.lit("Answer: "), F.to_json(F.struct(facts_.alias("facts")))).alias("answer"))


@query(f"WITH {NAMED} SELECT {ENTITY.format(repr('Source'), 'source')} AS subject, 'written-in' AS predicate, ({ENTITY.format(repr('Language'), 'lang')})::VARCHAR AS object, true AS derived, 'doc:' || doc_id AS source FROM d UNION ALL SELECT {ENTITY.format(repr('Source'), 'source')}, 'number', doc_id::VARCHAR, true, 'doc:' || doc_id FROM d")
def ex_doc(spark, sf_dir):
    return sources.extracted_facts(answers(spark, sf_dir), spark.createDataFrame([("number",)], "predicate string"))[1]


@query(f"WITH {NAMED} SELECT {ENTITY.format(repr('Source'), 'source')} AS id, 'Source' AS type, arg_min(CASE WHEN doc_id % 2 = 0 THEN upper(trim(source)) ELSE trim(source) END, doc_id) AS name FROM d GROUP BY lower(trim(source)), {ENTITY.format(repr('Source'), 'source')} UNION ALL SELECT {ENTITY.format(repr('Language'), 'lang')}, 'Language', arg_min(trim(lang), doc_id) FROM d GROUP BY lower(trim(lang)), {ENTITY.format(repr('Language'), 'lang')}")
def ex_nodes(spark, sf_dir):
    return sources.extracted_facts(answers(spark, sf_dir), spark.createDataFrame([("number",)], "predicate string"))[0]


# Plans: parts are candidates of paths, customers are mappings.

@query(f"""WITH {PRED_SQL}, q AS (SELECT p_partkey AS ord, p_brand || p_size % 20 AS name, a.name AS p1, b.name AS p2, part.p_size % 3 = 0 AS back, a."from" AS f, b."to" AS t, CASE WHEN p_size % 3 = 0 THEN b."to" ELSE b."from" END AS s2, CASE WHEN p_size % 3 = 0 THEN b."from" ELSE b."to" END AS e2, a."to" AS e1, p_partkey % 10 <> 0 AS ok
FROM part JOIN p a ON a.ord = p_partkey % 7 + 1 JOIN p b ON b.ord = p_partkey % 5 + 1),
u AS (SELECT * FROM q WHERE ok QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1) SELECT name, ord FROM u WHERE e1 = s2 AND e2 = t""")
def dr_propose(spark, sf_dir):
    """Paths of two declared predicates for each part, of which every tenth has no cardinality."""
    c = F.col
    p = declared(spark)
    a, b = [p.select(c("ord").alias(f"o{k}"), c("name").alias(f"p{k}"), c("from").alias(f"f{k}"), c("to").alias(f"t{k}")) for k in (1, 2)]
    rows = table(spark, sf_dir, "part").join(a, c("o1") == c("p_partkey") % 7 + 1).join(b, c("o2") == c("p_partkey") % 5 + 1)
    hop = lambda name, way: F.struct(c(name).alias("predicate"), way.alias("direction"))
    path = F.array(hop("p1", F.lit("forward")), hop("p2", F.when(c("p_size") % 3 == 0, "reverse").otherwise("forward")))
    some = rows.select(c("p_partkey").alias("ord"), F.concat("p_brand", (c("p_size") % 20).cast("string")).alias("name"), c("f1").alias("from"), c("t2").alias("to"), F.when(c("p_partkey") % 10 != 0, "many").alias("cardinality"), path.alias("path"))
    return graph.proposed_relations(some, p).select("name", "ord")


@query("""WITH m AS (SELECT c_custkey AS mapping, c_custkey % 7 AS k FROM customer) SELECT mapping, CASE WHEN k <> 1 THEN 'Person' END AS person, 'Project' AS project, CASE WHEN k <> 0 THEN 'Skill' END AS skill,
CASE WHEN k NOT IN (0, 1, 2) THEN 'knows' END AS has, CASE WHEN k NOT IN (0, 3) THEN 'needs' END AS needs, CASE WHEN k = 1 THEN '' WHEN k = 4 THEN 'leads' ELSE 'leads,works-on:until' END AS assigned,
CASE k WHEN 0 THEN 'skills aren''t entities' WHEN 1 THEN 'employees or projects aren''t entities' WHEN 2 THEN 'no predicate from person to skill' WHEN 3 THEN 'no predicate from project to skill' END AS error FROM m""")
def py_plan(spark, sf_dir):
    """A mapping for each customer; each of seven kinds but three lacks something."""
    c = F.col
    m = table(spark, sf_dir, "customer").select(c("c_custkey").alias("mapping"), (c("c_custkey") % 7).alias("k"))
    tables = [("employees", "Person", 1), ("projects", "Project", 9), ("skills", "Skill", 0)]
    rows = [(1, "knows", "Person", "Skill", "many", None, None, 2), (2, "also-knows", "Person", "Skill", "many", None, None, 2), (3, "needs", "Project", "Skill", "many", None, None, 3), (4, "leads", "Person", "Project", "one", ["share"], "until", 9), (5, "works-on", "Person", "Project", "many", None, "until", 4), (6, "likes", "Person", "Project", "many", [], None, 9)]

    def for_each(rows, schema):  # the declared rows of every mapping, but for those that its kind lacks
        made = m.withColumn("r", F.explode(F.from_json(F.lit(json.dumps([dict(zip(schema, r)) for r in rows])), f"array<struct<{', '.join(f'`{n}`: {t}' for n, t in schema.items())}>>")))
        return made.select("mapping", "k", "r.*").where("k <> lacks").drop("k", "lacks")

    types = for_each(tables, {"table": "string", "type": "string", "lacks": "long"})
    predicates = for_each(rows, {"ord": "int", "name": "string", "from": "string", "to": "string", "cardinality": "string", "properties": "array<string>", "valid_end": "string", "lacks": "long"})
    made = graph.role_plan(predicates, types)
    return made.withColumn("assigned", F.array_join(F.transform("assigned", lambda a: F.concat_ws(":", a["name"], a["end"])), ","))
