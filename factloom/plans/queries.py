"""Each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import catalog, facts, graph, patterns, people
from ..sources import events as sources
from ..sources import schemas
from ..streaming import guard, heads

NOW = 1_600_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str):
    """Instants without a zone are UTC."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


# The fact log of events: a user's value of each type of event; every tenth event closes it. Write order is a hash.
LOG = """log AS (SELECT md5(event_id::VARCHAR) AS seq, CASE WHEN event_id % 10 = 0 THEN 'close' ELSE 'assert' END AS op, user_id AS subject,
  event_type AS predicate, floor(value)::BIGINT::VARCHAR AS object, floor(epoch(ts))::BIGINT AS valid_from, CASE WHEN event_id % 7 = 0 THEN floor(epoch(ts))::BIGINT + 86400 END AS valid_to,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'lane' || (event_id % 3) END AS source FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = seconds("ts")
    return table(spark, sf_dir, "events").select(
        F.md5(F.col("event_id").cast("string")).alias("seq"),
        F.when(F.col("event_id") % 10 == 0, "close").otherwise("assert").alias("op"),
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("predicate"),
        F.floor("value").cast("string").alias("object"),
        at.alias("valid_from"),
        F.when(F.col("event_id") % 7 == 0, at + 86400).alias("valid_to"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("lane"), F.col("event_id") % 3)).alias("source"),
    )


MIDDLE = "(SELECT (min(epoch(ts))::BIGINT + max(epoch(ts))::BIGINT) // 2 FROM events)"
HEAD = "head AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY seq DESC) = 1)"


def middle(spark: SparkSession, sf_dir: str) -> int | None:
    """As ``MIDDLE``: both ends are rounded, halves to even, and half their sum is cut off towards zero; none without events."""
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    return table(spark, sf_dir, "events").agg(F.min(at).alias("low"), F.max(at).alias("high")).selectExpr("(low + high) div 2").first()[0]


@query(f"WITH {LOG}, {HEAD} SELECT subject, predicate, object FROM head WHERE op = 'assert'")
def g_point(spark, sf_dir):
    return facts.current(facts.raw_head(log(spark, sf_dir))).select("subject", "predicate", "object")


@query(f"WITH {LOG}, {HEAD} SELECT subject, predicate, CASE WHEN op = 'assert' THEN object END AS object, CASE WHEN op = 'assert' THEN valid_from END AS valid_from, CASE WHEN op = 'assert' THEN source END AS source, CASE WHEN op <> 'assert' THEN valid_from END AS closed_from FROM head")
def g_point_rec(spark, sf_dir):
    return facts.point(log(spark, sf_dir))


@query(f"WITH {LOG}, {HEAD} SELECT subject, predicate, object::BIGINT AS object_int FROM head WHERE op = 'assert'")
def g_point_int(spark, sf_dir):
    return facts.current(facts.raw_head(log(spark, sf_dir))).select("subject", "predicate", F.col("object").try_cast("long").alias("object_int"))


@query(f"WITH {LOG} SELECT subject, predicate, op, object, valid_from FROM log QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, seq DESC) = 1")
def cf_late(spark, sf_dir):
    return facts.guarded_head(log(spark, sf_dir)).select("subject", "predicate", "op", "object", "valid_from")


@query(f"WITH {LOG}, w AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, seq DESC) = 1) SELECT subject, predicate, op, object FROM w")
def cf_late_stream(spark, sf_dir):
    """The same by the guard over a stream, in four micro-batches by the hash of events: what the log then holds last."""
    some = log(spark, sf_dir).withColumn("number", F.conv(F.substring("seq", 1, 15), 16, 10).cast("long")).drop("seq").withColumnRenamed("number", "seq")
    folder = f"{graph.shared_folder(spark)}/factloom/guard-{uuid.uuid4().hex}"
    some.select("seq", "op", "subject", "predicate", "object", "valid_from", "valid_to").repartition(4, "seq").write.parquet(f"{folder}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    guard.state_in_rocksdb(spark)
    arrivals = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    heads.ingest(guard.guarded(arrivals), f"{folder}/out", f"{folder}/state").awaitTermination()
    spark.conf.set(provider, before)
    return facts.raw_head(guard.log_of(spark.read.parquet(f"{folder}/out"))).select("subject", "predicate", "op", "object")


@query(f"WITH {LOG}, e AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY seq DESC) = 1) SELECT subject, predicate, string_agg(object, ',' ORDER BY object) AS objects FROM e WHERE op = 'assert' GROUP BY ALL")
def g_point_many(spark, sf_dir):
    head = facts.current(facts.raw_head(log(spark, sf_dir), facts.ELEMENT))
    return head.groupBy("subject", "predicate").agg(F.array_join(F.array_sort(F.collect_list("object")), ",").alias("objects"))


@query(f"WITH {LOG}, m AS (SELECT {MIDDLE} AS t), w AS (SELECT * FROM log, m WHERE valid_from <= t QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, seq DESC) = 1) SELECT subject, predicate, object, valid_from FROM w WHERE op = 'assert' AND (valid_to IS NULL OR valid_to > t)")
def g_asof_one(spark, sf_dir):
    return facts.as_of(log(spark, sf_dir), middle(spark, sf_dir)).select("subject", "predicate", "object", "valid_from")


@query(f"WITH {LOG}, m AS (SELECT {MIDDLE} AS t), w AS (SELECT * FROM log, m WHERE valid_from <= t QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY valid_from DESC, seq DESC) = 1) SELECT subject, predicate, string_agg(object, ',' ORDER BY object) AS objects FROM w WHERE op = 'assert' AND (valid_to IS NULL OR valid_to > t) GROUP BY ALL")
def g_asof_many(spark, sf_dir):
    won = facts.as_of(log(spark, sf_dir), middle(spark, sf_dir), facts.ELEMENT)
    return won.groupBy("subject", "predicate").agg(F.array_join(F.array_sort(F.collect_list("object")), ",").alias("objects"))


@query(f"WITH {LOG}, i AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, seq) AS u FROM log) SELECT subject, predicate, object, valid_from, least(u, valid_to) AS until FROM i WHERE op = 'assert'")
def g_interval(spark, sf_dir):
    return facts.intervals(log(spark, sf_dir))


@query(f"WITH {LOG}, asks AS (SELECT subject, predicate, valid_from + 3600 AS at FROM log WHERE valid_to IS NOT NULL) SELECT a.subject, a.predicate, a.at, (SELECT CASE WHEN l.op = 'assert' AND (l.valid_to IS NULL OR l.valid_to > a.at) THEN l.object END FROM log l WHERE l.subject = a.subject AND l.predicate = a.predicate AND l.valid_from <= a.at ORDER BY l.valid_from DESC, l.seq DESC LIMIT 1) AS object FROM asks a")
def join_asof_each(spark, sf_dir):
    some = log(spark, sf_dir)
    return facts.as_of_each(some, some.where("valid_to is not null").select("subject", "predicate", (F.col("valid_from") + 3600).alias("at")))


# Edges: which supplier delivers which part; shipped lines of return flag R close the edge.
EDGES = "edges AS (SELECT l_suppkey AS subject, l_partkey AS object, floor(epoch(l_shipdate))::BIGINT AS valid_from, md5(l_orderkey || ':' || l_linenumber || ':' || floor(epoch(l_shipdate))::BIGINT || ':' || l_quantity::BIGINT) AS seq, CASE WHEN l_returnflag = 'R' THEN 'close' ELSE 'assert' END AS op, l_quantity::BIGINT AS quantity FROM lineitem)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    at = seconds("l_shipdate")
    seq = F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber", at.cast("string"), c("l_quantity").cast("long").cast("string")))
    props = F.create_map(F.lit("quantity"), c("l_quantity").cast("long").cast("string"), F.lit("none"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("subject"), F.lit("delivers").alias("predicate"), c("l_partkey").alias("object"), at.alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), seq.alias("seq"), F.when(c("l_returnflag") == "R", "close").otherwise("assert").alias("op"), props.alias("props"))


EDGE_HEAD = "w AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY seq DESC) = 1)"


@query(f"WITH {EDGES}, {EDGE_HEAD} SELECT subject, object FROM w WHERE op = 'assert'")
def g_expand(spark, sf_dir):
    return facts.expand(edges(spark, sf_dir), "delivers")


@query(f"WITH {EDGES}, {EDGE_HEAD}, e AS (SELECT subject, object FROM w WHERE op = 'assert') SELECT subject, object FROM e UNION SELECT object, subject FROM e")
def g_expand_symmetric(spark, sf_dir):
    return facts.expand(edges(spark, sf_dir), "delivers", symmetric=True)


@query(f"WITH {EDGES}, {EDGE_HEAD} SELECT subject, 'delivers' AS predicate, object, 'quantity' AS key, quantity::VARCHAR AS value FROM w WHERE op = 'assert'")
def g_edgeprops(spark, sf_dir):
    return facts.edge_props(edges(spark, sf_dir))


TIERS = "tiers AS (SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE l.toxic * 2 + l.quality END AS label FROM documents d LEFT JOIN labels l USING (doc_id))"


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(F.col("doc_id").alias("id"), (F.col("toxic") * 2 + F.col("quality")).alias("label"))


@query(f"WITH {TIERS} SELECT id, label IS NOT NULL AND ((6 >> label) & 1) = 0 AS denied, CASE WHEN label IS NULL OR ((6 >> label) & 1) = 1 THEN 'Document' END AS type FROM tiers")
def g_node(spark, sf_dir):
    shown = fn.visible(F.col("label"), 6)
    return tiers(spark, sf_dir).select("id", (~shown).alias("denied"), F.when(shown, "Document").alias("type"))


NODES = "nodes AS (SELECT c_custkey AS id, 'Customer' AS type FROM customer UNION ALL SELECT s_suppkey + 1000000000, 'Supplier' FROM supplier UNION ALL SELECT p_partkey + 2000000000, 'Part' FROM part)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer", "c_custkey", "Customer", 0), ("supplier", "s_suppkey", "Supplier", 10**9), ("part", "p_partkey", "Part", 2 * 10**9)]
    return graph.union_all([table(spark, sf_dir, t).select((F.col(k) + base).alias("id"), F.lit(kind).alias("type")) for t, k, kind, base in parts])


@query(f"WITH {NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def g_overview(spark, sf_dir):
    return facts.overview(nodes(spark, sf_dir))


@query(f"WITH {NODES}, {EDGES}, {EDGE_HEAD} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM w WHERE op = 'assert') AS edges, (SELECT count(*) FROM edges) AS changes")
def g_stats(spark, sf_dir):
    return facts.stats(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {LOG}, {HEAD} SELECT u.id, h.object AS name FROM (SELECT DISTINCT user_id AS id FROM events) u LEFT JOIN head h ON h.subject = u.id AND h.predicate = 'click' AND h.op = 'assert'")
def g_graph(spark, sf_dir):
    return facts.named_nodes(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct(), log(spark, sf_dir), "click")


@query(f"WITH {LOG}, e AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY subject, predicate, object ORDER BY seq DESC) = 1) SELECT b.subject, b.predicate, b.object, b.valid_from FROM log b WHERE b.op = 'assert' AND EXISTS (SELECT 1 FROM e WHERE e.op = 'assert' AND e.subject = b.subject AND e.predicate = b.predicate AND e.object = b.object AND e.valid_from = b.valid_from AND e.valid_to IS NOT DISTINCT FROM b.valid_to)")
def snk_suppress(spark, sf_dir):
    some = log(spark, sf_dir)
    return facts.suppressed(some, some)[1].select("b.subject", "b.predicate", "b.object", "b.valid_from")


@query(f"WITH {LOG} SELECT seq, coalesce(source, 'events') AS source FROM log")
def snk_stamp(spark, sf_dir):
    return facts.stamped(log(spark, sf_dir), "events").select("seq", "source")


@query("SELECT '{\"id\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS value FROM customer")
def snk_ndjson(spark, sf_dir):
    return facts.ndjson(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))


@query("SELECT DISTINCT sha256(text) AS digest, length(text) AS n FROM documents WHERE text IS NOT NULL")
def snk_cas(spark, sf_dir):
    return facts.content_store(table(spark, sf_dir, "documents")).select("digest", F.length("text").cast("long").alias("n"))


# Tables to graph


@query("SELECT row_number() OVER (ORDER BY c_custkey) + 100 AS id, 'Customer' AS type, c_custkey::VARCHAR AS key, c_nationkey % 4 AS label FROM customer")
def tr_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("label", F.col("c_nationkey") % 4)
    return graph.nodes_of(rows, "c_custkey", "Customer", 100, "label")


@query("WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey FROM customer), o AS (SELECT row_number() OVER (ORDER BY o_orderkey) + 1000000000 AS id, * FROM orders) SELECT o.id AS subject, 'ordered-by' AS predicate, c.id::VARCHAR AS object FROM o JOIN c ON c.c_custkey = o.o_custkey")
def tr_fk(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    s, t = graph.nodes_of(o, "o_orderkey", "Order", 10**9), graph.nodes_of(c, "c_custkey", "Customer")
    return graph.fk_facts(o, "o_orderkey", "o_custkey", "ordered-by", s, t).select("subject", "predicate", "object")


LINK = "WITH s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_suppkey FROM supplier), p AS (SELECT row_number() OVER (ORDER BY p_partkey) + 1000000000 AS id, p_partkey FROM part)"


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = graph.nodes_of(table(spark, sf_dir, "supplier"), "s_suppkey", "Supplier"), graph.nodes_of(table(spark, sf_dir, "part"), "p_partkey", "Part", 10**9)
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_quantity").cast("long").alias("quantity"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("status"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ended"))
    return graph.link_facts(rows, "l_suppkey", "l_partkey", "delivers", s, p, ("quantity", "status", "ended"))


@query(LINK + " SELECT s.id AS subject, 'delivers' AS predicate, p.id::VARCHAR AS object, count(*) AS n FROM lineitem JOIN s ON s_suppkey = l_suppkey JOIN p ON p_partkey = l_partkey GROUP BY ALL")
def tr_link(spark, sf_dir):
    return link(spark, sf_dir).groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n"))


@query(LINK + " SELECT s.id AS subject, p.id::VARCHAR AS object, '{\"quantity\":' || l_quantity::BIGINT || CASE WHEN l_returnflag = 'R' THEN ',\"status\":\"' || l_linestatus || '\"' ELSE '' END || ',\"ended\":\"' || strftime(l_shipdate, '%Y-%m-%d') || '\"}' AS props FROM lineitem JOIN s ON s_suppkey = l_suppkey JOIN p ON p_partkey = l_partkey")
def tr_props(spark, sf_dir):
    return link(spark, sf_dir).select("subject", "object", "props")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) AS subject, o_orderstatus AS object, strftime(o_orderdate, '%Y%m%d')::INTEGER AS valid_to FROM orders WHERE o_orderstatus IS NOT NULL")
def tr_validend(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = graph.fk_facts(o, "o_orderkey", "o_orderstatus", "status", graph.nodes_of(o, "o_orderkey", "Order"), None).select("subject", "object")
    keyed = graph.nodes_of(o, "o_orderkey", "Order").join(o.select(F.col("o_orderkey").cast("string").alias("key"), fn.yyyymmdd(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("valid_to")), "key")
    return made.join(keyed.select(F.col("id").alias("subject"), "valid_to"), "subject")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d')::INTEGER AS day FROM orders")
def tr_date(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fn.yyyymmdd(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE c_name END AS label FROM customer")
def tr_labels(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 != 0, F.col("c_name"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), fn.first_name(name, F.col("c_custkey").cast("string")).alias("label"))


@query("SELECT * FROM (VALUES ('due', 'valid_end_as_prop'), ('ghost', 'source_unresolved'), ('odd', 'from_not_entity'), ('lost', 'no_fk')) t(predicate, gap)")
def tr_gaps(spark, sf_dir):
    some = [graph.Predicate("due", "orders.o_custkey", "Order", "Customer", "many", valid_end="o_orderdate"), graph.Predicate("ghost", "nowhere.x", "Order", "Customer"), graph.Predicate("odd", "orders.o_custkey", "Thing", "Customer"), graph.Predicate("lost", "lineitem", "Order", "Nothing")]
    return spark.createDataFrame(graph.gaps(some, {"orders": "Order", "customer": "Customer"}, {"orders", "customer", "lineitem"}), "predicate string, gap string")


# Scalar functions

HASH_SQL = "list_reduce(list_transform(string_split({0}, ''), lambda ch: unicode(ch)::BIGINT), lambda h, x: (((xor(h, x) & 255) << 40) + xor(h, x) * 435) & 281474976710655, 172505283306277::BIGINT)"


@query(f"SELECT n_nationkey AS id, {HASH_SQL.format('n_name')} AS hash, 'p' || lower(to_hex({HASH_SQL.format(chr(39) + 'issue|' + chr(39) + ' || n_name || ' + chr(39) + '|p' + chr(39))})) AS pattern_id FROM nation")
def an_patternid(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), fn.hash48(F.col("n_name")).alias("hash"), fn.hex_id("p", F.concat(F.lit("issue|"), F.col("n_name"), F.lit("|p"))).alias("pattern_id"))


@query("SELECT k AS id, CASE WHEN k >= 1 AND k < 1000000000000 THEN 'hr' WHEN k < 2000000000000 AND k >= 1000000000000 THEN 'issues' WHEN k >= 1970324836974592 AND k < 2251799813685248 THEN 'drive' END AS band FROM (SELECT c_custkey + (c_custkey % 4) * 656774945658197 AS k FROM customer)")
def id_band(spark, sf_dir):
    k = F.col("c_custkey") + (F.col("c_custkey") % 4) * 656774945658197
    return table(spark, sf_dir, "customer").select(k.alias("id"), fn.person_band(k).alias("band"))


@query("SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE floor(epoch(ts))::BIGINT END AS at FROM events")
def ev_epoch(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), fn.epoch_or_zero(text).alias("at"))


@query("SELECT DISTINCT 'https://drive.example/drive/folders/' || source || '_folder01?x=1' AS link, source || '_folder01' AS folder FROM documents")
def src_folderid(spark, sf_dir):
    link_ = F.concat(F.lit("https://drive.example/drive/folders/"), F.col("source"), F.lit("_folder01?x=1"))
    return table(spark, sf_dir, "documents").select(link_.alias("link")).distinct().select("link", schemas.folder_id(F.col("link")).alias("folder"))


@query("SELECT doc_id AS id, CASE WHEN source IN ('src0', 'src1') THEN coalesce(lang, doc_id::VARCHAR) END AS name, CASE WHEN source IN ('src0', 'src1') THEN coalesce(lang, doc_id::VARCHAR) LIKE '%de%' END AS draft, CASE WHEN source IN ('src0', 'src1') THEN NULL ELSE coalesce(source, 'unknown') END AS skipped, CASE WHEN source IN ('src0', 'src1') THEN NULL ELSE count(*) OVER (PARTITION BY coalesce(source, 'unknown')) END AS n FROM documents")
def cl_classify(spark, sf_dir):
    """Documents of two sources can be read, those in German count as drafts; of the others it says how many of a kind there are."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("name"), F.col("source").alias("mime"))
    readable, skipped = sources.classified(d, ("src0", "src1"), "(?i)de")
    none = lambda kind: F.lit(None).cast(kind)
    rest = d.withColumn("skipped", F.coalesce("mime", F.lit("unknown"))).join(skipped.withColumnRenamed("mime", "skipped"), "skipped")
    return readable.select("id", "name", "draft", none("string").alias("skipped"), none("long").alias("n")).unionByName(rest.select("id", none("string").alias("name"), none("boolean").alias("draft"), "skipped", "n"))


@query("SELECT doc_id AS doc, sha256(text) AS digest FROM documents")
def cl_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("digest"))


@query("SELECT DISTINCT lang AS type, substr(source, 1) AS name FROM documents")
def cl_known(spark, sf_dir):
    anchors = table(spark, sf_dir, "documents").select(F.concat_ws("|", "lang", "source").alias("entity"))
    return sources.known_entities(anchors)


# Patterns

PATTERN_EVENTS = "ev AS (SELECT c_nationkey::BIGINT AS grp, o_orderkey AS id, ascii(o_orderpriority)::BIGINT AS t, floor(epoch(o_orderdate))::BIGINT AS atx FROM orders JOIN customer ON c_custkey = o_custkey)"


def pattern_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("group"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.select("group", F.col("o_orderkey").alias("id"), F.array(F.ascii("o_orderpriority").cast("long")).alias("targets"), seconds("o_orderdate").alias("at"))


MINE = """WITH {events}, sizes AS (SELECT grp, count(*) AS total, min(atx) AS window_from, max(atx) AS window_to FROM ev GROUP BY grp HAVING count(*) >= 10),
n1 AS (SELECT grp, t AS first, count(*) AS gain1 FROM ev GROUP BY grp, t QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, t) = 1),
left_ AS (SELECT ev.* FROM ev JOIN n1 USING (grp) JOIN sizes USING (grp) WHERE ev.t <> n1.first AND gain1 / total < {share}),
n2 AS (SELECT grp, t AS second, count(*) AS gain2 FROM left_ GROUP BY grp, t QUALIFY row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, t) = 1),
found AS (SELECT s.grp, first, second, gain1 + coalesce(gain2, 0) AS support, total, window_from, window_to FROM sizes s JOIN n1 USING (grp) LEFT JOIN n2 USING (grp) WHERE (gain1 + coalesce(gain2, 0)) / total >= {share}),
missed AS (SELECT f.grp, ev.id, row_number() OVER (PARTITION BY f.grp ORDER BY ev.id) AS r FROM ev JOIN found f USING (grp) WHERE ev.t <> f.first AND ev.t IS DISTINCT FROM f.second),
ex AS (SELECT grp, string_agg(id, ',' ORDER BY id) FILTER (WHERE r <= 20) AS exceptions, greatest(count(*) - 20, 0) AS omitted FROM missed GROUP BY grp)
SELECT f.grp AS "group", first, second, support, total, coalesce(exceptions, '') AS exceptions, coalesce(omitted, 0) AS omitted, window_from, window_to FROM found f LEFT JOIN ex USING (grp)"""


@query(MINE.format(events=PATTERN_EVENTS, share=0.3))
def an_pattern(spark, sf_dir):
    return patterns.mine(pattern_events(spark, sf_dir), 0.3)


STRICT_EVENTS = "ev AS (SELECT c_nationkey AS grp, o_orderkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN CASE o_orderkey % 6 WHEN 0 THEN 1000 + o_orderkey % 100 WHEN 1 THEN c_nationkey + 100 ELSE c_nationkey END WHEN o_orderkey % CASE c_nationkey % 3 WHEN 1 THEN 4 ELSE 8 END = 0 THEN 1000 + o_orderkey % 100 ELSE c_nationkey END::BIGINT AS t, floor(epoch(o_orderdate))::BIGINT AS atx FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(MINE.format(events=STRICT_EVENTS, share=0.8))
def an_pattern_strict(spark, sf_dir):
    """A third of the nations is covered by two targets, a third by one, and the rest by none."""
    n, k = F.col("c_nationkey"), F.col("o_orderkey")
    rare = 1000 + k % 100
    target = F.when(n % 3 == 0, F.when(k % 6 == 0, rare).when(k % 6 == 1, n + 100).otherwise(n)).when(k % F.when(n % 3 == 1, 4).otherwise(8) == 0, rare).otherwise(n)
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return patterns.mine(rows.select(n.alias("group"), k.alias("id"), F.array(target.cast("long")).alias("targets"), seconds("o_orderdate").alias("at")))


@query(MINE.format(events="ev AS (SELECT l_suppkey AS grp, l_orderkey * 10 + l_linenumber AS id, ascii(l_linestatus)::BIGINT AS t, floor(epoch(l_shipdate))::BIGINT AS atx FROM lineitem)", share=0.8))
def an_pattern_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("group"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array(F.ascii("l_linestatus").cast("long")).alias("targets"), seconds("l_shipdate").alias("at"))
    return patterns.mine(rows)


@query(f"WITH {PATTERN_EVENTS} SELECT t AS target, count(*) AS support, (SELECT count(*) FROM ev) AS total FROM ev GROUP BY t HAVING count(*) >= 0.2 * (SELECT count(*) FROM ev)")
def an_ubiq(spark, sf_dir):
    return patterns.ubiquitous(pattern_events(spark, sf_dir), 0.2)


@query(f"WITH {PATTERN_EVENTS}, d AS (SELECT t FROM ev GROUP BY t HAVING count(*) >= 0.2 * (SELECT count(*) FROM ev)) SELECT grp AS \"group\", id, CASE WHEN t IN (SELECT t FROM d) THEN 0 ELSE 1 END AS n FROM ev")
def an_ubiq_strip(spark, sf_dir):
    some = pattern_events(spark, sf_dir)
    return patterns.stripped(some, patterns.ubiquitous(some, 0.2)).select("group", "id", F.size("targets").alias("n"))


@query(f"WITH {PATTERN_EVENTS} SELECT t AS target, count(DISTINCT id) AS events FROM ev GROUP BY t")
def ag_reach(spark, sf_dir):
    some = pattern_events(spark, sf_dir).select("id", F.explode(F.array_distinct("targets")).alias("target"))
    return some.groupBy("target").agg(F.count_distinct("id").alias("events"))


@query(f'WITH {PATTERN_EVENTS} SELECT grp AS "group", coalesce(min(atx) FILTER (atx > 0), 0) AS window_from, coalesce(max(atx) FILTER (atx > 0), 0) AS window_to FROM ev GROUP BY grp')
def ag_window(spark, sf_dir):
    at = F.when(F.col("at") > 0, F.col("at"))
    return pattern_events(spark, sf_dir).groupBy("group").agg(F.coalesce(F.min(at), F.lit(0)).alias("window_from"), F.coalesce(F.max(at), F.lit(0)).alias("window_to"))


@query(f'WITH {PATTERN_EVENTS}, c AS (SELECT grp, date_trunc(\'month\', make_timestamp(atx * 1000000)) AS m, t, count(*) AS n FROM ev GROUP BY ALL) SELECT grp AS "group", epoch(m)::BIGINT AS month, t AS target FROM c QUALIFY row_number() OVER (PARTITION BY grp, m ORDER BY n DESC, t) = 1')
def ag_mode(spark, sf_dir):
    some = pattern_events(spark, sf_dir).select("group", F.unix_seconds(F.date_trunc("month", F.timestamp_seconds("at"))).alias("month"), F.explode("targets").alias("t"))
    counts = some.groupBy("group", "month", "t").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("group", "month").agg(F.max(F.struct("n", -F.col("t"))).alias("m")).select("group", "month", (-F.col("m.col2")).alias("target"))


MONTHS = "w AS (SELECT grp, min(atx) AS a, max(atx) AS b FROM ev GROUP BY grp), months AS (SELECT grp, epoch(m)::BIGINT AS atx FROM (SELECT grp, a, b, unnest(generate_series(date_trunc('month', make_timestamp(a * 1000000)), make_timestamp(b * 1000000), INTERVAL 1 MONTH)) AS m FROM w) WHERE epoch(m) >= a QUALIFY row_number() OVER (PARTITION BY grp ORDER BY m DESC) <= 36)"


@query(f'WITH {PATTERN_EVENTS}, {MONTHS} SELECT grp AS "group", atx AS "at" FROM months')
def an_months(spark, sf_dir):
    return month_points(pattern_events(spark, sf_dir))


def month_points(events_: DataFrame) -> DataFrame:
    spans = events_.groupBy("group").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    return spans.select("group", F.explode(patterns.month_starts(F.col("a"), F.col("b"))).alias("at"))


# People

PEOPLE = "people AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 9 = 0 THEN ' ' || upper(p_name) || (p_partkey % 4) || '@x ' END AS email, CASE WHEN p_size % 2 = 0 THEN 'hr' ELSE 'drive' END AS band FROM part)"


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    email = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit(" "), F.upper("p_name"), (F.col("p_partkey") % 4).cast("string"), F.lit("@x ")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), email.alias("email"), F.when(F.col("p_size") % 2 == 0, "hr").otherwise("drive").alias("band"))


@query()
def id_groups(spark, sf_dir):
    """Every person, in groups: the pairs of ``id_pair`` over the whole table without a row for each."""
    return people.identity_groups(persons(spark, sf_dir))


PAIRS = f"""WITH {PEOPLE}, k AS (SELECT id, band, 'email' AS tier, [lower(trim(email))] AS key FROM people WHERE email IS NOT NULL
UNION ALL SELECT id, band, 'name', parts FROM (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '[\\s._-]+'), lambda x: x <> ''))) AS parts FROM people) WHERE len(parts) >= 2),
firsts AS (SELECT tier, key, band, min(id) AS id FROM k GROUP BY ALL),
pairs AS (SELECT a.id AS a, b.id AS b, min(tier) AS tier FROM firsts a JOIN firsts b USING (tier, key) WHERE a.id < b.id AND a.band <> b.band GROUP BY a.id, b.id)"""


@query(PAIRS + " SELECT * FROM pairs")
def id_pair(spark, sf_dir):
    return people.identity_pairs(persons(spark, sf_dir))


@query(PAIRS + " SELECT * FROM pairs WHERE tier = 'email' AND NOT (a % 2 = 0)")
def id_select(spark, sf_dir):
    pairs = people.identity_pairs(persons(spark, sf_dir))
    return people.undecided(pairs, pairs.where("a % 2 = 0").select("a", "b")).where("tier = 'email'")




@query("SELECT c_custkey AS id, (SELECT min(c_custkey) FROM customer) AS root FROM customer UNION ALL SELECT max(c_custkey) + 1, min(c_custkey) FROM customer")
def join_closure(spark, sf_dir):
    """Every customer is linked with the next one: one path, as long as the table."""
    return graph.closure(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b")))


DOCS = """WITH g AS (SELECT DISTINCT l_partkey AS doc, l_suppkey AS person FROM lineitem), act AS (SELECT s_suppkey AS person, s_nationkey % 3 AS project FROM supplier),
roots AS (SELECT s_suppkey AS id, min(s_suppkey) OVER (PARTITION BY s_suppkey // 2) AS root FROM supplier),
met AS (SELECT DISTINCT doc, g.person, project FROM g JOIN roots ON roots.id = g.person JOIN (SELECT root, project FROM act JOIN roots ON roots.id = person) a USING (root)),
r AS (SELECT doc, count(DISTINCT person) AS resolved FROM met GROUP BY doc HAVING count(DISTINCT person) >= 3),
c AS (SELECT doc, project, count(*) AS support, resolved FROM met JOIN r USING (doc) GROUP BY doc, project, resolved HAVING count(*) / resolved >= 0.5)
SELECT doc, project, support, resolved, CASE WHEN support = resolved THEN 'high' ELSE 'ambiguous' END AS tier FROM c"""


@query(DOCS)
def in_docproj(spark, sf_dir):
    """Suppliers next to each other by number are one person."""
    grants = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc"), F.col("l_suppkey").alias("person")).distinct()
    activity = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person"), (F.col("s_nationkey") % 3).alias("project"))
    pairs = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select((F.col("s_suppkey") - 1).alias("id"), F.col("s_suppkey").alias("other"))
    return people.document_projects(grants, activity, pairs.union(pairs.select("other", "id")))


@query("""WITH p AS (SELECT s_suppkey AS x, s_suppkey // 5 AS blk, s_suppkey % 5 AS k, s_nationkey AS n FROM supplier),
a AS (SELECT blk, k, n % 3 AS project FROM p WHERE k IN (0, 3)),
w AS (SELECT p.x, a.project, p.blk * 5 + a.k AS via, least(abs(p.k - a.k), 5 - abs(p.k - a.k)) AS steps, a.k FROM p JOIN a USING (blk))
SELECT x AS person, project, via, steps FROM w QUALIFY row_number() OVER (PARTITION BY x, project ORDER BY steps, k) = 1""")
def in_via(spark, sf_dir):
    """Suppliers by five are accounts of one person in a ring, of which two are active: the nearer one, of equals by the
    lesser neighbour."""
    k, s = F.col("s_suppkey") % 5, table(spark, sf_dir, "supplier")
    ring = s.select(F.col("s_suppkey").alias("id"), F.when(k == 4, F.col("s_suppkey") - 4).otherwise(F.col("s_suppkey") + 1).alias("other"))
    activity = s.where(k.isin(0, 3)).select(F.col("s_suppkey").alias("person"), (F.col("s_nationkey") % 3).alias("project"))
    return people.nearest_accounts(activity, ring.union(ring.select("other", "id"))).withColumn("steps", F.col("steps").cast("long"))


STATE = f"""{PAIRS}, nk AS (SELECT id, band, key FROM k WHERE tier = 'name'), ev AS (SELECT id, min(id) OVER (PARTITION BY key) AS root FROM nk QUALIFY min(band) OVER (PARTITION BY key) <> max(band) OVER (PARTITION BY key)),
nx AS (SELECT id, lead(id) OVER (PARTITION BY root ORDER BY id) AS b, root FROM ev), st AS (SELECT id AS a, b FROM nx WHERE b IS NOT NULL AND id % 3 <> 0 UNION ALL SELECT id, id + 1000000 FROM people WHERE id % 50 = 7),
pt AS (SELECT id, root, sum(cut) OVER (PARTITION BY root ORDER BY id) AS part FROM (SELECT id, root, CASE WHEN lag(id) OVER (PARTITION BY root ORDER BY id) % 3 = 0 THEN 1 ELSE 0 END AS cut FROM ev)),
ld AS (SELECT root, part, min(id) AS lead FROM pt GROUP BY ALL)"""


@query(STATE + """ SELECT a, b, CASE WHEN b = a + 1000000 THEN 'unfounded' ELSE 'confirmed' END AS state FROM st
UNION ALL SELECT root, lead, CASE WHEN lead % 10 = 0 THEN 'dismissed' ELSE 'open' END FROM ld WHERE lead <> root""")
def id_state(spark, sf_dir):
    """All of part are persons; what is stored links most of them with the next one of their name, and some with strangers, who
    are no persons of the table however long it is: while states are found, their ids lie beyond its own."""
    c, beyond = F.col, 10**15
    groups = graph.checkpointed(people.evidence_groups(persons(spark, sf_dir)))
    follows = groups.withColumn("b", F.lead("id").over(Window.partitionBy("root").orderBy("id"))).where("b is not null and id % 3 != 0").select(c("id").alias("a"), "b")
    strangers = table(spark, sf_dir, "part").where("p_partkey % 50 = 7").select(c("p_partkey").alias("a"), (c("p_partkey") + 10**6 + beyond).alias("b"))
    gone = groups.where("id % 10 = 0").select(c("id").alias("a"), c("root").alias("b"))
    return people.identity_state(groups, follows.union(strangers), gone).withColumn("b", F.when(c("b") > beyond, c("b") - beyond).otherwise(c("b")))


@query("SELECT o_custkey AS person, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS assigned, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS authored, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS reviewed FROM orders GROUP BY o_custkey")
def ag_ctx(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "assigned").when(F.col("o_orderstatus") == "O", "authored").when(F.col("o_orderstatus") == "P", "reviewed")
    return people.approver_context(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), kind.alias("kind")))


@query(f"WITH {TIERS} SELECT id, label AS observed, (id % 4)::INTEGER AS required FROM tiers WHERE label < id % 4")
def cf_access(spark, sf_dir):
    some = tiers(spark, sf_dir)
    return people.overshared(some.select("id", F.col("label").alias("observed")), some.select("id", (F.col("id") % 4).cast("int").alias("required")))


RANK = """WITH skill AS (SELECT l_suppkey AS candidate, p_type AS skill, sum(l_quantity)::BIGINT AS level FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
req AS (SELECT DISTINCT p_brand AS subject, p_type AS skill FROM part), busy AS (SELECT l_suppkey AS candidate, count(*) AS allocation FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
met AS (SELECT subject, candidate, count(*) AS overlap, sum(level)::BIGINT AS strength FROM req JOIN skill USING (skill) GROUP BY ALL)
SELECT subject, candidate, overlap, strength, coalesce(allocation, 0) AS busyness, strength - coalesce(allocation, 0) / 10 AS score FROM met LEFT JOIN busy USING (candidate)"""


@query(RANK)
def py_rank(spark, sf_dir):
    """Suppliers by how well what they delivered fits the types of a brand's parts."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_linestatus")
    required = part.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("skill")).distinct()
    levels = line.join(part.select("p_partkey", F.col("p_type").alias("skill")), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("candidate"), "skill").agg(F.sum("l_quantity").cast("long").alias("level"))
    busy = line.where("l_linestatus = 'O'").groupBy(F.col("l_suppkey").alias("candidate")).agg(F.count(F.lit(1)).alias("allocation"))
    return people.fit_ranking(required, levels, busy)


@query(RANK + " QUALIFY row_number() OVER (PARTITION BY subject ORDER BY score DESC, strength DESC, candidate) <= 5")
def sc_score(spark, sf_dir):
    """The five best of each brand."""
    from pyspark.sql import Window

    ranked = py_rank(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("score"), F.desc("strength"), "candidate")))
    return ranked.where("r <= 5").drop("r")


# Derived relations

DERIVED = "SELECT DISTINCT o_orderkey AS start, n_regionkey::BIGINT AS \"end\" FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"


def paths(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    pick = lambda t, a, b: table(spark, sf_dir, t).select(F.col(a).cast("long").alias("subject"), F.col(b).cast("long").alias("object"))
    return {"ordered-by": pick("orders", "o_orderkey", "o_custkey"), "lives-in": pick("customer", "c_custkey", "c_nationkey"), "part-of": pick("nation", "n_nationkey", "n_regionkey")}


@query(DERIVED)
def dr_eval(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return graph.evaluate(paths(spark, sf_dir), [graph.Hop("ordered-by"), graph.Hop("lives-in"), graph.Hop("part-of")], starts)


@query("SELECT DISTINCT n_regionkey::BIGINT AS start, c_custkey AS \"end\" FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dr_eval_reverse(spark, sf_dir):
    starts = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    return graph.evaluate(paths(spark, sf_dir), [graph.Hop("part-of", True), graph.Hop("lives-in", True)], starts)


# The shared model, on small declared tables

DECLARED = [("ordered-by", "orders.o_custkey", "Order", "Customer", "one", 1), ("lives-in", "customer.c_nationkey", "Customer", "Nation", "one", 2), ("part-of", "nation.n_regionkey", "Nation", "Region", "one", 3), ("delivers", "lineitem", "Supplier", "Part", "many", 4), ("segment", "customer.c_mktsegment", "Customer", "Text", "one", 5), ("based-in", "supplier.s_nationkey", "Supplier", "Nation", "one", 6), ("sold-by", "lineitem", "Part", "Supplier", "many", 7)]
PRED_SQL = "p(name, source, \"from\", \"to\", cardinality, ord) AS (VALUES " + ", ".join(str(r) for r in DECLARED) + ")"
TYPES = ["Order", "Customer", "Nation", "Region", "Supplier", "Part"]
TYPE_SQL = "types(name) AS (VALUES " + ", ".join(f"('{t}')" for t in TYPES) + ")"
DECL_SQL = f"{PRED_SQL}, {TYPE_SQL}, d AS (SELECT p.name, \"from\" AS domain, CASE WHEN t.name IS NULL THEN 'text' ELSE \"to\" END AS range, CASE WHEN t.name IS NULL THEN 'value' ELSE 'entity' END AS kind, cardinality FROM p LEFT JOIN types t ON t.name = p.\"to\")"


def declared(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECLARED, "name string, source string, `from` string, `to` string, cardinality string, ord int")


def declarations(spark: SparkSession) -> DataFrame:
    return catalog.declarations(declared(spark), spark.createDataFrame([(t,) for t in TYPES], "name string"))


@query(f"WITH {DECL_SQL} SELECT * FROM d")
def md_decl(spark, sf_dir):
    return declarations(spark)


@query(f"WITH {DECL_SQL} SELECT name, 'cardinality one is not many; range ' || range || ' is not text' AS message FROM d WHERE name = 'lives-in'")
def md_conflicts(spark, sf_dir):
    some = declarations(spark)
    changed = some.where("name = 'lives-in'").withColumn("cardinality", F.lit("many")).withColumn("range", F.lit("text"))
    return catalog.conflicts(some, changed.unionByName(some.where("name = 'segment'")))


@query(f"WITH {DECL_SQL} SELECT * FROM d WHERE name IN ('segment', 'delivers')")
def md_additions(spark, sf_dir):
    some = declarations(spark)
    return catalog.additions(some.where("name not in ('segment', 'delivers')"), some.unionByName(some))


@query(f"WITH {DECL_SQL} SELECT * FROM d")
def md_append(spark, sf_dir):
    some = declarations(spark)
    return catalog.appended(some.where("name != 'segment'"), some)


@query(f"WITH {PRED_SQL} SELECT name, source FROM p")
def md_bind(spark, sf_dir):
    return catalog.bindings(declared(spark))


@query(f"WITH {DECL_SQL} SELECT d.*, p.source FROM d JOIN p USING (name)")
def md_compose(spark, sf_dir):
    return catalog.composed(declarations(spark), catalog.bindings(declared(spark)))


@query(f"WITH {PRED_SQL} SELECT name, CASE WHEN name = 'segment' THEN 'removed' ELSE 'cardinality' END AS change FROM p WHERE name IN ('segment', 'part-of') UNION ALL SELECT 'new', 'added'")
def md_corr(spark, sf_dir):
    some = declared(spark).drop("ord")
    new = spark.createDataFrame([("new", "x", "A", "B", "one")], some.schema)
    confirmed = some.where("name != 'segment'").withColumn("cardinality", F.when(F.col("name") == "part-of", "many").otherwise(F.col("cardinality")))
    return catalog.corrections(some, confirmed.unionByName(new))


@query(f"WITH {PRED_SQL} SELECT CASE WHEN a.name = b.name THEN 'skip-level-' || regexp_replace(a.name, '-of$', '') ELSE a.name || '-then-' || b.name END AS name, a.name AS first, b.name AS second, a.\"from\" AS \"from\", b.\"to\" AS \"to\", CASE WHEN a.cardinality = 'one' AND b.cardinality = 'one' THEN 'one' ELSE 'many' END AS cardinality FROM p a JOIN p b ON b.\"from\" = a.\"to\" ORDER BY cardinality DESC, a.ord, b.ord LIMIT 6")
def dr_compose(spark, sf_dir):
    return graph.compositions(declared(spark))


RUNS = "g AS (SELECT event_type AS lane, epoch(date_trunc('day', ts))::BIGINT AS run_no, count(*) AS facts, count(DISTINCT user_id) AS events FROM events GROUP BY ALL), r AS (SELECT *, CASE WHEN run_no % 172800 <> 0 THEN facts % 7 END AS suppressed FROM g), defs(lane, ingested) AS (VALUES ('click', 5), ('idle', 3))"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.unix_seconds(F.date_trunc("day", F.col("ts").cast("timestamp")))
    some = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lane"), day.alias("run_no")).agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("user_id").alias("events"))
    return some.withColumn("suppressed", F.when(F.col("run_no") % 172800 != 0, F.col("facts") % 7))


@query(f"WITH {RUNS}, s AS (SELECT lane, sum(facts) AS f, sum(events) AS o FROM r GROUP BY lane), l AS (SELECT lane, suppressed FROM r QUALIFY row_number() OVER (PARTITION BY lane ORDER BY run_no DESC) = 1) SELECT coalesce(defs.lane, s.lane) AS lane, (coalesce(ingested, 0) + coalesce(f, 0))::BIGINT AS facts, o::BIGINT AS observed, suppressed::BIGINT AS suppressed FROM defs FULL JOIN s ON s.lane = defs.lane LEFT JOIN l ON l.lane = s.lane")
def ag_lane(spark, sf_dir):
    return catalog.lanes(spark.createDataFrame([("click", 5), ("idle", 3)], "lane string, ingested long"), runs(spark, sf_dir))


@query(f"WITH {RUNS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY lane ORDER BY run_no DESC) <= 50")
def snk_runs(spark, sf_dir):
    return catalog.recent_runs(runs(spark, sf_dir))


@query(f"SELECT {HASH_SQL.format(chr(39) + 'labels|' + chr(39) + ' || doc_id || ' + chr(39) + '|7|r' + chr(39) + ' || doc_id % 2')} + 3096224743817216 AS id, doc_id::VARCHAR AS key FROM labels")
def rr_record(spark, sf_dir):
    return records(spark, sf_dir).select("id", "key")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    rows = table(spark, sf_dir, "labels").select(lit("labels").alias("surface"), F.col("doc_id").cast("string").alias("key"), lit("ok").alias("decision"), lit("p").alias("proposal"), lit("").alias("evidence"), F.concat(lit("r"), F.col("doc_id") % 2).alias("reviewer"), lit("n").alias("note"), lit(7).alias("at"))
    return catalog.review_records(rows)


@query(f"WITH r AS (SELECT {HASH_SQL.format(chr(39) + 'labels|' + chr(39) + ' || doc_id || ' + chr(39) + '|7|r' + chr(39) + ' || doc_id % 2')} + 3096224743817216 AS subject, doc_id FROM labels) SELECT subject, unnest(['review-surface', 'review-decision', 'review-proposal', 'review-reviewer', 'review-note', 'review-of-document']) AS predicate, unnest(['labels', 'ok', 'p', 'r' || doc_id % 2, 'n', doc_id::VARCHAR]) AS object, 7 AS valid_from FROM r")
def rr_facts(spark, sf_dir):
    made = records(spark, sf_dir)
    return catalog.review_facts(made, made.select("id", F.lit("document").alias("kind"), F.col("key").cast("long").alias("node")))


# Texts are cut into sentences with their ends. The first phrase counts that a sentence holds which isn't asked, before any
# denial in it; these phrases and denials are words of the invented prose or of English.
PHRASES = {"formal": ("the", "des"), "softer": ("and", "von")}
CONSENT = r"""se AS (SELECT id, unnest(regexp_extract_all(text, '[^。.!?！？\n]*[。.!?！？\n]?')) AS s FROM co WHERE text IS NOT NULL),
ph(o, tier, phrase) AS (VALUES (1, 'formal', 'the'), (2, 'formal', 'des'), (3, 'euphemism', 'and'), (4, 'euphemism', 'von')),
ap AS (SELECT id, tier, phrase FROM se JOIN ph ON regexp_matches(split_part(regexp_replace(s, '(?i)\b(not|never|cannot|can''?t|don''?t|doesn''?t|didn''?t|won''?t|isn''?t|wouldn''?t|shouldn''?t|unless|if)\b', chr(1)), chr(1), 1), '(?i)\b' || phrase || '\b') AND NOT (s LIKE '%?' OR s LIKE '%？') QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1)"""


@query(f"WITH co AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), {CONSENT} SELECT * FROM ap")
def ap_match(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return people.approvals(c, **PHRASES).drop("snippet")


DDL = """CREATE TABLE region (r_regionkey INT PRIMARY KEY, r_name TEXT); -- five rows
CREATE TABLE nation (n_nationkey INT PRIMARY KEY, n_name TEXT, n_regionkey INT REFERENCES region(r_regionkey));
CREATE TABLE supplies (s INT REFERENCES supplier(id), p INT REFERENCES part(id), PRIMARY KEY (s, p));"""


@query("SELECT * FROM (VALUES ('region', 'r_regionkey', 'INT', true, NULL, false), ('region', 'r_name', 'TEXT', false, NULL, false), ('nation', 'n_nationkey', 'INT', true, NULL, false), ('nation', 'n_name', 'TEXT', false, NULL, false), ('nation', 'n_regionkey', 'INT', false, 'region.r_regionkey', false), ('supplies', 's', 'INT', true, 'supplier.id', true), ('supplies', 'p', 'INT', true, 'part.id', true)) t(\"table\", \"column\", type, pk, ref, is_link)")
def src_ddl(spark, sf_dir):
    return schemas.catalog(spark, DDL)


from . import ingest, lanes, reviews, rules  # noqa: E402, F401  (add their queries)
