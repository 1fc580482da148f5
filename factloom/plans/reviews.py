"""Scans, candidates and verdicts over one fact log made of the driver's tables, claims and scores, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, facts, graph, people, review
from ..sources import events as sources
from .queries import CONSENT, HASH_SQL, PHRASES, query, seconds, table

PERSON, PROJECT, ISSUE, COMMENT = (k * 10**12 for k in (1, 2, 3, 4))
DOCUMENT, FOLDER, DRIVE = (k * 2**48 for k in (5, 6, 7))

# Orders are issues of a nation's project, turns of conversations comments on them, parts documents in folders by size.
ACTIVITY = f"""o AS (SELECT o_orderkey AS k, c_nationkey AS n, floor(epoch(o_orderdate))::BIGINT AS tm FROM orders JOIN customer ON c_custkey = o_custkey),
t AS (SELECT {COMMENT} + conv_id * 1000 + turn AS id, conv_id, turn, text, conv_id * 3600 + turn + 1 AS tm FROM conversations),
fa(subject, predicate, object, valid_from) AS (
SELECT {ISSUE} + k, 'in-project', ({PROJECT} + n)::VARCHAR, tm FROM o
UNION ALL SELECT {ISSUE} + k, 'assigned-to', ({PERSON} + n * 10 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END)::VARCHAR, tm FROM o WHERE k % 50 <> 7
UNION ALL SELECT {ISSUE} + k, 'created-by', ({PERSON} + n * 10 + k % 3)::VARCHAR, tm FROM o
UNION ALL SELECT {ISSUE} + k, 'approved-by', ({PERSON} + 1)::VARCHAR, tm FROM o WHERE k % 4 = 0
UNION ALL SELECT id, 'on-issue', ({ISSUE} + conv_id)::VARCHAR, tm FROM t
UNION ALL SELECT id, 'commented-by', ({PERSON} + CASE WHEN turn % 7 = 6 THEN 2 ELSE 1 END)::VARCHAR, tm FROM t
UNION ALL SELECT id, 'content', text, tm FROM t
UNION ALL SELECT {DOCUMENT} + p_partkey, 'in-folder', ({FOLDER} + p_size)::VARCHAR, p_partkey + 1 FROM part
UNION ALL SELECT DISTINCT {DOCUMENT} + l_partkey, 'can-access', ({DRIVE} + l_suppkey)::VARCHAR, 1 FROM lineitem
UNION ALL SELECT {DOCUMENT} + p_partkey, 'can-access', ({DRIVE} + 1000000 + p_size)::VARCHAR, 1 FROM part WHERE p_partkey % 10 <> 1
UNION ALL SELECT {DOCUMENT} + p_partkey, 'can-access', ({DRIVE} + 9999999)::VARCHAR, 1 FROM part WHERE p_partkey % 20 <> 3
UNION ALL SELECT {PROJECT} + n_nationkey, 'project-name', n_name, 1 FROM nation
UNION ALL SELECT {PERSON} + n_nationkey * 10 + j, 'name', n_name || ' Lead ' || j, 1 FROM nation, range(3) r(j)
UNION ALL SELECT {PERSON} + n_nationkey * 10, 'email', 'lead' || n_nationkey || '@x', 1 FROM nation
UNION ALL SELECT {DRIVE} + n_nationkey, 'name', 'lead.' || n_name || ' 0', 1 FROM nation
UNION ALL SELECT {DRIVE} + n_nationkey, 'email', ' LEAD' || n_nationkey || '@X', 1 FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT {PERSON} + n_nationkey * 10, 'same-as', ({DRIVE} + n_nationkey)::VARCHAR, 1 FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT {PERSON} + 1, 'same-as', ({DRIVE} + n_nationkey)::VARCHAR, 1 FROM nation WHERE n_nationkey % 6 IN (1, 5))"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: every write once, but for assignees of some orders, which are cleared a day later."""
    c, lit = F.col, F.lit
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("k"), c("c_nationkey").alias("n"), seconds("o_orderdate").alias("at"))
    t = table(spark, sf_dir, "conversations").select((c("conv_id") * 1000 + c("turn") + COMMENT).alias("id"), "conv_id", "turn", "text", (c("conv_id") * 3600 + c("turn") + 1).alias("at"))
    one = lit(1)

    def wrote(rows, subject, predicate, obj, at, op="assert", seq=0):
        return rows.select(lit(seq).cast("long").alias("seq"), lit(op).alias("op"), subject.cast("long").alias("subject"), lit(predicate).alias("predicate"), obj.cast("string").alias("object"), at.cast("long").alias("valid_from"), lit(None).cast("long").alias("valid_to"))

    person = F.when(c("k") % 12 == 0, 1).otherwise(0) + c("n") * 10 + PERSON
    leads = nation.select("n_nationkey", "n_name", F.explode(F.array(lit(0), lit(1), lit(2))).alias("j"))
    doc, lead, drive = c("p_partkey") + DOCUMENT, c("n_nationkey") * 10 + PERSON, c("n_nationkey") + DRIVE
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return graph.union_all([
        wrote(o, c("k") + ISSUE, "in-project", c("n") + PROJECT, c("at")),
        wrote(o, c("k") + ISSUE, "assigned-to", person, c("at")),
        wrote(o.where("k % 50 = 7"), c("k") + ISSUE, "assigned-to", lit(None), c("at") + 86400, "close", 1),
        wrote(o, c("k") + ISSUE, "created-by", c("n") * 10 + c("k") % 3 + PERSON, c("at")),
        wrote(o.where("k % 4 = 0"), c("k") + ISSUE, "approved-by", lit(PERSON + 1), c("at")),
        wrote(t, c("id"), "on-issue", c("conv_id") + ISSUE, c("at")),
        wrote(t, c("id"), "commented-by", F.when(c("turn") % 7 == 6, 2).otherwise(1) + lit(PERSON), c("at")),
        wrote(t, c("id"), "content", c("text"), c("at")),
        wrote(part, doc, "in-folder", c("p_size") + FOLDER, c("p_partkey") + 1),
        wrote(lines, c("l_partkey") + DOCUMENT, "can-access", c("l_suppkey") + DRIVE, one),
        wrote(part.where("p_partkey % 10 != 1"), doc, "can-access", c("p_size") + (DRIVE + 10**6), one),
        wrote(part.where("p_partkey % 20 != 3"), doc, "can-access", lit(DRIVE + 9999999), one),
        wrote(nation, c("n_nationkey") + PROJECT, "project-name", c("n_name"), one),
        wrote(leads, c("n_nationkey") * 10 + c("j") + PERSON, "name", F.concat(c("n_name"), lit(" Lead "), c("j")), one),
        wrote(nation, lead, "email", F.concat(lit("lead"), c("n_nationkey"), lit("@x")), one),
        wrote(nation, drive, "name", F.concat(lit("lead."), c("n_name"), lit(" 0")), one),
        wrote(nation.where("n_nationkey % 2 = 0"), drive, "email", F.concat(lit(" LEAD"), c("n_nationkey"), lit("@X")), one),
        wrote(nation.where("n_nationkey % 3 = 0"), lead, "same-as", drive, one),
        wrote(nation.where("n_nationkey % 6 in (1, 5)"), lit(PERSON + 1), "same-as", drive, one),
    ])


# Patterns

EVENTS = f"""{ACTIVITY}, pr AS (SELECT subject AS id, object::BIGINT AS grp FROM fa WHERE predicate = 'in-project'),
ev AS (
SELECT 'issue-assignee' AS template, grp, id, a.object::BIGINT AS t, coalesce(a.valid_from, 0) AS tm FROM pr LEFT JOIN fa a ON a.subject = id AND a.predicate = 'assigned-to'
UNION ALL SELECT 'comment-author', pr.grp, i.subject, a.object::BIGINT, coalesce(a.valid_from, 0) FROM fa i JOIN pr ON pr.id = i.object::BIGINT LEFT JOIN fa a ON a.subject = i.subject AND a.predicate = 'commented-by' WHERE i.predicate = 'on-issue'
UNION ALL SELECT 'doc-access', f.object::BIGINT, f.subject, a.object::BIGINT, f.valid_from FROM fa f LEFT JOIN fa a ON a.subject = f.subject AND a.predicate = 'can-access' WHERE f.predicate = 'in-folder')"""


@query(f"WITH {EVENTS} SELECT template, grp AS \"group\", id, coalesce(string_agg(t, ',' ORDER BY t), '') AS targets, max(tm) AS \"at\" FROM ev GROUP BY template, grp, id")
def an_scan(spark, sf_dir):
    rows = review.event_groups(activity(spark, sf_dir))
    return rows.withColumn("targets", F.array_join(F.col("targets").cast("array<string>"), ","))


CANDIDATES = f"""{EVENTS}, docs AS (SELECT count(DISTINCT id) AS total, min(tm) AS a, max(tm) AS b FROM ev WHERE template = 'doc-access'),
scope AS (SELECT t, count(*) AS support, total, a, b FROM ev, docs WHERE template = 'doc-access' AND t IS NOT NULL GROUP BY ALL HAVING count(*) / total >= 0.9),
own AS (SELECT template, grp, id, tm, CASE WHEN template = 'doc-access' AND t IN (SELECT t FROM scope) THEN NULL ELSE t END AS t FROM ev),
sizes AS (SELECT template, grp, count(DISTINCT id) AS total, coalesce(min(tm) FILTER (tm > 0), 0) AS a, coalesce(max(tm) FILTER (tm > 0), 0) AS b FROM own GROUP BY ALL HAVING count(DISTINCT id) >= 10),
n1 AS (SELECT template, grp, t AS first, count(*) AS g1 FROM own WHERE t IS NOT NULL GROUP BY template, grp, t QUALIFY row_number() OVER (PARTITION BY template, grp ORDER BY count(*) DESC, t) = 1),
one AS (SELECT * FROM sizes JOIN n1 USING (template, grp)),
rest AS (SELECT o.template, o.grp, o.id, o.t FROM own o JOIN one USING (template, grp) WHERE g1 / total < 0.8 AND NOT EXISTS (SELECT 1 FROM own x WHERE x.template = o.template AND x.id = o.id AND x.t = first)),
n2 AS (SELECT template, grp, t AS second, count(*) AS g2 FROM rest WHERE t IS NOT NULL GROUP BY template, grp, t QUALIFY row_number() OVER (PARTITION BY template, grp ORDER BY count(*) DESC, t) = 1),
found AS (SELECT template, grp, first, second, g1 + coalesce(g2, 0) AS support, total, a, b FROM one LEFT JOIN n2 USING (template, grp) WHERE (g1 + coalesce(g2, 0)) / total >= 0.8),
missed AS (SELECT template, grp, id, row_number() OVER (PARTITION BY template, grp ORDER BY id) AS r FROM (SELECT o.template, o.grp, o.id FROM own o JOIN found f USING (template, grp) GROUP BY ALL HAVING count(*) FILTER (o.t = f.first OR o.t = f.second) = 0)),
ex AS (SELECT template, grp, string_agg(id, ',' ORDER BY id) FILTER (r <= 20) AS exceptions, greatest(count(*) - 20, 0) AS omitted FROM missed GROUP BY ALL),
wide AS (SELECT t, string_agg(id, ',' ORDER BY id) FILTER (r <= 20) AS exceptions, greatest(count(*) - 20, 0) AS omitted FROM (SELECT s.t, d.id, row_number() OVER (PARTITION BY s.t ORDER BY d.id) AS r FROM scope s, (SELECT DISTINCT id FROM ev WHERE template = 'doc-access') d WHERE NOT EXISTS (SELECT 1 FROM ev x WHERE x.id = d.id AND x.t = s.t)) GROUP BY t),
every AS (
SELECT 'doc-access-scope' AS template, t AS grp, t AS first, NULL::BIGINT AS second, support, total, coalesce(exceptions, '') AS exceptions, coalesce(omitted, 0) AS omitted, a AS window_from, b AS window_to FROM scope LEFT JOIN wide USING (t)
UNION ALL SELECT template, grp, first, second, support, total, coalesce(exceptions, ''), coalesce(omitted, 0), a, b FROM found LEFT JOIN ex USING (template, grp)),
named AS (SELECT *, CASE template WHEN 'issue-assignee' THEN 'assigned-to' WHEN 'comment-author' THEN 'commented-by' ELSE 'can-access' END AS predicate FROM every),
cands AS (SELECT *, 'p' || lower(to_hex({HASH_SQL.format("(template || '|' || grp || '|' || predicate)")})) AS pattern_id FROM named)"""


@query(f"WITH {CANDIDATES} SELECT pattern_id, template, grp AS \"group\", predicate, first, second, support, total, exceptions, omitted, window_from, window_to FROM cands WHERE grp % 11 <> 5")
def an_cands(spark, sf_dir):
    """Candidates, best covered first; of some groups they were dismissed."""
    found = graph.checkpointed(review.pattern_candidates(review.event_groups(graph.checkpointed(activity(spark, sf_dir)))))
    open_ = found.join(found.where(F.col("group") % 11 == 5).select("pattern_id"), "pattern_id", "left_anti")
    return open_.orderBy(*review.pattern_order()).select("pattern_id", "template", "group", "predicate", "first", "second", "support", "total", "exceptions", "omitted", "window_from", "window_to")


@query(f"""WITH {CANDIDATES}, v AS (SELECT *, CASE WHEN support % 2 = 0 THEN 'rule' ELSE 'risk' END AS kind FROM cands),
nm AS (SELECT subject AS id, object AS name FROM fa WHERE predicate IN ('name', 'project-name')),
w AS (SELECT {HASH_SQL.format("(kind || ':' || pattern_id)")} + 2814749767106560 AS subject, kind, support, total, first, second, window_to, coalesce(g.name, grp::VARCHAR) || ': ' || predicate || ' → ' || coalesce(f.name, first::VARCHAR) || CASE WHEN second IS NULL THEN '' ELSE ', ' || coalesce(s.name, second::VARCHAR) END || ' (' || support || '/' || total || ')' AS title FROM v LEFT JOIN nm g ON g.id = grp LEFT JOIN nm f ON f.id = first LEFT JOIN nm s ON s.id = second)
SELECT subject, kind || '-title' AS predicate, title AS object, window_to AS valid_from, 'pattern-review' AS source FROM w
UNION ALL SELECT subject, kind || '-support', support::VARCHAR, window_to, 'pattern-review' FROM w
UNION ALL SELECT subject, kind || '-total', total::VARCHAR, window_to, 'pattern-review' FROM w
UNION ALL SELECT subject, kind || '-target', first::VARCHAR, window_to, 'pattern-review' FROM w
UNION ALL SELECT subject, kind || '-target', second::VARCHAR, window_to, 'pattern-review' FROM w WHERE second IS NOT NULL""")
def an_verdict(spark, sf_dir):
    log = activity(spark, sf_dir)
    found = review.pattern_candidates(review.event_groups(log))
    return review.pattern_facts(found.withColumn("verdict", F.when(F.col("support") % 2 == 0, "promote").otherwise("risk")), review.display_names(log))


# Identities

IDENTITIES = f"""{ACTIVITY}, pp AS (SELECT n.subject AS id, lower(trim(e.object)) AS mail, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(n.object), '[\\s._-]+'), lambda x: x <> ''))) AS parts, CASE WHEN n.subject >= {DRIVE} THEN 'drive' ELSE 'issues' END AS band FROM fa n LEFT JOIN fa e ON e.subject = n.subject AND e.predicate = 'email' WHERE n.predicate = 'name'),
ky AS (SELECT id, band, 'email' AS tier, [mail] AS key FROM pp WHERE mail IS NOT NULL UNION ALL SELECT id, band, 'name', parts FROM pp WHERE len(parts) >= 2),
fs AS (SELECT tier, key, band, min(id) AS id FROM ky GROUP BY ALL),
pq AS (SELECT a.id AS a, b.id AS b, min(tier) AS tier FROM fs a JOIN fs b USING (tier, key) WHERE a.id < b.id AND a.band <> b.band GROUP BY a.id, b.id),
ip AS (SELECT a, b, tier, EXISTS (SELECT 1 FROM fa WHERE predicate = 'same-as' AND subject = a AND object = b::VARCHAR) AS confirmed, a % 70 = 10 AND b = (a - {PERSON}) // 10 + {DRIVE} AS dismissed FROM pq)"""


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity(spark, sf_dir)
    gone = review.persons(log).where("id % 70 = 10").select(F.col("id").alias("b"), (((F.col("id") - PERSON) / 10).cast("long") + DRIVE).alias("a"))
    return review.identity_candidates(log, gone)


@query(f"WITH {IDENTITIES} SELECT a, b, tier, confirmed FROM ip")
def id_find(spark, sf_dir):
    return identities(spark, sf_dir).select("a", "b", "tier", "confirmed")


@query(f"WITH {IDENTITIES} SELECT a, b, CASE WHEN confirmed THEN 2 WHEN dismissed THEN 4 ELSE 0 END + CASE WHEN tier = 'email' THEN 0 ELSE 1 END AS rank FROM ip")
def id_rank(spark, sf_dir):
    return identities(spark, sf_dir).select("a", "b", "rank").orderBy("rank")


@query(f"""WITH {IDENTITIES}, c AS (SELECT a, b FROM ip WHERE tier = 'email' AND NOT confirmed AND NOT dismissed), s AS (SELECT unnest([a, b]) AS subject FROM c)
SELECT a AS subject, 'same-as' AS predicate, b::VARCHAR AS object, 'identity-review' AS source FROM c
UNION ALL SELECT subject, 'identity-review', 'confirmed', 'identity-review' FROM s UNION ALL SELECT subject, 'identity-reviewed-by', 'policy', 'identity-review' FROM s UNION ALL SELECT subject, 'identity-review-note', 'equal e-mails', 'identity-review' FROM s""")
def id_confirm(spark, sf_dir):
    """What the policy on equal e-mails confirms."""
    chosen = review.policy_targets(identities(spark, sf_dir)).select("a", "b", F.lit("policy").alias("reviewer"), F.lit("equal e-mails").alias("note"))
    return review.identity_facts(chosen).drop("valid_from")


# Approvals: with phrases that the invented conversations hold

FOUND = f"""{ACTIVITY}, co AS (SELECT subject AS id, object AS text, valid_from AS tm FROM fa WHERE predicate = 'content'), {CONSENT},
cd AS (SELECT ap.id AS comment, i.object::BIGINT AS issue, b.object::BIGINT AS approver, n.object AS approver_name, NULL::VARCHAR AS summary, co.tm AS "at", ap.phrase, ap.tier, coalesce(y.object = b.object, false) AS confirmed, ap.id % 10 = 3 AS dismissed
FROM ap JOIN co USING (id) JOIN fa i ON i.subject = ap.id AND i.predicate = 'on-issue' JOIN fa b ON b.subject = ap.id AND b.predicate = 'commented-by' LEFT JOIN fa n ON n.subject = b.object::BIGINT AND n.predicate = 'name' LEFT JOIN fa y ON y.subject = i.object::BIGINT AND y.predicate = 'approved-by'),
rk AS (SELECT *, CASE WHEN confirmed THEN 2 WHEN dismissed THEN 4 ELSE 0 END + CASE WHEN tier = 'formal' THEN 0 ELSE 1 END AS rank FROM cd)"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = activity(spark, sf_dir)
    gone = review.nodes(log, "on-issue", "issue").where("id % 10 = 3").select(F.col("id").alias("comment"), "issue")
    return review.approval_candidates(log, gone, **PHRASES)


@query(f"WITH {FOUND} SELECT * FROM rk")
def ap_find(spark, sf_dir):
    return found(spark, sf_dir).drop("snippet")


@query(f"WITH {FOUND} SELECT comment, issue, approver, tier, rank, \"at\" FROM rk")
def ap_rank(spark, sf_dir):
    return found(spark, sf_dir).select("comment", "issue", "approver", "tier", "rank", "at").orderBy("rank", F.desc("at"))


@query(f"""WITH {ACTIVITY}, c AS (SELECT object::BIGINT AS id, nullif(count(*) FILTER (predicate = 'commented-by'), 0) AS comments, nullif(count(*) FILTER (predicate = 'assigned-to'), 0) AS assigned, nullif(count(*) FILTER (predicate = 'created-by'), 0) AS created FROM fa WHERE predicate IN ('commented-by', 'assigned-to', 'created-by') GROUP BY ALL),
l AS (SELECT subject AS id, object::BIGINT AS other FROM fa WHERE predicate = 'same-as' UNION SELECT object::BIGINT, subject FROM fa WHERE predicate = 'same-as'),
a AS (SELECT l.id, string_agg(coalesce(n.object, l.other::VARCHAR) || CASE WHEN l.other >= {DRIVE} THEN ' (Drive)' ELSE ' (Backlog)' END, '; ' ORDER BY coalesce(n.object, l.other::VARCHAR)) AS accounts FROM l LEFT JOIN fa n ON n.subject = l.other AND n.predicate = 'name' GROUP BY l.id),
p AS (SELECT subject AS id FROM fa WHERE predicate = 'name')
SELECT id, comments, assigned, created, accounts FROM p LEFT JOIN c USING (id) LEFT JOIN a USING (id) WHERE comments IS NOT NULL OR assigned IS NOT NULL OR created IS NOT NULL OR accounts IS NOT NULL""")
def ap_ctx(spark, sf_dir):
    log = activity(spark, sf_dir)
    return review.approver_contexts(log, review.persons(log))


@query(f"""WITH {ACTIVITY}, c AS (SELECT i.object::BIGINT AS issue, a.object AS approver, i.valid_from AS tm FROM fa i JOIN fa a ON a.subject = i.subject AND a.predicate = 'commented-by' WHERE i.predicate = 'on-issue' AND i.subject % 1000 = 0)
SELECT issue AS subject, 'approved-by' AS predicate, approver AS object, tm AS valid_from FROM c UNION ALL SELECT issue, 'approved-at', tm::VARCHAR, tm FROM c
UNION ALL SELECT issue, 'approval-review', 'confirmed', NULL FROM c UNION ALL SELECT issue, 'approval-reviewed-by', 'r', NULL FROM c""")
def ap_confirm(spark, sf_dir):
    """The first turn of each conversation, as if it were confirmed."""
    log = activity(spark, sf_dir)
    rows = review.nodes(log, "on-issue", "issue").where("id % 1000 = 0").join(review.nodes(log, "commented-by", "approver").drop("at"), "id")
    return review.approval_facts(rows.withColumn("reviewer", F.lit("r")).withColumn("note", F.lit(""))).drop("source")


# Inference

INFERRED = f"""{EVENTS}, act AS (SELECT DISTINCT t AS person, grp AS project FROM ev WHERE template <> 'doc-access' AND t IS NOT NULL),
roots AS (SELECT subject AS id, subject AS root FROM fa WHERE predicate = 'same-as' UNION SELECT object::BIGINT, subject FROM fa WHERE predicate = 'same-as'),
g AS (SELECT DISTINCT d.id AS doc, d.t AS person, coalesce(root, d.t) AS who FROM ev d LEFT JOIN roots ON roots.id = d.t WHERE template = 'doc-access' AND d.t IS NOT NULL),
met AS (SELECT DISTINCT doc, g.person, project FROM g JOIN (SELECT coalesce(root, person) AS who, project FROM act LEFT JOIN roots ON id = person) a USING (who)),
r AS (SELECT doc, count(DISTINCT person) AS resolved FROM met GROUP BY doc HAVING count(DISTINCT person) >= 3),
inf AS (SELECT doc, project, count(*) AS support, resolved, CASE WHEN count(*) = resolved THEN 'high' ELSE 'ambiguous' END AS tier FROM met JOIN r USING (doc) GROUP BY doc, project, resolved HAVING count(*) / resolved >= 0.5)"""


def inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = graph.checkpointed(activity(spark, sf_dir))
    events = graph.checkpointed(review.event_groups(log))
    gone = events.where("template = 'doc-access' and id % 5 = 1").select(F.col("id").alias("doc"), F.lit(PROJECT).cast("long").alias("project"))
    return review.inference_candidates(log, events, gone)


@query(f"WITH {INFERRED} SELECT doc, project, support, resolved, tier, false AS confirmed, doc % 5 = 1 AND project = {PROJECT} AS dismissed, tier = 'high' AS filled FROM inf")
def in_find(spark, sf_dir):
    return inferred(spark, sf_dir)


@query(f"WITH {INFERRED} SELECT doc, project FROM inf WHERE tier = 'ambiguous'")
def in_rank(spark, sf_dir):
    """Those that need a verdict, open ones first, then by share."""
    return inferred(spark, sf_dir).where("not filled").orderBy(*review.inference_order()).select("doc", "project")


@query(f"WITH {INFERRED} SELECT doc AS subject, 'relates-to-project' AS predicate, project::VARCHAR AS object, 9 AS valid_from, 'inference-review' AS source FROM inf WHERE tier = 'ambiguous' AND doc % 2 = 0")
def in_batch(spark, sf_dir):
    return review.inference_facts(inferred(spark, sf_dir).where("doc % 2 = 0").withColumn("at", F.lit(9)))


@query(f"""WITH {INFERRED}, l AS (SELECT subject AS a, object::BIGINT AS b FROM fa WHERE predicate = 'same-as' UNION SELECT object::BIGINT, subject FROM fa WHERE predicate = 'same-as')
SELECT DISTINCT d.id AS doc, project, d.t AS person, via FROM ev d JOIN (SELECT person, project, NULL AS via FROM act UNION ALL SELECT a, project, min(b) FROM l JOIN act ON act.person = b WHERE NOT EXISTS (SELECT 1 FROM act x WHERE x.person = a AND x.project = act.project) GROUP BY a, project) n ON n.person = d.t WHERE template = 'doc-access'""")
def in_support(spark, sf_dir):
    """Who of a document's readers is active in a project, and by which account."""
    log = graph.checkpointed(activity(spark, sf_dir))
    events = graph.checkpointed(review.event_groups(log))
    grants = events.where("template = 'doc-access'").select(F.col("id").alias("doc"), F.explode("targets").alias("person"))
    return people.supporters(grants, review.project_activity(events), review.linked(log))


@query(f"WITH {INFERRED} SELECT person, project FROM act")
def ag_activity(spark, sf_dir):
    return review.project_activity(review.event_groups(activity(spark, sf_dir)))


# Conformance: its rules are in ``rules``

@query("SELECT doc_id AS subject, unnest(['review-decision', 'reviewed-by']) AS predicate, unnest([CASE WHEN quality = 1 THEN 'accept' ELSE 'reject' END, 'r']) AS object, 'human-review' AS source FROM labels")
def cf_record(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "accept").otherwise("reject").alias("decision"), F.lit("r").alias("reviewer"), F.lit("").alias("note"))
    return review.conformance_facts(rows).drop("valid_from")


@query(f"WITH {ACTIVITY} SELECT subject AS id, object AS name FROM fa WHERE predicate IN ('name', 'project-name')")
def cf_names(spark, sf_dir):
    return review.display_names(activity(spark, sf_dir))


# Derived relations as of an instant, and retracts

@query(f"WITH {ACTIVITY} SELECT a.subject AS start, l.object::BIGINT AS \"end\" FROM (SELECT * FROM fa WHERE predicate = 'assigned-to' UNION ALL SELECT {ISSUE} + k, 'assigned-to', ({PERSON} + n * 10 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END)::VARCHAR, tm FROM o WHERE k % 50 = 7 AND tm + 86400 > 900000000) a JOIN fa l ON l.subject = a.object::BIGINT AND l.predicate = 'same-as' WHERE a.valid_from <= 900000000")
def dr_asof(spark, sf_dir):
    """The accounts of assignees at an instant, over a predicate of one value and one of many; what is cleared later counts."""
    log = activity(spark, sf_dir)
    edges = graph.edges_as_of(log, [graph.Predicate("assigned-to", "", "Issue", "Person"), graph.Predicate("same-as", "", "Person", "Person", "many")], 900_000_000)
    starts = log.where("predicate = 'in-project'").select(F.col("subject").alias("id"))
    return graph.evaluate(edges, [graph.Hop("assigned-to"), graph.Hop("same-as")], starts)


@query("""WITH w AS (SELECT event_id AS seq, user_id AS subject, event_type AS predicate, floor(value)::BIGINT AS object, CASE WHEN event_id % 4 = 3 THEN 'retract' ELSE 'assert' END AS op FROM events),
k AS (SELECT * FROM w WHERE op = 'assert' AND NOT EXISTS (SELECT 1 FROM w r WHERE r.op = 'retract' AND r.subject = w.subject AND r.predicate = w.predicate AND r.object = w.object AND r.seq > w.seq))
SELECT subject, predicate, object FROM k QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY seq DESC) = 1""")
def g_retract(spark, sf_dir):
    """Every fourth event takes back what its user ever said of that value; an older value is the current one again."""
    op = F.when(F.col("event_id") % 4 == 3, "retract").otherwise("assert")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.floor("value").alias("object"), op.alias("op"))
    return facts.raw_head(facts.live(log)).select("subject", "predicate", "object")


# Claims: documents say in which language they are written, and by what source

CLAIMS = "cl AS (SELECT doc_id AS doc, 'Source' AS subject_type, source AS subject, 'written-in' AS predicate, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Language' END AS object_type, lang AS object FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = F.lit
    return table(spark, sf_dir, "documents").where("source is not null and lang is not null").select(F.col("doc_id").alias("doc"), lit("Source").alias("subject_type"), F.col("source").alias("subject"), lit("written-in").alias("predicate"), F.when(F.col("doc_id") % 3 != 0, "Language").alias("object_type"), F.col("lang").alias("object"), lit(None).cast("string").alias("effectiveFrom"), lit(None).cast("string").alias("passage"), lit("implied").alias("confidence"))


@query(f"WITH {CLAIMS} SELECT DISTINCT subject_type AS type, subject AS name FROM cl UNION SELECT DISTINCT object_type, object FROM cl WHERE object_type IS NOT NULL")
def cl_names(spark, sf_dir):
    return sources.entity_names(claims(spark, sf_dir))


MIMES = "f AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/vnd.google-apps.document' END AS mime, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'Old plan_v2' ELSE 'plan' END END AS name FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    mime = F.when(i % 4 == 0, "application/pdf").when(i % 4 == 1, "image/png").when(i % 4 == 2, "application/vnd.google-apps.document")
    return table(spark, sf_dir, "documents").select(i.alias("id"), mime.alias("mime"), F.when(i % 5 != 0, F.when(i % 3 == 0, "Old plan_v2").otherwise("plan")).alias("name"))


@query(f"WITH {MIMES} SELECT id, mime, coalesce(name, id::VARCHAR) AS name, coalesce(name, '') LIKE 'Old%' AS draft FROM f WHERE mime IN ('application/pdf', 'application/vnd.google-apps.document')")
def cl_readable(spark, sf_dir):
    return sources.classified(files(spark, sf_dir))[0]


@query(f"WITH {MIMES} SELECT coalesce(mime, 'unknown') AS mime, count(*) AS n FROM f WHERE mime IS NULL OR mime = 'image/png' GROUP BY ALL")
def ag_skipped(spark, sf_dir):
    return sources.classified(files(spark, sf_dir))[1]


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'law' ELSE 'other' END AS category, doc_id % 3 = 0 AS selected FROM documents")
def cl_triage(spark, sf_dir):
    """A proposal over the documents and over some that aren't there."""
    i = F.col("id")
    known = files(spark, sf_dir)
    asked = known.select(i).unionByName(known.select((i + 10**9).alias("id")))
    return sources.shortlist(asked.select(i, F.when(i % 2 == 0, "law").alias("category"), F.when(i % 3 == 0, True).alias("selected")), known)


# The model, and scores of mappings

@query("SELECT name, ord FROM (VALUES ('a', 1), ('b', 2), ('c', 4)) t(name, ord)")
def md_seed(spark, sf_dir):
    return catalog.seeded(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4), ("b", 5)], "name string, ord int"))


@query("SELECT name, floor FROM (VALUES ('a', 7), ('b', NULL), ('c', 2), ('d', NULL)) t(name, floor)")
def md_floor(spark, sf_dir):
    edits = spark.createDataFrame([("a", 7, 2), ("a", 3, 1), ("b", None, 1), ("c", 300, 1)], "name string, floor int, at int")
    return catalog.floors(spark.createDataFrame([("a", 1), ("b", 5), ("c", 2), ("d", None)], "name string, floor int"), edits)


SCORES = """need AS (SELECT DISTINCT p_brand AS subject, p_type AS skill FROM part), has AS (SELECT DISTINCT l_suppkey AS candidate, p_type AS skill FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40),
lone AS (SELECT candidate, min(skill) AS skill FROM has GROUP BY candidate),
top_ AS (SELECT 'g' AS kind, subject, candidate FROM need JOIN has USING (skill) GROUP BY subject, candidate QUALIFY row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, candidate) <= 5
UNION ALL SELECT 't', subject, candidate FROM need JOIN lone USING (skill) GROUP BY subject, candidate QUALIFY row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, candidate) <= 5),
b AS (SELECT subject, candidate, count(*) FILTER (kind = 'g') AS g, count(*) FILTER (kind = 't') AS t FROM top_ GROUP BY ALL)"""


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Top suppliers of each brand by a mapping with many types a supplier, and by one that keeps a single type."""
    part = table(spark, sf_dir, "part")
    has = table(spark, sf_dir, "lineitem").where("l_quantity > 40").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("candidate"), F.col("p_type").alias("skill")).distinct()
    needs = part.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("skill"))
    lone = has.groupBy("candidate").agg(F.min("skill").alias("skill"))
    return review.top_matches(needs, has), review.top_matches(needs, lone)


@query(f"WITH {SCORES} SELECT subject, candidate FROM top_ WHERE kind = 'g'")
def sc_top(spark, sf_dir):
    return scored(spark, sf_dir)[0]


@query(f"WITH {SCORES} SELECT subject, CASE WHEN sum(g) > 0 THEN count(*) FILTER (g > 0 AND t > 0) / sum(g) ELSE 0.0 END::DOUBLE AS recall, CASE WHEN sum(t) > 0 THEN count(*) FILTER (g > 0 AND t > 0) / sum(t) ELSE 0.0 END::DOUBLE AS precision FROM b GROUP BY subject")
def ag_score(spark, sf_dir):
    return review.mapping_score(*scored(spark, sf_dir))
