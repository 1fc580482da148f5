"""Rules over paths with instants, and the stability of candidates, over logs made of the driver's tables; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, patterns, review, temporal
from ..operators.temporal import Rule, Step
from .queries import query, seconds, table
from .reviews import ACTIVITY, CANDIDATES, DRIVE, FOLDER, DOCUMENT, ISSUE, PERSON, PROJECT

DAY = 86400


def wrote(rows: DataFrame, subject, predicate: str, obj, at, op: str = "assert", until=None) -> DataFrame:
    """Writes of a log whose order is that of their instants."""
    lit, at = F.lit, at.cast("long")
    return rows.select(at.alias("seq"), lit(op).alias("op"), subject.cast("long").alias("subject"), lit(predicate).alias("predicate"), obj.cast("string").alias("object"), at.alias("valid_from"), (lit(None) if until is None else until).cast("long").alias("valid_to"))


# Projects (nations) have a lead and deputies, who change by months; orders are issues, approved some days after they came.

RULES = f"""o AS (SELECT o_orderkey AS k, c_nationkey AS n, o_orderstatus AS st, floor(epoch(o_orderdate))::BIGINT AS tm, o_orderdate AS d FROM orders JOIN customer ON c_custkey = o_custkey),
a AS (SELECT *, tm + {DAY} * (k % 40 + 1) AS tat, year(d + to_days((k % 40 + 1)::INTEGER)) * 12 + month(d + to_days((k % 40 + 1)::INTEGER)) AS am FROM o),
m AS (SELECT DISTINCT n, year(d) * 12 + month(d) AS mi, epoch(date_trunc('month', d))::BIGINT AS tm FROM o),
lg(op, subject, predicate, object, valid_from) AS (
SELECT 'assert', {ISSUE} + k, 'in-project', ({PROJECT} + n)::VARCHAR, tm FROM o
UNION ALL SELECT 'assert', {ISSUE} + k, 'status', st, tm FROM o
UNION ALL SELECT 'assert', {ISSUE} + k, 'approved-at', tat::VARCHAR, tm FROM a
UNION ALL SELECT 'assert', {ISSUE} + k, 'approved-by', CASE k % 10 WHEN 5 THEN {PERSON} + n * 10 + (am - 1) % 7 WHEN 6 THEN {PERSON} + n * 10 + 9 WHEN 7 THEN {PERSON} + n * 10 + 100 + am % 5 ELSE {PERSON} + n * 10 + am % 7 END::VARCHAR, tat FROM a WHERE k % 10 <> 0
UNION ALL SELECT 'close', {ISSUE} + k, 'approved-by', NULL, tat + {DAY} FROM a WHERE k % 10 = 9
UNION ALL SELECT 'assert', {ISSUE} + k, 'waived', 'yes', tm FROM o WHERE k % 20 IN (0, 9)
UNION ALL SELECT CASE WHEN (n * 3 + mi) % 11 = 5 THEN 'close' ELSE 'assert' END, {PROJECT} + n, 'led-by', CASE WHEN (n * 3 + mi) % 11 <> 5 THEN ({PERSON} + n * 10 + mi % 7)::VARCHAR END, tm FROM m
UNION ALL SELECT 'assert', {PROJECT} + n, 'deputy', ({PERSON} + n * 10 + 100 + mi % 5)::VARCHAR, tm FROM m
UNION ALL SELECT 'close', {PROJECT} + n, 'deputy', ({PERSON} + n * 10 + 100 + mi % 5)::VARCHAR, tm + {45 * DAY} FROM m),
hd AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC) = 1),
iv AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate, CASE WHEN predicate = 'deputy' THEN object END ORDER BY valid_from) AS until FROM lg WHERE predicate IN ('led-by', 'deputy')),
ab AS (SELECT subject AS id, max(object) FILTER (predicate = 'in-project')::BIGINT AS p, max(object) FILTER (predicate = 'status') AS st, max(object) FILTER (predicate = 'approved-at')::BIGINT AS tat, max(object) FILTER (predicate = 'approved-by') AS actual, coalesce(max(object) FILTER (predicate = 'waived') = 'yes', false) AS waived FROM hd WHERE op = 'assert' AND subject >= {ISSUE} GROUP BY subject)"""

# Of each rule: its name, the condition of its scope, the predicate of its last hop, whether an instant is asked for, absence.
_SHAPES = [("lead at approval", "st = 'O'", "led-by", True, "waived"), ("deputy at approval", "true", "deputy", True, "false"), ("lead now", "true", "led-by", False, "waived")]
_ONE = """SELECT '{0}' AS "rule", id, CASE WHEN NOT {1} OR required IS NULL THEN 'NOT_APPLICABLE' WHEN actual IS NULL THEN CASE WHEN {4} THEN 'ABSENT' ELSE 'NOT_APPLICABLE' END WHEN fits THEN 'OK' ELSE 'MISMATCH' END AS verdict,
CASE WHEN {1} AND required IS NOT NULL AND NOT fits THEN CASE WHEN EXISTS (SELECT 1 FROM iv h WHERE h.subject = p AND h.predicate = '{2}' AND h.op = 'assert' AND h.object = actual AND {6}) THEN 'stale' ELSE 'wrong' END END AS why, CASE WHEN {1} THEN required END::BIGINT AS required, actual::BIGINT AS actual, {5} AS as_of
FROM ab LEFT JOIN (SELECT ab.id AS of, min(iv.object) AS required, bool_or(iv.object = actual) AS fits FROM ab JOIN iv ON iv.subject = p AND iv.predicate = '{2}' AND iv.op = 'assert' AND {3} GROUP BY ab.id) r ON of = id"""


def _shape(name: str, scope: str, predicate: str, at: bool, absent: str) -> str:
    holds = "iv.valid_from <= tat AND (iv.until IS NULL OR iv.until > tat)" if at else "iv.until IS NULL"
    return _ONE.format(name, scope, predicate, holds, absent, f"CASE WHEN {scope} THEN tat END" if at else "NULL::BIGINT", "h.valid_from < tat" if at else "true")


ALL_VERDICTS = f"{RULES}, every AS ({' UNION ALL '.join(_shape(*s) for s in _SHAPES)})"

THE_RULES = (
    Rule("lead at approval", (Step("in-project"), Step("led-by", "approved-at")), "approved-by", ("status", "O"), ("waived", "yes")),
    Rule("deputy at approval", (Step("in-project"), Step("deputy", "approved-at", many=True)), "approved-by"),
    Rule("lead now", (Step("in-project"), Step("led-by")), "approved-by", absent_when=("waived", "yes")),
)


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that the rules are read from."""
    c, lit = F.col, F.lit
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("k"), c("c_nationkey").cast("long").alias("n"), c("o_orderstatus").alias("st"), seconds("o_orderdate").alias("at"))
    month = lambda at: F.year(F.timestamp_seconds(at)) * 12 + F.month(F.timestamp_seconds(at))
    o = o.withColumn("then", c("at") + DAY * (c("k") % 40 + 1)).withColumn("am", month(c("then")))
    m = o.select("n", month(c("at")).alias("mi"), F.unix_seconds(F.date_trunc("month", F.timestamp_seconds("at"))).alias("at")).distinct()
    issue, project, lead, deputy = c("k") + ISSUE, c("n") + PROJECT, lambda mi: c("n") * 10 + mi % 7 + PERSON, lambda mi: c("n") * 10 + mi % 5 + (PERSON + 100)
    by = F.when(c("k") % 10 == 5, lead(c("am") - 1)).when(c("k") % 10 == 6, c("n") * 10 + (PERSON + 9)).when(c("k") % 10 == 7, deputy(c("am"))).otherwise(lead(c("am")))
    led = (c("n") * 3 + c("mi")) % 11 != 5
    return graph.union_all([
        wrote(o, issue, "in-project", project, c("at")),
        wrote(o, issue, "status", c("st"), c("at")),
        wrote(o, issue, "approved-at", c("then"), c("at")),
        wrote(o.where("k % 10 != 0"), issue, "approved-by", by, c("then")),
        wrote(o.where("k % 10 = 9"), issue, "approved-by", lit(None), c("then") + DAY, "close"),
        wrote(o.where("k % 20 in (0, 9)"), issue, "waived", lit("yes"), c("at")),
        wrote(m.where(led), project, "led-by", lead(c("mi")), c("at")),
        wrote(m.where(~led), project, "led-by", lit(None), c("at"), "close"),
        wrote(m, project, "deputy", deputy(c("mi")), c("at")),
        wrote(m, project, "deputy", deputy(c("mi")), c("at") + 45 * DAY, "close"),
    ])


def issues(log: DataFrame) -> DataFrame:
    return log.where("predicate = 'in-project'").select(F.col("subject").alias("id"))


@query(f"WITH {ALL_VERDICTS} SELECT * FROM every")
def cf_rule(spark, sf_dir):
    """Issues by who approved them: the lead or a deputy of their project at that instant, or the lead now."""
    log = graph.checkpointed(ruled(spark, sf_dir))
    return graph.union_all([temporal.conformance(log, rule, issues(log)) for rule in THE_RULES])


GAPS = f"""{ALL_VERDICTS}, vd AS (SELECT * FROM every WHERE "rule" = 'lead at approval'),
nm AS (SELECT DISTINCT ({PERSON} + n * 10 + j)::BIGINT AS id, 'Lead ' || j || ' of ' || n AS name FROM m, range(7) r(j)),
gaps AS (SELECT vd.id, '#' || vd.id AS label, verdict, why AS kind, CASE WHEN verdict = 'ABSENT' THEN 'nothing is there where ' || r.name || ' (#' || required || ') is required' WHEN why = 'stale' THEN a.name || ' (#' || actual || ') held it before, but not as of ' || as_of || '; required is ' || r.name || ' (#' || required || ')' ELSE coalesce(a.name || ' (#' || actual || ')', '#' || actual) || ' is not ' || r.name || ' (#' || required || ')' END AS reason,
CASE WHEN vd.id % 7 = 0 THEN 'accept' END AS decision, CASE WHEN vd.id % 7 = 0 THEN 'r' END AS reviewer FROM vd LEFT JOIN nm r ON r.id = required LEFT JOIN nm a ON a.id = actual WHERE verdict IN ('ABSENT', 'MISMATCH'))"""


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts of the first rule, and their gaps with the decisions on every seventh."""
    log = graph.checkpointed(ruled(spark, sf_dir))
    told = graph.checkpointed(temporal.conformance(log, THE_RULES[0], issues(log)))
    projects = log.where("predicate = 'led-by'").select(((F.col("subject") - PROJECT)).alias("n")).distinct()
    leads = projects.select("n", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j")).select((F.col("n") * 10 + F.col("j") + PERSON).alias("id"), F.concat(F.lit("Lead "), "j", F.lit(" of "), "n").alias("name"))
    decided = review.conformance_facts(told.where("id % 7 = 0").select("id", F.lit("accept").alias("decision"), F.lit("r").alias("reviewer"), F.lit(None).cast("string").alias("note")))
    more = decided.select(F.lit(2).cast("long").alias("seq"), F.lit("assert").alias("op"), "subject", "predicate", "object", "valid_from", F.lit(None).cast("long").alias("valid_to"))
    return told, review.conformance_gaps(told, leads, more)


@query(f"WITH {GAPS} SELECT * FROM gaps")
def cf_review(spark, sf_dir):
    return reviewed(spark, sf_dir)[1]


@query(f"WITH {GAPS} SELECT (SELECT count(*) FROM vd) AS total, (SELECT count(*) FROM vd WHERE verdict = 'OK') AS ok, (SELECT count(*) FROM vd WHERE verdict = 'NOT_APPLICABLE') AS not_applicable, (SELECT count(*) FROM gaps) AS gaps, (SELECT count(decision) FROM gaps) AS resolved, (SELECT count(*) - count(decision) FROM gaps) AS open")
def g_conformance(spark, sf_dir):
    return review.conformance_counts(*reviewed(spark, sf_dir))


# Issues change hands, documents' grants come and go: the log that traces are read from.

MOVES = f"""o AS (SELECT o_orderkey AS k, c_nationkey AS n, floor(epoch(o_orderdate))::BIGINT AS tm FROM orders JOIN customer ON c_custkey = o_custkey),
s AS (SELECT l_partkey AS p, l_suppkey AS s, min(floor(epoch(l_shipdate)))::BIGINT AS tm FROM lineitem GROUP BY ALL),
d AS (SELECT p, p_size AS f, min(tm) AS tm FROM s JOIN part ON p_partkey = p GROUP BY ALL),
lg(op, subject, predicate, object, valid_from, valid_to) AS (
SELECT 'assert', {ISSUE} + k, 'in-project', ({PROJECT} + n)::VARCHAR, tm, NULL FROM o
UNION ALL SELECT 'assert', {ISSUE} + k, 'assigned-to', ({PERSON} + n * 10 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END)::VARCHAR, tm, CASE WHEN k % 11 = 3 THEN tm + {70 * DAY} END FROM o
UNION ALL SELECT 'assert', {ISSUE} + k, 'assigned-to', ({PERSON} + n * 10 + 2)::VARCHAR, tm + {40 * DAY}, NULL FROM o WHERE k % 6 = 1
UNION ALL SELECT 'assert', {ISSUE} + k, 'assigned-to', ({PERSON} + n * 10)::VARCHAR, tm + {300 * DAY}, NULL FROM o WHERE k % 6 = 1
UNION ALL SELECT 'close', {ISSUE} + k, 'assigned-to', NULL, tm + {100 * DAY}, NULL FROM o WHERE k % 18 = 2
UNION ALL SELECT 'assert', {DOCUMENT} + p, 'in-folder', ({FOLDER} + f)::VARCHAR, tm, NULL FROM d
UNION ALL SELECT 'assert', {DOCUMENT} + p, 'can-access', ({DRIVE} + s)::VARCHAR, tm, NULL FROM s
UNION ALL SELECT 'close', {DOCUMENT} + p, 'can-access', ({DRIVE} + s)::VARCHAR, tm + {90 * DAY}, NULL FROM s WHERE s % 3 = 0
UNION ALL SELECT 'assert', {DOCUMENT} + p, 'can-access', ({DRIVE} + 1000000 + f)::VARCHAR, tm, NULL FROM d WHERE p % 10 <> 1
UNION ALL SELECT 'close', {DOCUMENT} + p, 'can-access', ({DRIVE} + 1000000 + f)::VARCHAR, tm + {200 * DAY}, NULL FROM d WHERE p % 10 IN (3, 4)
UNION ALL SELECT 'assert', {DOCUMENT} + p, 'can-access', ({DRIVE} + 1000000 + f)::VARCHAR, tm + {500 * DAY}, NULL FROM d WHERE p % 10 = 3
UNION ALL SELECT 'assert', {DOCUMENT} + p, 'can-access', ({DRIVE} + 9999999)::VARCHAR, tm, CASE WHEN p % 10 = 4 THEN tm + {400 * DAY} END FROM d WHERE p % 20 <> 7),
iv AS (SELECT *, least(lead(valid_from) OVER (PARTITION BY subject, predicate, CASE WHEN predicate = 'can-access' THEN object END ORDER BY valid_from), valid_to) AS until FROM lg),
fa AS (SELECT subject, predicate, object, valid_from FROM (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY subject, predicate, CASE WHEN predicate = 'can-access' THEN object END ORDER BY valid_from DESC) = 1) WHERE op = 'assert')"""

TRACES = f"""{CANDIDATES.replace(ACTIVITY, MOVES)}, mo AS (SELECT pattern_id, epoch(m)::BIGINT AS tm FROM (SELECT pattern_id, window_from, unnest(generate_series(date_trunc('month', make_timestamp(window_from * 1000000)), make_timestamp(window_to * 1000000), INTERVAL 1 MONTH)) AS m FROM cands WHERE window_from > 0) WHERE epoch(m) >= window_from QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY m DESC) <= 36),
ids AS (SELECT DISTINCT template, grp, id FROM ev), of AS (SELECT pattern_id, c.predicate, first, second, ids.id FROM cands c JOIN ids ON ids.template = c.template AND ids.grp = c.grp UNION ALL SELECT pattern_id, predicate, first, second, ids.id FROM cands c JOIN ids ON c.template = 'doc-access-scope' AND ids.template = 'doc-access'),
met AS (SELECT DISTINCT of.pattern_id, mo.tm, of.id, iv.object::BIGINT AS t, coalesce(iv.object::BIGINT IN (first, second), false) AS hit FROM of JOIN mo USING (pattern_id) JOIN iv ON iv.subject = of.id AND iv.predicate = of.predicate AND iv.op = 'assert' AND iv.valid_from <= mo.tm AND (iv.until IS NULL OR iv.until > mo.tm)),
cn AS (SELECT pattern_id, tm, count(*) AS population, count(*) FILTER (hit) AS covered FROM (SELECT pattern_id, tm, id, bool_or(hit) AS hit FROM met GROUP BY ALL) GROUP BY ALL),
vt AS (SELECT pattern_id, tm, t FROM met GROUP BY pattern_id, tm, t QUALIFY row_number() OVER (PARTITION BY pattern_id, tm ORDER BY count(*) DESC, t) = 1),
sl AS (SELECT pattern_id, mo.tm, coalesce(population, 0) AS population, coalesce(covered, 0) AS covered, coalesce(covered / population >= 0.8, false) AS held, t FROM mo LEFT JOIN cn USING (pattern_id, tm) LEFT JOIN vt USING (pattern_id, tm))"""


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("k"), c("c_nationkey").cast("long").alias("n"), seconds("o_orderdate").alias("at"))
    s = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("p"), c("l_suppkey").alias("s")).agg(F.min(seconds("l_shipdate")).alias("at"))
    o, s = graph.checkpointed(o), graph.checkpointed(s)  # each is read by several of the writes below, by filters of its own
    d = graph.checkpointed(s.join(table(spark, sf_dir, "part"), c("p_partkey") == c("p")).groupBy("p", c("p_size").alias("f")).agg(F.min("at").alias("at")))
    issue, doc, at = c("k") + ISSUE, c("p") + DOCUMENT, c("at")
    lead, reader = c("n") * 10 + PERSON, c("f") + (DRIVE + 10**6)
    return graph.union_all([
        wrote(o, issue, "in-project", c("n") + PROJECT, at),
        wrote(o, issue, "assigned-to", F.when(c("k") % 12 == 0, 1).otherwise(0) + lead, at, until=F.when(c("k") % 11 == 3, at + 70 * DAY)),
        wrote(o.where("k % 6 = 1"), issue, "assigned-to", lead + 2, at + 40 * DAY),
        wrote(o.where("k % 6 = 1"), issue, "assigned-to", lead, at + 300 * DAY),
        wrote(o.where("k % 18 = 2"), issue, "assigned-to", lit(None), at + 100 * DAY, "close"),
        wrote(d, doc, "in-folder", c("f") + FOLDER, at),
        wrote(s, doc, "can-access", c("s") + DRIVE, at),
        wrote(s.where("s % 3 = 0"), doc, "can-access", c("s") + DRIVE, at + 90 * DAY, "close"),
        wrote(d.where("p % 10 != 1"), doc, "can-access", reader, at),
        wrote(d.where("p % 10 in (3, 4)"), doc, "can-access", reader, at + 200 * DAY, "close"),
        wrote(d.where("p % 10 = 3"), doc, "can-access", reader, at + 500 * DAY),
        wrote(d.where("p % 20 != 7"), doc, "can-access", lit(DRIVE + 9999999), at, until=F.when(c("p") % 10 == 4, at + 400 * DAY)),
    ])


@query(f"WITH {TRACES} SELECT pattern_id, tm AS \"at\", population, covered, held, CASE WHEN NOT held THEN t END AS top, count(*) FILTER (population > 0) OVER w AS measured, count(*) FILTER (held) OVER w AS months_held FROM sl WINDOW w AS (PARTITION BY pattern_id)")
def an_stability(spark, sf_dir):
    """Of every candidate, month by month: how many of its events had a target then, and whose they were."""
    log = graph.checkpointed(moved(spark, sf_dir))
    events = graph.checkpointed(review.event_groups(log))
    found = graph.checkpointed(review.pattern_candidates(events))
    months = found.select("pattern_id", patterns.month_starts(F.col("window_from"), F.col("window_to")).alias("months"))
    return temporal.traces(log, events, found, months)
