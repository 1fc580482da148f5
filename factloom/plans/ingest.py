"""Issue activity, file metadata and claims read from payloads made of the driver's tables; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import facts, temporal
from ..sources import claims as parsing
from ..sources import ingest
from .queries import HASH_SQL, query, table
from .reviews import COMMENT, DOCUMENT, DRIVE, FOLDER, ISSUE, PERSON, PROJECT

DAY = 86400

# An event is an issue's creation, update or comment, or of a type that says nothing. Updates hold a snapshot, or changes only.
PAYLOADS = f"""st(id, nm) AS (VALUES (1, 'Open'), (2, 'Busy'), (3, 'Closed')),
us(nm, id, mail) AS (SELECT 'User ' || j, j + 500, CASE WHEN j % 2 = 0 THEN 'u' || j || '@x' END FROM range(6) r(j)),
e AS (SELECT event_id AS ev, event_id % 4 + 1 AS ty, user_id AS ik, user_id % 9 AS pk, event_id % 7 AS ak, floor(epoch(ts))::BIGINT AS tm, event_id % 3 = 0 AS snap, floor(value)::BIGINT AS v FROM events),
kn AS (SELECT * FROM e WHERE ty <= 3),
ch AS (SELECT *, 'status' AS f, CASE WHEN v % 5 = 4 THEN ' ' WHEN v % 5 = 0 THEN '9' ELSE (v % 4)::VARCHAR END AS nw, 0 AS nth FROM kn WHERE ty = 2
UNION ALL SELECT *, CASE WHEN v % 2 = 0 THEN 'assigner' ELSE 'assignee' END, CASE WHEN v % 6 = 5 THEN '' ELSE 'User ' || (v % 8) END, 1 FROM kn WHERE ty = 2
UNION ALL SELECT *, 'summary', CASE WHEN v % 7 = 6 THEN NULL ELSE 'Sum ' || v END, 2 FROM kn WHERE ty = 2),
it(event, place, op, subject, predicate, object, valid_from) AS (
SELECT ev, 0, 'assert', {PROJECT} + pk, 'project-name', 'Project ' || pk, tm FROM kn
UNION ALL SELECT ev, 1, 'assert', {PROJECT} + pk, 'project-key', 'K' || pk, tm FROM kn
UNION ALL SELECT ev, 2, 'assert', {PERSON} + ak, 'name', 'Author ' || ak, tm FROM kn
UNION ALL SELECT ev, 3, 'assert', {PERSON} + ak, 'email', 'a' || ak || '@x', tm FROM kn WHERE ak % 2 = 0
UNION ALL SELECT ev, 4, 'assert', {ISSUE} + ik, 'issue-key', 'K' || pk || '-' || ik, tm FROM kn
UNION ALL SELECT ev, 5, 'assert', {ISSUE} + ik, 'summary', 'Snap ' || v, tm FROM kn WHERE snap
UNION ALL SELECT ev, 6, 'assert', {ISSUE} + ik, 'status', nm, tm FROM kn JOIN st ON st.id = v % 3 + 1 WHERE snap
UNION ALL SELECT ev, 7, 'assert', {ISSUE} + ik, 'in-project', ({PROJECT} + pk)::VARCHAR, tm FROM kn
UNION ALL SELECT ev, 8, 'assert', {PERSON} + v % 5 + 500, 'name', 'User ' || v % 5, tm FROM kn WHERE snap
UNION ALL SELECT ev, 10, 'assert', {ISSUE} + ik, 'assigned-to', ({PERSON} + v % 5 + 500)::VARCHAR, tm FROM kn WHERE snap
UNION ALL SELECT ev, 11, 'assert', {ISSUE} + ik, 'created-by', ({PERSON} + ak)::VARCHAR, tm FROM kn WHERE ty = 1
UNION ALL SELECT ev, 12, 'assert', {COMMENT} + ev, 'content', 'Said ' || v, tm FROM kn WHERE ty = 3
UNION ALL SELECT ev, 13, 'assert', {COMMENT} + ev, 'on-issue', ({ISSUE} + ik)::VARCHAR, tm FROM kn WHERE ty = 3
UNION ALL SELECT ev, 14, 'assert', {COMMENT} + ev, 'commented-by', ({PERSON} + ak)::VARCHAR, tm FROM kn WHERE ty = 3
UNION ALL SELECT ev, 15, 'assert', {ISSUE} + ik, 'status', coalesce(nm, nw), tm FROM ch LEFT JOIN st ON st.id::VARCHAR = nw WHERE f = 'status' AND trim(nw) <> '' AND NOT snap
UNION ALL SELECT ev, 23, 'assert', {PERSON} + us.id, 'name', nw, tm FROM ch JOIN us ON nm = nw WHERE nth = 1 AND NOT snap
UNION ALL SELECT ev, 24, 'assert', {PERSON} + us.id, 'email', mail, tm FROM ch JOIN us ON nm = nw WHERE nth = 1 AND NOT snap AND mail IS NOT NULL
UNION ALL SELECT ev, 25, 'assert', {ISSUE} + ik, 'assigned-to', ({PERSON} + us.id)::VARCHAR, tm FROM ch JOIN us ON nm = nw WHERE nth = 1 AND NOT snap
UNION ALL SELECT ev, 31, 'assert', {ISSUE} + ik, 'summary', nw, tm FROM ch WHERE f = 'summary' AND nw IS NOT NULL AND NOT snap
UNION ALL SELECT ev, {2**40} + nth, 'close', {ISSUE} + ik, CASE nth WHEN 0 THEN 'status' WHEN 1 THEN 'assigned-to' ELSE 'summary' END, NULL, tm FROM ch WHERE trim(coalesce(nw, '')) = '')"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event, value): what a source would send of each event, as JSON."""
    c, lit = F.col, F.lit
    v, e = F.floor("value").cast("long"), table(spark, sf_dir, "events")
    snap, text = c("event_id") % 3 == 0, lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    names = F.element_at(F.array(lit("Open"), lit("Busy"), lit("Closed")), (v % 3 + 1).cast("int"))
    person = lambda id_, name, mail: F.struct(id_.alias("id"), name.alias("name"), mail.alias("mailAddress"))
    author = c("event_id") % 7
    status = F.when(v % 5 == 4, " ").when(v % 5 == 0, "9").otherwise((v % 4).cast("string"))
    change = lambda field, new: F.struct(field.alias("field"), lit("was").alias("old_value"), new.alias("new_value"))
    changes = F.array(change(lit("status"), status), change(F.when(v % 2 == 0, "assigner").otherwise("assignee"), F.when(v % 6 == 5, "").otherwise(text("User ", v % 8))), change(lit("summary"), F.when(v % 7 != 6, text("Sum ", v))), change(lit("milestone"), lit("m")))
    type_ = (c("event_id") % 4 + 1).cast("int")
    content = F.struct(c("user_id").alias("id"), c("user_id").alias("key_id"), F.when(snap, text("Snap ", v)).alias("summary"), F.when(snap, F.struct((v % 3 + 1).alias("id"), names.alias("name"))).alias("status"), F.when(snap, person(v % 5 + 500, text("User ", v % 5), lit(None).cast("string"))).alias("assignee"), F.when(type_ == 3, F.struct(c("event_id").alias("id"), text("Said ", v).alias("content"))).alias("comment"), F.when(type_ == 2, changes).alias("changes"))
    project = F.struct((c("user_id") % 9).alias("id"), text("K", c("user_id") % 9).alias("projectKey"), text("Project ", c("user_id") % 9).alias("name"))
    user = person(author, text("Author ", author), F.when(author % 2 == 0, F.concat(lit("a"), author.cast("string"), lit("@x"))))
    made = F.struct(type_.alias("type"), project.alias("project"), content.alias("content"), user.alias("createdUser"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created"))
    return e.select(c("event_id").alias("event"), F.to_json(made).alias("value"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = spark.createDataFrame([(1, "Open"), (2, "Busy"), (3, "Closed")], "id long, name string")
    users = spark.createDataFrame([(f"User {j}", j + 500, f"u{j}@x" if j % 2 == 0 else None) for j in range(6)] + [("User 1", 999, "later@x")], "name string, id long, mailAddress string")
    return ingest.issue_items(ingest.events(payloads(spark, sf_dir)), statuses, users)


ITEM = ["event", "place", "op", "subject", "predicate", "object", "valid_from"]


def shown(made: DataFrame) -> DataFrame:
    return made.select("seq.event", "seq.place", *ITEM[2:])


@query("SELECT event_id AS event, (event_id % 4 + 1)::INTEGER AS type FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0")
def src_webhook(spark, sf_dir):
    """Payloads as they are pushed: some are cut off, some lack their content, some have a type that is no number."""
    sent = payloads(spark, sf_dir)
    cut, bare = F.substring("value", 1, 20), F.regexp_replace("value", '"content":', '"contents":')
    value = F.when(F.col("event") % 11 == 0, cut).when(F.col("event") % 13 == 0, bare).when(F.col("event") % 17 == 0, F.regexp_replace("value", r'"type":\d', '"type":"x"')).otherwise(F.col("value"))
    return ingest.events(sent.withColumn("value", value)).select("event", "type")


@query(f"WITH {PAYLOADS} SELECT * FROM it")
def ev_batch(spark, sf_dir):
    """All items of all events, in the order of their writes."""
    return shown(items(spark, sf_dir))


@query(f"WITH {PAYLOADS} SELECT * FROM it WHERE place BETWEEN 15 AND 1000")
def ev_diff(spark, sf_dir):
    """What updates say by their changes alone."""
    return shown(items(spark, sf_dir).where("seq.place between 15 and 1000"))


@query(f"WITH {PAYLOADS} SELECT * FROM it WHERE op = 'close'")
def ev_close(spark, sf_dir):
    return shown(items(spark, sf_dir).where("op = 'close'"))


@query(f"WITH {PAYLOADS}, n(id) AS (SELECT subject FROM it UNION SELECT object::BIGINT FROM it WHERE predicate IN ('in-project', 'assigned-to', 'created-by', 'on-issue', 'commented-by') AND object IS NOT NULL) SELECT id, CASE WHEN id < {PROJECT} THEN 'Person' WHEN id < {ISSUE} THEN 'Project' WHEN id < {COMMENT} THEN 'Issue' ELSE 'Comment' END AS type FROM n")
def ev_nodes(spark, sf_dir):
    return ingest.issue_nodes(items(spark, sf_dir)).select("id", "type")


@query(f"WITH {PAYLOADS}, h AS (SELECT * FROM it QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY valid_from DESC, event DESC, place DESC) = 1) SELECT subject, predicate, object, valid_from FROM h WHERE op = 'assert'")
def ev_head(spark, sf_dir):
    """The state of all issues after all events."""
    return facts.current(facts.guarded_head(items(spark, sf_dir))).select("subject", "predicate", "object", "valid_from")


@query(f"WITH {PAYLOADS}, i AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, event, place) AS until FROM it WHERE predicate IN ('status', 'assigned-to')) SELECT subject, predicate, object, valid_from AS began, until FROM i WHERE op = 'assert' AND (until IS NULL OR until > valid_from)")
def ev_history(spark, sf_dir):
    """Who had an issue and how it stood, from when until when."""
    return temporal.histories(items(spark, sf_dir).where("predicate in ('status', 'assigned-to')")).select("subject", "predicate", "object", "began", "until")


# Files: users are files, of which every event is an observation; some are folders, some shortcuts. Parts of its number say
# who has access; of every sixth event that isn't known.

H = lambda key: HASH_SQL.format(f"({key})")
FILES = f"""f0 AS (SELECT event_id AS ev, user_id AS u, floor(value)::BIGINT AS v, floor(epoch(ts))::BIGINT AS tm, CASE user_id % 10 WHEN 0 THEN 'folder' WHEN 1 THEN 'shortcut' ELSE 'document' END AS kind, event_id % 6 <> 0 AS known FROM events),
uh AS (SELECT u, {H("'f' || u")} AS h FROM (SELECT DISTINCT u FROM f0)), fh AS (SELECT k, {H("'d' || k")} AS h FROM range(5) r(k)), ph AS (SELECT k, {H("'p' || k")} AS h FROM range(12) r(k)),
f AS (SELECT f0.*, uh.h AS node, fh.h AS parent, ow.h AS own FROM f0 JOIN uh USING (u) JOIN fh ON fh.k = u % 5 JOIN ph ow ON ow.k = u % 12 WHERE kind <> 'shortcut'),
g AS (SELECT DISTINCT f.ev, f.node, f.tm, f.v, (f.v + o.o * 5) % 12 AS pk, o.o AS nth FROM f, (VALUES (0), (1), (2)) o(o) WHERE kind = 'document' AND known AND o.o <= v % 4 - 1),
gs AS (SELECT DISTINCT g.ev, g.node + {DOCUMENT} AS subject, g.tm, ph.h + {DRIVE} AS person FROM g JOIN ph ON ph.k = g.pk),
kd AS (SELECT ev, node + {DOCUMENT} AS subject, tm, lag(ev) OVER (PARTITION BY node ORDER BY ev) AS before FROM f WHERE kind = 'document' AND known),
rv AS (SELECT kd.subject, gs.person, kd.tm, kd.ev FROM kd JOIN gs ON gs.ev = kd.before AND gs.subject = kd.subject WHERE NOT EXISTS (SELECT 1 FROM gs n WHERE n.ev = kd.ev AND n.subject = kd.subject AND n.person = gs.person)),
fi(ev, op, subject, predicate, object, valid_from) AS (
SELECT ev, 'assert', node + {DOCUMENT}, 'doc-name', 'File ' || u || ' ' || v, tm FROM f WHERE kind = 'document'
UNION ALL SELECT ev, 'assert', node + {DOCUMENT}, 'mime-type', 'text/plain', tm FROM f WHERE kind = 'document'
UNION ALL SELECT ev, 'assert', node + {DOCUMENT}, 'in-folder', (parent + {FOLDER})::VARCHAR, tm FROM f WHERE kind = 'document'
UNION ALL SELECT ev, 'assert', node + {DOCUMENT}, 'owned-by', (own + {DRIVE})::VARCHAR, tm FROM f WHERE kind = 'document'
UNION ALL SELECT ev, 'assert', node + {FOLDER}, 'folder-name', 'File ' || u || ' ' || v, tm FROM f WHERE kind = 'folder'
UNION ALL SELECT ev, 'assert', node + {FOLDER}, 'parent-folder', (parent + {FOLDER})::VARCHAR, tm FROM f WHERE kind = 'folder'
UNION ALL SELECT ev, 'assert', own + {DRIVE}, 'name', 'Person ' || (u % 12), 0 FROM f WHERE kind = 'document'
UNION ALL SELECT g.ev, 'assert', h + {DRIVE}, 'name', 'Person ' || pk, 0 FROM g JOIN ph ON k = pk WHERE pk <> 7
UNION ALL SELECT g.ev, 'assert', h + {DRIVE}, 'name', '(deleted account)', 0 FROM g JOIN ph ON k = pk WHERE pk = 7
UNION ALL SELECT g.ev, 'assert', h + {DRIVE}, 'account-deleted', 'true', 0 FROM g JOIN ph ON k = pk WHERE pk = 7
UNION ALL SELECT ev, 'assert', subject, 'can-access', person::VARCHAR, tm FROM gs
UNION ALL SELECT ev, 'close', subject, 'can-access', person::VARCHAR, tm FROM rv)"""


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as they were observed (``ingest.FILE``)."""
    c, lit = F.col, F.lit
    none = lit(None).cast("string")
    v, u, e = F.floor("value").cast("long"), c("user_id"), table(spark, sf_dir, "events")
    text = lambda prefix, x: F.concat(lit(prefix), x.cast("string"))
    person = lambda k: F.struct(text("p", k).alias("id"), lit("user").alias("type"), F.when(k == u % 12, "owner").otherwise("reader").alias("role"), none.alias("emailAddress"), F.when(k != 7, text("Person ", k)).alias("displayName"), (k == 7).alias("deleted"))
    grants = F.transform(F.sequence(lit(0), lit(2)), lambda o: person((v + o * 5) % 12))
    wide = F.when(v % 9 == 8, F.array(F.struct(lit("w").alias("id"), lit("domain").alias("type"), lit("reader").alias("role"), none.alias("emailAddress"), none.alias("displayName"), lit(None).cast("boolean").alias("deleted")))).otherwise(F.array().cast(f"array<{ingest.GRANT}>"))
    known = F.concat(F.slice(grants, lit(1), (v % 4).cast("int")), wide)
    owner = F.array(F.struct(text("p", u % 12).alias("permissionId"), none.alias("emailAddress"), text("Person ", u % 12).alias("displayName")))
    mime = F.when(u % 10 == 0, ingest.FOLDER_KIND).when(u % 10 == 1, ingest.SHORTCUT_KIND).otherwise("text/plain")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(c("event_id").alias("event"), text("f", u).alias("id"), F.concat_ws(" ", lit("File"), u.cast("string"), v.cast("string")).alias("name"), mime.alias("mime"), none.alias("createdTime"), at.alias("modifiedTime"), F.array(text("d", u % 5)).alias("parents"), owner.alias("owners"), F.when(c("event_id") % 6 != 0, known).alias("permissions"))


@query(f"WITH {FILES} SELECT DISTINCT ev AS event, op, subject, predicate, object, valid_from FROM fi")
def fs_batch(spark, sf_dir):
    made = ingest.file_items(observed(spark, sf_dir))
    return made.select("seq.event", "op", "subject", "predicate", "object", "valid_from").distinct()


@query(f"WITH {FILES} SELECT ev AS event, subject, person, tm AS valid_from FROM rv")
def fs_revoke(spark, sf_dir):
    """Grants that a document's known grants lack, though those before had them."""
    made = ingest.revocations(observed(spark, sf_dir))
    return made.select("seq.event", "subject", F.col("object").cast("long").alias("person"), "valid_from")


@query(f"""WITH {FILES}, l AS (SELECT node + CASE kind WHEN 'folder' THEN {FOLDER} ELSE {DOCUMENT} END AS id, CASE kind WHEN 'folder' THEN 'Folder' ELSE 'Document' END AS type,
CASE WHEN NOT known THEN 3 WHEN v % 9 = 8 THEN 1 WHEN len(list_distinct(list_filter([CASE WHEN v % 4 >= 1 THEN v % 12 END, CASE WHEN v % 4 >= 2 THEN (v + 5) % 12 END, CASE WHEN v % 4 >= 3 THEN (v + 10) % 12 END], lambda k: k IS NOT NULL AND k <> 7 AND k <> u % 12))) > 1 THEN 2 ELSE 3 END AS label FROM f QUALIFY row_number() OVER (PARTITION BY node, kind ORDER BY ev DESC) = 1),
n AS (SELECT parent + {FOLDER} AS id, 'Folder' AS type, NULL AS label FROM f UNION SELECT person, 'Person', NULL FROM gs UNION SELECT own + {DRIVE}, 'Person', NULL FROM f WHERE kind = 'document')
SELECT id, type, max(label)::INTEGER AS label FROM (SELECT * FROM l UNION ALL SELECT * FROM n) GROUP BY id, type""")
def fs_label(spark, sf_dir):
    return ingest.file_nodes(observed(spark, sf_dir))


@query(f"""WITH {FILES}, t AS (SELECT (min(tm) + max(tm)) // 2 AS t FROM f0),
w AS (SELECT ev, subject, object, op FROM fi, t WHERE predicate = 'can-access' AND valid_from <= t QUALIFY row_number() OVER (PARTITION BY subject, object ORDER BY valid_from DESC, ev DESC, op DESC) = 1)
SELECT subject, string_agg(object, ',' ORDER BY object) AS persons FROM w WHERE op = 'assert' GROUP BY subject""")
def fs_grants(spark, sf_dir):
    """Who had access to what at the middle of all observations."""
    log = ingest.file_items(observed(spark, sf_dir)).where("predicate = 'can-access'")
    at = table(spark, sf_dir, "events").agg(F.floor((F.min(F.unix_seconds(F.col("ts").cast("timestamp"))) + F.max(F.unix_seconds(F.col("ts").cast("timestamp")))) / 2)).first()[0]
    held = facts.as_of(log, at, facts.ELEMENT)
    return held.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list("object")), ",").alias("persons"))


# Claims: documents are answered with what they are written in and how long they are; some answers are fenced, some broken.

ANSWERS = """d AS (SELECT doc_id AS doc, doc_id // 2 AS key, lang, source, coalesce(n_chars, 0) AS n, (doc_id % 3)::INTEGER AS tier, doc_id * 1000 AS tm FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 17 <> 3),
cl AS (SELECT doc, 0 AS nth, source AS subject, CASE WHEN doc % 4 = 0 THEN 'Origin' ELSE 'Source' END AS subject_type, 'written-in' AS predicate, lang AS object, CASE WHEN doc % 5 = 0 THEN 'Tongue' ELSE 'Language' END AS object_type, CASE WHEN doc % 2 = 0 THEN '2001-09-09T01:46:40Z' END AS effective_from, left('p' || repeat('ab', 600 + (doc % 3)::INTEGER), 1000) AS passage, CASE doc % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'implied' END AS confidence FROM d
UNION ALL SELECT doc, 2, source, 'Source', 'long', n::VARCHAR, NULL, NULL, NULL, NULL FROM d
UNION ALL SELECT doc, 5, lang, 'Language', 'secret-of', source, 'Source', NULL, NULL, 'explicit' FROM d WHERE doc % 6 = 0)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, answer): a fact with types missing or empty, one of no known predicate, a value, one whose object isn't text,
    something that is no fact, and one with a floor; every seventeenth answer is cut off."""
    c, lit = F.col, F.lit
    d = table(spark, sf_dir, "documents").where("source is not null and lang is not null")
    doc, none = c("doc_id"), lit(None).cast("string")
    one = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in x.items()]))
    words = {0: "explicit", 1: "implied"}
    confidence = F.when(doc % 3 == 0, words[0]).when(doc % 3 == 1, words[1]).otherwise("certain")
    first = one(subject=F.concat(lit(" "), c("source"), lit("\t")), subjectType=F.when(doc % 4 == 0, "Origin").when(doc % 4 == 1, ""), predicate=lit("written-in"), object=c("lang"), objectType=F.when(doc % 5 == 0, "Tongue").when(doc % 5 == 1, ""), effectiveFrom=F.when(doc % 2 == 0, " 2001-09-09T01:46:40Z"), passage=F.concat(lit("  p"), F.repeat(lit("ab"), (doc % 3 + 600).cast("int"))), confidence=confidence)
    other = one(subject=c("source"), predicate=lit("rumoured"), object=c("lang"))
    long = one(subject=c("source"), predicate=lit("long"), object=F.coalesce("n_chars", lit(0)).cast("string"), objectType=lit("Number"))
    odd = one(subject=c("source"), predicate=lit("long"), object=F.coalesce("n_chars", lit(0)))
    secret = one(subject=c("lang"), predicate=lit("secret-of"), object=c("source"), confidence=lit("explicit"))
    parts = F.concat_ws(", ", first, other, long, odd, lit("7"), F.when(doc % 6 == 0, secret))
    text = F.concat(lit('{"facts": ['), parts, lit("]}"))
    text = F.when(doc % 17 == 3, F.substring(text, 1, 40)).when(doc % 2 == 0, F.concat(lit("Sure {as asked}:\n```json\n"), text, lit("\n```\nthat's all {}"))).otherwise(F.concat(lit("Here it is: "), text, lit(" (end)")))
    return d.select(doc.alias("doc"), text.alias("answer"))


PATTERN = [("written-in", "Source", "Language", "edge"), ("long", "Source", None, "value"), ("secret-of", "Language", "Source", "edge"), ("language-name", "Language", None, "value")]


def pattern(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERN, "name string, `from` string, `to` string, kind string")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parsed_claims(answers(spark, sf_dir), pattern(spark))


@query(f"WITH {ANSWERS} SELECT * FROM cl")
def cl_parse(spark, sf_dir):
    return claims(spark, sf_dir)


ENTITY = HASH_SQL.format("(key || '|' || {0} || '|' || {1})") + " + 2251799813685248"
MINTED = f"""{ANSWERS}, mi AS (SELECT cl.*, key, tier, tm, subject_type IN ('Source', 'Language') AS sok, subject_type IN ('Source', 'Language') AND coalesce(object_type IN ('Source', 'Language'), true) AS said, CASE predicate WHEN 'secret-of' THEN 3 WHEN 'written-in' THEN 1 ELSE 0 END AS floor FROM cl JOIN d USING (doc)),
en AS (SELECT doc, key, tm, subject_type AS type, subject AS name, greatest(tier, floor) AS lv FROM mi WHERE sok UNION ALL SELECT doc, key, tm, object_type, object, greatest(tier, floor) FROM mi WHERE said AND object_type IS NOT NULL),
ids AS (SELECT key, type, name, {ENTITY.format('type', 'name')} AS id FROM (SELECT DISTINCT key, type, name FROM en))"""


def mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with what they mint. Two documents next to each other are revisions of one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.floor(F.col("doc_id") / 2).alias("key"), (F.col("doc_id") % 3).cast("int").alias("tier"), (F.col("doc_id") * 1000).alias("at"))
    types = spark.createDataFrame([("Source",), ("Language",)], "type string")
    floors = spark.createDataFrame([("secret-of", 3), ("secret-of", 2), ("written-in", 1)], "predicate string, floor int")
    return parsing.minted(claims(spark, sf_dir), docs, types, floors)


@query(f"""WITH {MINTED} SELECT s.id AS subject, predicate, coalesce(o.id::VARCHAR, object) AS object, CASE WHEN effective_from IS NOT NULL THEN 1000000000 ELSE tm END AS valid_from, 'drive:' || doc AS source, passage, confidence
FROM mi JOIN ids s ON s.key = mi.key AND s.type = subject_type AND s.name = subject LEFT JOIN ids o ON o.key = mi.key AND o.type = object_type AND o.name = object WHERE said
UNION ALL SELECT DISTINCT id, 'source-name', name, tm, 'drive:' || doc, NULL, NULL FROM en JOIN ids USING (key, type, name) WHERE type = 'Source'""")
def cl_batch(spark, sf_dir):
    return parsing.claim_items(mints(spark, sf_dir), pattern(spark))


@query(f"WITH {MINTED} SELECT id, type, max(lv) AS label FROM en JOIN ids USING (key, type, name) GROUP BY id, type")
def ag_ratchet(spark, sf_dir):
    """The label of each entity: the strictest of all claims that mint it."""
    return parsing.claim_nodes(mints(spark, sf_dir))


@query(f"WITH {MINTED}, n AS (SELECT id, type, max(lv) AS label FROM en JOIN ids USING (key, type, name) GROUP BY id, type) SELECT id, ((6 >> label) & 1) = 0 AS denied, CASE WHEN ((6 >> label) & 1) = 1 THEN type END AS type FROM n")
def cl_masked(spark, sf_dir):
    """Those entities as a reader sees them who may read labels 1 and 2."""
    seen = fn.visible(F.col("label"), 6)
    return parsing.claim_nodes(mints(spark, sf_dir)).select("id", (~seen).alias("denied"), F.when(seen, F.col("type")).alias("type"))


@query(f"WITH {MINTED} SELECT doc, max(floor) AS floor FROM mi WHERE said GROUP BY doc HAVING max(floor) > 0")
def cl_floor(spark, sf_dir):
    """Only what is said counts: a claim that is dropped for its object has no floor."""
    return parsing.document_floors(mints(spark, sf_dir))


@query(f"WITH {MINTED} SELECT {HASH_SQL.format('key::VARCHAR')} + 2533274790395904 AS family, type || '|' || name AS entity FROM ids WHERE NOT (type = 'Language' AND name = 'en')")
def cl_family(spark, sf_dir):
    """What each family of revisions newly names; that some are in English was known."""
    rows = mints(spark, sf_dir)
    known = rows.select((fn.hash48(F.col("key").cast("string")) + fn.BANDS["family"]).alias("family"), F.lit("Language|en").alias("entity")).distinct()
    return parsing.family_keys(rows, known)
