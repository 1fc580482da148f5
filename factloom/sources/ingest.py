"""What sources say, as items of the fact log in the order in which they are written.

An item is (seq, op, subject, predicate, object, valid_from, valid_to): ``seq`` is the struct (event, place), the number of
what was observed and the place of the item in it, so that a value and its close at one instant are told apart. Items of an
event come in the order defined here: who and what it is about, then what it says, last what it ends. Predicates are those
that the scans and reviews of the library read. Nodes are (id, type, label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import BANDS, epoch_or_zero, hash48, trimmed
from ..operators.people import DELETED

PERSON = "struct<id: long, name: string, mailAddress: string>"
PAYLOAD = f"type int, project struct<id: long, projectKey: string, name: string>, content struct<id: long, key_id: long, summary: string, status: struct<id: long, name: string>, assignee: {PERSON}, comment: struct<id: long, content: string>, changes: array<struct<field: string, old_value: string, new_value: string>>>, createdUser {PERSON}, created string"

# Fields of changes with the predicate of an issue that they are of; other fields are of none.
FIELDS = {"assigner": "assigned-to", "assignee": "assigned-to", "summary": "summary", "status": "status"}
FOLDER_KIND, SHORTCUT_KIND = "application/vnd.google-apps.folder", "application/vnd.google-apps.shortcut"
PLACES = 8  # items that a change may make


def events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Payloads (event, value) that have a numeric type, a content and a project; the rest says nothing."""
    made = raw.select("event", F.from_json(column, PAYLOAD).alias("e")).select("event", "e.*")
    return made.where("type is not null and content is not null and project is not null")


def _said(subject: Column, predicate: str | Column, obj: Column, op: str = "assert") -> Column:
    named = predicate if isinstance(predicate, Column) else F.lit(predicate)
    return F.struct(F.lit(op).alias("op"), subject.cast("long").alias("subject"), named.alias("predicate"), obj.cast("string").alias("object"))


def _nothing() -> Column:
    return F.lit(None).cast("string")


def _log(rows: DataFrame) -> DataFrame:
    """Rows (event, place, i, at) as items; those without a subject, and values without an object, aren't said."""
    made = rows.select(F.struct("event", F.col("place").cast("long").alias("place")).alias("seq"), "i.*", F.col("at").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return made.where("subject is not null and predicate is not null and (object is not null or op = 'close')")


def _blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def issue_items(some: DataFrame, statuses: DataFrame, users: DataFrame) -> DataFrame:
    """Items of created (1), updated (2) and commented (3) issues; other types say nothing.

    An event says what its snapshot holds. Changes of an update fill in what the snapshot lacks: a status by its number in
    ``statuses`` (id, name), or as it is if unknown; an assignee by name in ``users`` (name, id, mailAddress), of several of a
    name the least id, who gets a name and an address too, or not at all if unknown; a summary. A field that held something
    and holds nothing but blanks now is closed. Of fields that change twice in an event, the later place is the later write.
    Who created an issue is said on creation only, so that later actors don't displace them.
    """
    b, c = BANDS, F.col
    e = some.where("type in (1, 2, 3)").withColumn("at", epoch_or_zero(c("created")))
    issue, project, comment = c("content.id") + b["issue"], c("project.id") + b["issue_project"], c("content.comment.id") + b["issue_comment"]
    author, assignee = c("createdUser.id") + b["issue_person"], c("content.assignee.id") + b["issue_person"]
    who = lambda id_, x: [_said(id_, "name", c(f"{x}.name")), _said(id_, "email", F.nullif(c(f"{x}.mailAddress"), F.lit("")))]
    key = F.concat(c("project.projectKey"), F.lit("-"), c("content.key_id").cast("string"))
    talk = F.when(c("type") == 3, comment)
    said = [_said(project, "project-name", c("project.name")), _said(project, "project-key", c("project.projectKey")), *who(author, "createdUser"), _said(issue, "issue-key", key), _said(issue, "summary", c("content.summary")), _said(issue, "status", c("content.status.name")), _said(issue, "in-project", project), *who(assignee, "content.assignee"), _said(issue, "assigned-to", assignee), _said(F.when(c("type") == 1, issue), "created-by", author)]
    said += [_said(talk, "content", c("content.comment.content")), _said(talk, "on-issue", issue), _said(talk, "commented-by", author)]
    direct = _log(e.select("event", "at", F.posexplode(F.array(*said)).alias("place", "i")))

    named = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])
    ch = e.where("type = 2").select("event", "at", issue.alias("issue"), "content.status", "content.assignee", "content.summary", F.posexplode("content.changes").alias("nth", "x"))
    ch = ch.withColumn("predicate", F.try_element_at(named, c("x.field"))).where("predicate is not null").withColumn("new", c("x.new_value"))
    cleared = ch.where(~_blank(c("x.old_value")) & _blank(c("new")))
    # closes are the last items of their event
    closes = _log(cleared.select("event", (c("nth") + 2**40).alias("place"), _said(c("issue"), c("predicate"), _nothing(), "close").alias("i"), "at"))
    filled = ch.where(~_blank(c("new"))).withColumn("place", len(said) + c("nth") * PLACES)
    texts = filled.where("predicate = 'summary' and summary is null").select("event", "place", _said(c("issue"), "summary", c("new")).alias("i"), "at")
    known = statuses.groupBy(c("id").cast("string").alias("new")).agg(F.min("name").alias("named"))
    states = filled.where("predicate = 'status' and status is null").join(known, "new", "left").select("event", "place", _said(c("issue"), "status", F.coalesce("named", "new")).alias("i"), "at")
    people = users.groupBy(c("name").alias("new")).agg(F.min(F.struct("id", "mailAddress")).alias("u"))
    person = c("u.id") + b["issue_person"]
    made = filled.where("predicate = 'assigned-to' and assignee is null").join(people, "new")
    each = F.array(_said(person, "name", c("new")), _said(person, "email", F.nullif(c("u.mailAddress"), F.lit(""))), _said(c("issue"), "assigned-to", person))
    moved = made.select("event", "place", "at", F.posexplode(each).alias("k", "i")).select("event", (c("place") + c("k")).alias("place"), "i", "at")
    return direct.unionByName(_log(texts)).unionByName(_log(states)).unionByName(_log(moved)).unionByName(closes)


def issue_nodes(items: DataFrame) -> DataFrame:
    """(id, type, label) of what ``issue_items`` are about or lead to; none has a label."""
    b, c = BANDS, F.col
    to = F.when(c("predicate").isin("in-project", "assigned-to", "created-by", "on-issue", "commented-by"), c("object").try_cast("long"))
    ids = items.select(F.explode(F.array_compact(F.array("subject", to))).alias("id")).distinct()
    band = F.when(c("id") < b["issue_project"], "Person").when(c("id") < b["issue"], "Project").when(c("id") < b["issue_comment"], "Issue").otherwise("Comment")
    return ids.select("id", band.alias("type"), F.lit(None).cast("int").alias("label"))


# Files

OWNER = "struct<permissionId: string, emailAddress: string, displayName: string>"
GRANT = "struct<id: string, type: string, role: string, emailAddress: string, displayName: string, deleted: boolean>"
FILE = f"event long, id string, name string, mime string, createdTime string, modifiedTime string, parents array<string>, owners array<{OWNER}>, permissions array<{GRANT}>"


def _file_person(*keys: Column) -> Column:
    """A person's id by the first key that is there; none if that is empty."""
    return hash48(F.nullif(F.coalesce(*keys), F.lit(""))) + F.when(F.nullif(F.coalesce(*keys), F.lit("")).isNotNull(), BANDS["file_person"])


def _files(files: DataFrame) -> DataFrame:
    """Files as they were observed, with id, instant and whether they are folders; shortcuts must be followed before."""
    c = F.col
    mime = F.coalesce("mime", F.lit(""))
    rows = files.where(mime != SHORTCUT_KIND).withColumn("folder", mime == FOLDER_KIND)
    node = hash48(c("id")) + F.when(c("folder"), BANDS["folder"]).otherwise(BANDS["document"])
    first, owner = F.get("parents", F.lit(0)), F.get("owners", F.lit(0))
    made = F.struct(node.alias("node"), F.when(first.isNotNull(), hash48(first) + BANDS["folder"]).alias("parent"), F.when(~c("folder"), _file_person(owner["permissionId"], owner["emailAddress"])).alias("owner_id"), epoch_or_zero(F.coalesce("modifiedTime", "createdTime")).alias("at"))
    return rows.select("*", F.inline(F.array(made)))  # hashed once, wherever they are read


def granted(files: DataFrame) -> DataFrame:
    """(event, node, at, nth, p, person) of each user's grant of each document of which the grants are known."""
    rows = _files(files).where("not folder").select("event", "node", "at", F.posexplode("permissions").alias("nth", "p")).where("p.type = 'user'")
    return rows.select("*", F.inline(F.array(F.struct(_file_person(F.col("p.id"), F.col("p.emailAddress")).alias("person"))))).where("person is not null")


def file_items(files: DataFrame) -> DataFrame:
    """Items of files (FILE), a row for each time that one was observed.

    A folder has a name and a parent; a document name, kind, folder, owner and a grant for each user, those of deleted
    accounts too. Groups, domains and anyone have no grant: labels tell of them. Who persons are is said as of 0, whichever
    file says it. A grant that the file's last known grants had and these lack is closed at the file's instant; grants that
    aren't known (null) neither close nor change anything.
    """
    c = F.col
    rows = _files(files)
    parent, owner, owner_id = c("parent"), F.get("owners", F.lit(0)), c("owner_id")
    doc = F.when(~c("folder"), c("node"))
    fold = F.when(c("folder"), c("node"))
    title = F.coalesce("name", "id")
    said = [_said(doc, "doc-name", title), _said(doc, "mime-type", c("mime")), _said(doc, "in-folder", parent), _said(doc, "owned-by", owner_id), _said(fold, "folder-name", title), _said(fold, "parent-folder", parent)]
    direct = _log(rows.select("event", "at", F.posexplode(F.array(*said)).alias("place", "i")))
    about = lambda id_, name, email, deleted: F.array(_said(id_, "name", F.nullif(name, F.lit(""))), _said(id_, "email", F.nullif(email, F.lit(""))), _said(F.when(deleted, id_), "name", F.lit(DELETED)), _said(F.when(deleted, id_), "account-deleted", F.lit("true")))
    zero = F.lit(0).cast("long").alias("at")
    owners = rows.where(owner_id.isNotNull()).select("event", zero, F.posexplode(about(owner_id, owner["displayName"], owner["emailAddress"], F.lit(False))).alias("k", "i")).select("event", (c("k") + 10).alias("place"), "i", "at")
    grants = granted(files)
    persons = grants.select("event", "nth", zero, F.posexplode(about(c("person"), c("p.displayName"), c("p.emailAddress"), F.coalesce("p.deleted", F.lit(False)))).alias("k", "i")).select("event", (20 + c("nth") * PLACES + c("k")).alias("place"), "i", "at")
    access = grants.select("event", (20 + c("nth") * PLACES + 5).alias("place"), _said(c("node"), "can-access", c("person")).alias("i"), "at")
    return direct.unionByName(_log(owners)).unionByName(_log(persons)).unionByName(_log(access)).unionByName(revocations(files))


def revocations(files: DataFrame) -> DataFrame:
    """Closes of grants that went: successive sets of a document's known grants, each against the one before."""
    c = F.col
    known = _files(files).where("not folder and permissions is not null").select("event", "node", "at")
    sets = known.join(granted(files).groupBy("event", "node").agg(F.array_sort(F.collect_set("person")).alias("has")), ["event", "node"], "left").withColumn("has", F.coalesce("has", F.array().cast("array<long>")))
    w = Window.partitionBy("node").orderBy("event")
    gone = sets.withColumn("gone", F.array_except(F.lag("has").over(w), "has")).where(F.size("gone") > 0)
    return _log(gone.select("event", "at", "node", F.posexplode("gone").alias("k", "person")).select("event", (c("k") + 2**40).alias("place"), _said(c("node"), "can-access", c("person"), "close").alias("i"), "at"))


def file_nodes(files: DataFrame) -> DataFrame:
    """(id, type, label) of files, folders that hold them, and persons; a file's label is that of its last observation."""
    c = F.col
    rows = _files(files)
    own = rows.withColumn("label", access_tier(c("permissions")))
    own = own.groupBy("node").agg(F.max_by(F.struct("folder", "label"), "event").alias("x")).select(c("node").alias("id"), F.when(c("x.folder"), "Folder").otherwise("Document").alias("type"), c("x.label").alias("label"))
    none = F.lit(None).cast("int").alias("label")
    parents = rows.where("parent is not null").select(c("parent").alias("id"), F.lit("Folder").alias("type"), none)
    persons = granted(files).select("person").union(rows.select("owner_id")).where("person is not null").select(c("person").alias("id"), F.lit("Person").alias("type"), none)
    return own.unionByName(parents).unionByName(persons).groupBy("id", "type").agg(F.max("label").alias("label"))


def access_tier(permissions: Column) -> Column:
    """3 if the grants are unknown, or the owner and one other have any; 2 for groups or several; 1 for a domain or anyone.
    Grants of deleted accounts don't widen it."""
    live = F.filter(permissions, lambda p: ~F.coalesce(p["deleted"], F.lit(False)))
    has = lambda *kinds: F.exists(live, lambda p: p["type"].isin(*kinds))
    others = F.array_distinct(F.array_compact(F.transform(F.filter(live, lambda p: ~F.coalesce(p["role"] == "owner", F.lit(False))), lambda p: F.nullif(F.coalesce(p["id"], p["emailAddress"]), F.lit("")))))
    return F.when(permissions.isNull(), 3).when(has("domain", "anyone"), 1).when(has("group") | (F.size(others) > 1), 2).otherwise(3)
