"""Candidates for a human's verdict over the fact log, their order for review, and the facts that a verdict leaves.

Each scan reads heads of a few predicates and joins them; there is no budget of nodes or reads. A fact that a verdict
leaves is (subject, predicate, object, valid_from, source); its instant is null where none is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import BANDS, hash48, hex_id, person_band
from . import facts, patterns, people
from .graph import checkpointed, closure

# Templates of patterns with their predicates, and the order in which their candidates are listed.
TEMPLATES = {"doc-access-scope": "can-access", "issue-assignee": "assigned-to", "comment-author": "commented-by", "doc-access": "can-access"}
FAMILIES = {"hr": "HR", "issues": "Backlog", "drive": "Drive"}
NAME_PREDICATES = ("name", "title", "dept-name", "project-name")


def values(log: DataFrame, predicate: str, name: str) -> DataFrame:
    """(id, ``name``, at): the current value of a predicate of one."""
    head = facts.current(facts.guarded_head(log.where(F.col("predicate") == predicate)))
    return head.select(F.col("subject").alias("id"), F.col("object").alias(name), F.coalesce("valid_from", F.lit(0)).cast("long").alias("at"))


def nodes(log: DataFrame, predicate: str, name: str) -> DataFrame:
    return values(log, predicate, name).withColumn(name, F.col(name).cast("long"))


def elements(log: DataFrame, predicate: str, name: str) -> DataFrame:
    """(id, ``name``): the current elements of a predicate of many."""
    return facts.expand(log, predicate).select(F.col("subject").alias("id"), F.col("object").cast("long").alias(name))


def linked(log: DataFrame, predicate: str = "same-as") -> DataFrame:
    """(id, other): elements of a symmetric predicate, both ways."""
    return facts.expand(log, predicate, symmetric=True).select(F.col("subject").cast("long").alias("id"), F.col("object").cast("long").alias("other"))


def display_names(log: DataFrame, predicates: tuple[str, ...] = NAME_PREDICATES) -> DataFrame:
    """(id, name): the first of the predicates that says anything."""
    head = facts.current(facts.guarded_head(log.where(F.col("predicate").isin(*predicates)))).where("object != ''")
    place = F.array_position(F.array(*map(F.lit, predicates)), F.col("predicate"))
    return head.groupBy(F.col("subject").alias("id")).agg(F.min_by("object", place).alias("name"))


def event_groups(log: DataFrame) -> DataFrame:
    """(template, group, id, targets, at): issues by project with their assignee, comments by their issue's project with
    their author, documents by folder with all who have access. What has no group is left out, what has no target isn't."""
    none = F.array().cast("array<long>")

    def one(rows: DataFrame, template: str) -> DataFrame:
        said = nodes(log, TEMPLATES[template], "target")
        targets = F.when(F.col("target").isNull(), none).otherwise(F.array("target"))
        return rows.join(said, "id", "left").select(F.lit(template).alias("template"), "group", "id", targets.alias("targets"), F.coalesce("at", F.lit(0)).alias("at"))

    projects = nodes(log, "in-project", "group").drop("at")
    comments = nodes(log, "on-issue", "issue").drop("at").join(projects.withColumnRenamed("id", "issue"), "issue").select("id", "group")
    access = elements(log, "can-access", "target").groupBy("id").agg(F.array_sort(F.collect_set("target")).alias("targets"))  # a document's grants
    docs = nodes(log, "in-folder", "group").join(access, "id", "left").select(F.lit("doc-access").alias("template"), "group", "id", F.coalesce("targets", none).alias("targets"), "at")
    return one(projects, "issue-assignee").unionByName(one(comments, "comment-author")).unionByName(docs)


def pattern_candidates(events: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """(pattern_id, template, group, predicate, first, second, support, total, exceptions, omitted, window_from, window_to,
    place) of ``event_groups``: who has nearly every document once, then groups by what most of their events agree on.

    ``place`` orders the templates; coverage, then total order what a reviewer sees. Dismissed (pattern_id) are left out.
    """
    events = checkpointed(events)  # read a dozen times below
    docs = events.where("template = 'doc-access'")
    scope = checkpointed(patterns.ubiquitous(docs))
    own = patterns.stripped(docs, scope).unionByName(events.where("template != 'doc-access'"))
    mined = patterns.mine(own.select(F.struct("template", "group").alias("group"), "id", "targets", "at"))
    mined = mined.select(F.col("group.template").alias("template"), F.col("group.group").alias("group"), *[c for c in mined.columns if c != "group"])
    wide = patterns.scope_patterns(docs, scope).select(F.lit("doc-access-scope").alias("template"), F.col("target").alias("group"), F.col("target").alias("first"), F.lit(None).cast("long").alias("second"), "support", "total", "exceptions", "omitted", "window_from", "window_to")
    some = wide.unionByName(mined)
    predicate = F.element_at(F.create_map(*[F.lit(x) for pair in TEMPLATES.items() for x in pair]), F.col("template"))
    place = F.array_position(F.array(*map(F.lit, TEMPLATES)), F.col("template")).cast("int")
    out = some.withColumn("predicate", predicate).withColumn("pattern_id", hex_id("p", F.concat_ws("|", "template", F.col("group").cast("string"), "predicate"))).withColumn("place", place)
    return out if dismissed is None else out.join(dismissed, "pattern_id", "left_anti")


def pattern_order() -> list[Column]:
    return [F.desc(F.col("support") / F.col("total")), F.desc("total")]


def pattern_facts(verdicts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts of candidates with a ``verdict`` (promote, risk): title, support, total and targets of a node of its own, as
    of the last event counted."""
    kind = F.when(F.col("verdict") == "promote", "rule").otherwise("risk")
    called = lambda key: names.select(F.col("id").alias(key), F.col("name").alias(f"{key}_name"))
    rows = verdicts.withColumn("kind", kind).join(called("group"), "group", "left").join(called("first"), "first", "left").join(called("second"), "second", "left")
    label = lambda key: F.coalesce(f"{key}_name", F.col(key).cast("string"))
    title = F.concat(label("group"), F.lit(": "), F.col("predicate"), F.lit(" → "), F.concat_ws(", ", label("first"), F.when(F.col("second").isNotNull(), label("second"))), F.lit(" ("), F.col("support"), F.lit("/"), F.col("total"), F.lit(")"))
    said = lambda what, value: F.struct(F.concat("kind", F.lit(what)).alias("predicate"), value.cast("string").alias("object"))
    each = F.array(said("-title", title), said("-support", F.col("support")), said("-total", F.col("total")), said("-target", F.col("first")), said("-target", F.col("second")))
    subject = hash48(F.concat("kind", F.lit(":"), "pattern_id")) + BANDS["pattern"]
    return rows.select(subject.alias("subject"), F.col("window_to").alias("valid_from"), F.explode(each).alias("f")).where("f.object is not null").select("subject", "f.predicate", "f.object", "valid_from", F.lit("pattern-review").alias("source"))


def persons(log: DataFrame) -> DataFrame:
    """(id, name, email, band) of the log's persons, by id band."""
    said = values(log, "name", "name").drop("at").join(values(log, "email", "email").drop("at"), "id", "full_outer")
    return said.withColumn("band", person_band(F.col("id"))).where("band is not null")


def identity_candidates(log: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(a, b, tier, confirmed, dismissed, rank): open pairs first, then confirmed, then dismissed; e-mail before name. A pair
    is confirmed if what is stored connects its ends, directly or over other accounts."""
    gone = dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("gone")).distinct()
    roots = closure(linked(log).select(F.col("id").alias("a"), F.col("other").alias("b")))
    of = lambda key: roots.select(F.col("id").alias(key), F.col("root").alias(f"{key}_root"))
    rows = people.identity_pairs(persons(log)).join(of("a"), "a", "left").join(of("b"), "b", "left").join(gone, ["a", "b"], "left")
    rows = rows.select("a", "b", "tier", F.coalesce(F.col("a_root") == F.col("b_root"), F.lit(False)).alias("confirmed"), F.coalesce("gone", F.lit(False)).alias("dismissed"))
    return rows.withColumn("rank", _rank(F.col("tier") == "email"))


def _rank(strong: Column) -> Column:
    state = F.when(F.col("confirmed"), 2).when(F.col("dismissed"), 4).otherwise(0)
    return state + F.when(strong, 0).otherwise(1)


def policy_targets(candidates: DataFrame) -> DataFrame:
    """What a policy on equal e-mails confirms by itself."""
    return candidates.where("tier = 'email' and not confirmed and not dismissed")


def identity_facts(confirmed: DataFrame) -> DataFrame:
    """Facts of confirmed pairs (a, b, reviewer, note): the edge once, the review on both."""
    said = lambda subject, predicate, value: F.struct(F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), value.cast("string").alias("object"))
    both = [said(x, k, v) for x in "ab" for k, v in (("identity-review", F.lit("confirmed")), ("identity-reviewed-by", F.col("reviewer")), ("identity-review-note", F.nullif("note", F.lit(""))))]
    return _facts(confirmed, [said("a", "same-as", F.col("b")), *both], F.lit(None).cast("long"), "identity-review")


def _facts(rows: DataFrame, each: list[Column], at: Column, source: str) -> DataFrame:
    made = rows.select(F.explode(F.array(*each)).alias("f"), at.alias("valid_from")).where("f.object is not null")
    return made.select("f.*", "valid_from", F.lit(source).alias("source"))


def approval_candidates(log: DataFrame, dismissed: DataFrame, **phrases: tuple[str, ...]) -> DataFrame:
    """(comment, issue, approver, approver_name, summary, at, snippet, phrase, tier, confirmed, dismissed, rank) of comments
    that approve; those without an issue or an author are left out. Newest first within a rank."""
    said = values(log, "content", "text")
    hits = people.approvals(said.select("id", "text"), **phrases).join(said.select("id", "at"), "id")
    rows = hits.join(nodes(log, "on-issue", "issue").drop("at"), "id").join(nodes(log, "commented-by", "approver").drop("at"), "id").withColumnRenamed("id", "comment")
    by = nodes(log, "approved-by", "by").select(F.col("id").alias("issue"), "by")
    rows = rows.join(by, "issue", "left").join(values(log, "summary", "summary").select(F.col("id").alias("issue"), "summary"), "issue", "left")
    rows = rows.join(values(log, "name", "approver_name").select(F.col("id").alias("approver"), "approver_name"), "approver", "left")
    rows = rows.join(dismissed.select("comment", "issue", F.lit(True).alias("gone")).distinct(), ["comment", "issue"], "left")
    rows = rows.withColumn("confirmed", F.col("by").eqNullSafe(F.col("approver"))).withColumn("dismissed", F.coalesce("gone", F.lit(False)))
    return rows.drop("by", "gone").withColumn("rank", _rank(F.col("tier") == "formal"))


def approver_contexts(log: DataFrame, approvers: DataFrame) -> DataFrame:
    """(id, comments, assigned, created, accounts) of approvers (id) of whom anything is known: how often they comment, are
    assigned and create, and their linked accounts by name and family; none is null."""
    kinds = {"commented-by": "comments", "assigned-to": "assigned", "created-by": "created"}
    head = facts.current(facts.guarded_head(log.where(F.col("predicate").isin(*kinds))))
    counts = head.groupBy(F.col("object").cast("long").alias("id")).agg(*[F.nullif(F.count_if(F.col("predicate") == p), F.lit(0)).alias(n) for p, n in kinds.items()])
    named = linked(log).join(values(log, "name", "name").select(F.col("id").alias("other"), "name"), "other", "left")
    accounts = named.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(account_label(F.col("other"), F.col("name")))), "; ").alias("accounts"))
    known = approvers.select("id").distinct().join(counts, "id", "left").join(accounts, "id", "left")
    return known.where(F.coalesce("comments", "assigned", "created").isNotNull() | F.col("accounts").isNotNull())


def account_label(id_: Column, name: Column) -> Column:
    """A name, or else the id, with the family of sources that the account is of."""
    family = F.element_at(F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair]), person_band(id_))
    return F.concat(F.coalesce(name, id_.cast("string")), F.coalesce(F.concat(F.lit(" ("), family, F.lit(")")), F.lit("")))


def approval_facts(confirmed: DataFrame) -> DataFrame:
    """Facts of confirmed approvals (issue, approver, at, reviewer, note): the decision from the comment's instant on, the
    review without one."""
    said = lambda predicate, value, at: F.struct(F.col("issue").alias("subject"), F.lit(predicate).alias("predicate"), value.cast("string").alias("object"), at.cast("long").alias("valid_from"))
    none = F.lit(None)
    each = F.array(said("approved-by", F.col("approver"), F.col("at")), said("approved-at", F.col("at"), F.col("at")), said("approval-review", F.lit("confirmed"), none), said("approval-reviewed-by", F.col("reviewer"), none), said("approval-review-note", F.nullif("note", F.lit("")), none))
    return confirmed.select(F.explode(each).alias("f")).where("f.object is not null").select("f.*", F.lit("approval-review").alias("source"))


def project_activity(events: DataFrame) -> DataFrame:
    """(person, project): who is assigned to or comments on issues of a project."""
    return events.where("template in ('issue-assignee', 'comment-author')").select(F.explode("targets").alias("person"), F.col("group").alias("project")).distinct()


def inference_candidates(log: DataFrame, events: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(doc, project, support, resolved, tier, confirmed, dismissed, filled): documents' projects by what those with access
    do. ``filled`` ones, on which all agree, need no verdict; open ones come first, then by share."""
    grants = events.where("template = 'doc-access'").select(F.col("id").alias("doc"), F.explode("targets").alias("person"))
    rows = people.document_projects(grants, project_activity(events), linked(log))
    stored = elements(log, "relates-to-project", "project").select(F.col("id").alias("doc"), "project", F.lit(True).alias("stored"))
    gone = dismissed.select("doc", "project", F.lit(True).alias("gone")).distinct()
    rows = rows.join(stored, ["doc", "project"], "left").join(gone, ["doc", "project"], "left")
    return rows.select("doc", "project", "support", "resolved", "tier", F.coalesce("stored", F.lit(False)).alias("confirmed"), F.coalesce("gone", F.lit(False)).alias("dismissed"), (F.col("tier") == "high").alias("filled"))


def inference_order() -> list[Column]:
    return [F.col("confirmed") | F.col("dismissed"), F.desc(F.col("support") / F.col("resolved"))]


def inference_facts(confirmed: DataFrame) -> DataFrame:
    """One fact for each confirmed (doc, project, at) that wasn't unanimous."""
    return confirmed.where("tier = 'ambiguous'").select(F.col("doc").alias("subject"), F.lit("relates-to-project").alias("predicate"), F.col("project").cast("string").alias("object"), "at", F.lit("inference-review").alias("source")).withColumnRenamed("at", "valid_from")


def conformance_gaps(verdicts: DataFrame, names: DataFrame, log: DataFrame) -> DataFrame:
    """(id, label, verdict, kind, reason, decision, reviewer) of verdicts (id, verdict, why, required, actual, as_of) that are
    absent or a mismatch: why in words with names, and what a human said of it."""
    called = lambda key, column: names.select(F.col("id").alias(column), F.col("name").alias(key))
    rows = verdicts.where("verdict in ('ABSENT', 'MISMATCH')").join(called("own", "id"), "id", "left").join(called("req", "required"), "required", "left").join(called("act", "actual"), "actual", "left")
    label = lambda name, id_: F.when(F.col(id_).isNull(), "—").otherwise(F.concat(F.coalesce(F.concat(F.col(name), F.lit(" (#")), F.lit("#")), F.col(id_), F.when(F.col(name).isNotNull(), ")").otherwise("")))
    req, act = label("req", "required"), label("act", "actual")
    absent = F.concat(F.lit("nothing is there where "), req, F.lit(" is required"))
    stale = F.concat(act, F.lit(" held it before, but not as of "), F.coalesce(F.col("as_of").cast("string"), F.lit("now")), F.lit("; required is "), req)
    wrong = F.concat(act, F.lit(" is not "), req)
    reason = F.when(F.col("verdict") == "ABSENT", absent).when(F.col("why") == "stale", stale).otherwise(wrong)
    human = values(log, "review-decision", "decision").drop("at").join(values(log, "reviewed-by", "reviewer").drop("at"), "id", "left")
    return rows.join(human, "id", "left").select("id", label("own", "id").alias("label"), "verdict", F.col("why").alias("kind"), reason.alias("reason"), "decision", "reviewer")


def conformance_counts(verdicts: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row: total, ok, not_applicable, gaps, resolved (those that a human decided on), open."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    totals = verdicts.agg(F.count(F.lit(1)).alias("total"), count("OK").alias("ok"), count("NOT_APPLICABLE").alias("not_applicable"))
    held = gaps.agg(F.count(F.lit(1)).alias("gaps"), F.count("decision").alias("resolved"))
    return totals.join(held).withColumn("open", F.col("gaps") - F.col("resolved"))


def conformance_facts(decided: DataFrame) -> DataFrame:
    """Facts of a human's decisions on gaps (id, decision, reviewer, note)."""
    said = lambda predicate, value: F.struct(F.col("id").alias("subject"), F.lit(predicate).alias("predicate"), value.alias("object"))
    return _facts(decided, [said("review-decision", F.col("decision")), said("reviewed-by", F.col("reviewer")), said("review-note", F.nullif("note", F.lit("")))], F.lit(None).cast("long"), "human-review")


def top_matches(needs: DataFrame, has: DataFrame, k: int = 5) -> DataFrame:
    """(subject, candidate) of each subject's ``k`` candidates that meet most needs; of equals the smallest id."""
    met = needs.distinct().join(has.distinct(), "skill").groupBy("subject", "candidate").agg(F.count(F.lit(1)).alias("n"))
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("n"), "candidate")))
    return ranked.where(F.col("r") <= k).select("subject", "candidate")  # tasks keep k of each subject before they deal them out


def mapping_score(gold: DataFrame, test: DataFrame) -> DataFrame:
    """(subject, recall, precision) of a mapping's ``top_matches`` against those of the gold mapping; none counts as 0."""
    both = gold.withColumn("g", F.lit(1)).join(test.withColumn("t", F.lit(1)), ["subject", "candidate"], "full_outer")
    sums = both.groupBy("subject").agg(F.count("g").alias("g"), F.count("t").alias("t"), F.count(F.col("g") + F.col("t")).alias("both"))
    share = lambda of: F.when(F.col(of) > 0, F.col("both") / F.col(of)).otherwise(F.lit(0.0))
    return sums.select("subject", share("g").alias("recall"), share("t").alias("precision"))
