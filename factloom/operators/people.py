"""Who is who, who approves, who belongs to what: identities, approvals, inference, conformance, ranking."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import email_key, name_tokens, snippet
from .graph import checkpointed, closure

DELETED = "(deleted account)"  # fixed value: what stands for the name of an account that is gone


def _identity_keys(people: DataFrame) -> DataFrame:
    """(tier, key, id, band) of persons (id, name, email, band) by e-mail and by name parts; those without a band or
    whose account is deleted have none."""
    known = people.where(F.col("band").isNotNull() & (F.coalesce("name", F.lit("")) != DELETED))
    p = known.withColumn("mail", email_key(F.col("email"))).withColumn("parts", name_tokens(F.col("name")))
    mail = p.where("mail is not null").select(F.lit("email").alias("tier"), F.array("mail").alias("key"), "id", "band")
    return mail.unionByName(p.where(F.size("parts") >= 2).select(F.lit("name").alias("tier"), F.col("parts").alias("key"), "id", "band"))


def identity_pairs(people: DataFrame) -> DataFrame:
    """(a, b, tier) of persons (id, name, email, band) of different bands: the same e-mail, else the same name parts.

    The least person of each band stands for those of the band that share the key (``identity_groups`` has them all), so
    a key makes no more rows than pairs of bands. The e-mail outranks the name.
    """
    first = _identity_keys(people).groupBy("tier", "key", "band").agg(F.min("id").alias("id"))
    a, b = (first.select("tier", "key", F.col("id").alias(x), F.col("band").alias(f"band_{x}")) for x in "ab")
    return a.join(b, ["tier", "key"]).where("a < b and band_a != band_b").groupBy("a", "b").agg(F.min("tier").alias("tier"))


def identity_groups(people: DataFrame, salts: int = 16) -> DataFrame:
    """(tier, key, id, band, first, band_first): a row for each person in each e-mail or name that several bands share,
    with the least ids of that group and of the person's band in it.

    Two members of a group with different bands may be one person; ``identity_pairs`` has a pair of each two bands. A
    group costs a row for each member, and its rows go to ``salts`` tasks.
    """
    rows = _identity_keys(people)
    bands = rows.groupBy("tier", "key", "band").agg(F.min("id").alias("band_first"))
    shared = bands.groupBy("tier", "key").agg(F.min("band_first").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    lookup = bands.join(shared, ["tier", "key"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return salted.join(lookup, ["tier", "key", "band", "salt"]).select("tier", "key", "id", "band", "first", "band_first")


def undecided(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    return pairs.join(dismissed, ["a", "b"], "left_anti")


# Phrases of formal consent and softer ones, in the order in which they are tried; what denies or conditions
# the rest of its sentence; what ends a sentence.
FORMAL = ("承認します", "承認いたします", "承認しました", "承認です", "LGTM", "approve", "approved", "approval granted")
SOFTER = ("問題ありません", "問題ないです", "大丈夫です", "OKです", "異議ありません", "進めてください", "進めていただいて")
DENIED = r"(?i)(?<![A-Za-z0-9_])(?:not|never|cannot|can'?t|don'?t|doesn'?t|didn'?t|won'?t|isn'?t|wouldn'?t|shouldn'?t|unless|if)(?![A-Za-z0-9_])|なければ|れば|たら|ならば|なら"
ENDS = "。.!?！？\n"
AROUND = 40


def sentences(text: Column) -> Column:
    """A text's sentences with their ends: struct<s, at (code points before it), open (code points before its first denial or
    condition), asked (whether it ends as a question)>."""
    cut = F.filter(F.split(text, f"(?<=[{ENDS}])"), lambda x: x != "")
    told = F.transform(cut, lambda x: F.struct(x.alias("s"), F.length(F.get(F.split(x, DENIED, 2), 0)).alias("open"), x.rlike(r"[?？]\z").alias("asked")))
    sized = F.struct(F.array().cast("array<struct<s: string, at: int, open: int, asked: boolean>>").alias("all"), F.lit(0).alias("at"))
    placed = F.aggregate(told, sized, lambda done, x: F.struct(F.concat(done["all"], F.array(F.struct(x["s"].alias("s"), done["at"].alias("at"), x["open"].alias("open"), x["asked"].alias("asked")))).alias("all"), (done["at"] + F.length(x["s"])).alias("at")))
    return placed["all"]


def _pattern(phrase: str) -> str:
    """A phrase as words in either case if it is ASCII, else as it is; not one that a particle makes a question."""
    quoted = re.escape(phrase)
    return (rf"(?i)(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])" if phrase.isascii() else quoted) + "(?!か(?!ら))"


def approvals(comments: DataFrame, formal: tuple[str, ...] = FORMAL, softer: tuple[str, ...] = SOFTER) -> DataFrame:
    """(id, tier, phrase, snippet) of comments (id, text) that approve: by the first phrase in the lists that stands in any
    sentence which isn't asked, before whatever denies or conditions its rest. ``phrase`` is as listed; the snippet is of its
    first such place. Built-in functions only; comments without any phrase are left out before they are cut up."""
    c = F.col
    listed = [("formal", p) for p in formal] + [("euphemism", p) for p in softer]
    some = comments.where(c("text").rlike("|".join(f"(?:{_pattern(p)})" for _, p in listed)))
    cut = some.select("id", "text", F.inline(F.array(F.struct(sentences(c("text")).alias("parts")))))

    def place(phrase: str) -> Column:
        at = lambda x: F.split(x["s"], _pattern(phrase), 2)
        clean = F.filter("parts", lambda x: ~x["asked"] & (F.size(at(x)) == 2) & (F.length(F.get(at(x), 0)) <= x["open"]))
        return F.get(F.transform(clean, lambda x: x["at"] + F.length(F.get(at(x), 0))), 0)

    tried = F.array(*[F.struct(F.lit(tier).alias("tier"), F.lit(p).alias("phrase"), place(p).alias("at"), F.lit(len(p)).alias("n")) for tier, p in listed])
    hits = cut.select("id", "text", F.inline(F.slice(F.filter(tried, lambda x: x["at"].isNotNull()), 1, 1)))
    return hits.select("id", "tier", "phrase", snippet(c("text"), c("at"), c("n"), AROUND).alias("snippet"))


def approver_context(observed: DataFrame) -> DataFrame:
    """(person, assigned, authored, reviewed) counts of (kind, person); none is null."""
    count = lambda kind: F.nullif(F.count_if(F.col("kind") == kind), F.lit(0)).alias(kind)
    return observed.groupBy("person").agg(count("assigned"), count("authored"), count("reviewed"))


def nearest_accounts(activity: DataFrame, links: DataFrame) -> DataFrame:
    """(person, project, via, steps): for each project that anybody of a person's accounts is active in, the account that a
    breadth-first walk from the person over ``links`` (id, other, both ways) comes to first; neighbours in the order of
    their ids. ``steps`` is how far it is, 0 for the person's own activity.

    Walks go from the active accounts outwards, all at once: who is first reached at a step takes what the least of its
    neighbours at the step before has, which is what its own walk finds. A row for each person and project, a join of the
    last step's rows a round, as many rounds as the longest chain.
    """
    c = F.col
    edges = checkpointed(links.select(c("id").alias("a"), c("other").alias("b")).where("a != b").distinct())
    found = checkpointed(activity.select("person", "project").where("person is not null").distinct().select("person", "project", c("person").alias("via"), F.lit(0).alias("steps")))
    last, steps = found, 0
    while not last.isEmpty():
        steps += 1
        near = last.select(c("person").alias("b"), "project", "via").join(edges, "b").groupBy(c("a").alias("person"), "project").agg(F.min_by("via", "b").alias("via"))
        last = checkpointed(near.join(found, ["person", "project"], "left_anti").withColumn("steps", F.lit(steps)))
        found = found.unionByName(last)
    return found


def supporters(grants: DataFrame, activity: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, project, person, via): grantees who are active in a project, by themselves (``via`` null) or by another
    account of the same person, the nearest over ``links`` (id, other)."""
    met = grants.select("doc", "person").distinct().join(nearest_accounts(activity, links), "person")
    return met.select("doc", "project", "person", F.when(F.col("steps") > 0, F.col("via")).alias("via"))


def document_projects(grants: DataFrame, activity: DataFrame, links: DataFrame, resolvable: int = 3, share: float = 0.5) -> DataFrame:
    """(doc, project, support, resolved, tier) from grants (doc, person), activity (person, project), links (id, other).

    A grantee counts by the activity of all accounts of the same person. At least ``resolvable`` grantees must have
    any; a project needs ``share`` of them; tier is high for each project that all of them are active in.
    """
    met = supporters(grants, activity, links)
    docs = met.groupBy("doc", "person").agg(F.count(F.lit(1)).alias("projects")).groupBy("doc").agg(F.count(F.lit(1)).alias("resolved")).where(F.col("resolved") >= resolvable)
    counts = met.groupBy("doc", "project").agg(F.count(F.lit(1)).alias("support")).join(docs, "doc").where(F.col("support") / F.col("resolved") >= share)
    return counts.select("doc", "project", "support", "resolved", F.when(F.col("support") == F.col("resolved"), "high").otherwise("ambiguous").alias("tier"))


def identity_state(groups: DataFrame, stored: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(a, b, state) of persons' evidence against what is stored: ``groups`` (id, root) are those that evidence connects,
    ``stored`` and ``dismissed`` pairs (a, b) in either order.

    Every stored pair has a row: ``confirmed`` if evidence connects its ends, else ``unfounded``. What is stored connects a
    group's members in parts; the part of the least person is proposed to be linked with each other part, by their least
    persons: ``open``, or ``dismissed`` if that pair was. So each group has one row less than it has parts, whatever its size.
    """
    c = F.col
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = stored.select(low, high).where("a < b").distinct()
    of = lambda key: groups.select(c("id").alias(key), c("root").alias(f"{key}_root")).hint("merge")  # noqa: E731  # a row for each person: not through the driver
    held = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.when(c("a_root") == c("b_root"), "confirmed").otherwise("unfounded").alias("state"))
    parts = closure(pairs).withColumnRenamed("root", "part")
    members = groups.join(parts.hint("merge"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    leads = members.groupBy("root", "part").agg(F.min("id").alias("lead"))
    proposed = leads.join(leads.groupBy("root").agg(F.min("lead").alias("first")), "root").where("lead != first").select(c("first").alias("a"), c("lead").alias("b"))
    gone = dismissed.select(low, high, F.lit(True).alias("gone")).distinct().hint("merge")
    return held.unionByName(proposed.join(gone, ["a", "b"], "left").select("a", "b", F.when(c("gone"), "dismissed").otherwise("open").alias("state")))


def evidence_groups(people: DataFrame) -> DataFrame:
    """(id, root) of persons (id, name, email, band) that evidence connects with others: who share an address, or a name of
    two parts and more, with somebody of another band, directly or over others; root is the least of them."""
    c = F.col
    known = people.where(c("band").isNotNull() & (F.coalesce("name", F.lit("")) != DELETED))
    parts = name_tokens(c("name"))
    keys = F.array_compact(F.array(F.concat(F.lit("@"), email_key(c("email"))), F.when(F.size(parts) >= 2, F.concat(F.lit("="), F.array_join(parts, " ")))))
    keyed = known.select("id", "band", F.explode(keys).alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("first"), F.min("band").alias("low"), F.max("band").alias("high")).where("low != high")
    return closure(keyed.join(least, "key").select(c("first").alias("a"), c("id").alias("b")))


def overshared(tiers: DataFrame, floors: DataFrame) -> DataFrame:
    """(id, observed, required) of documents whose observed tier lies under the floor they require."""
    return tiers.join(floors, "id").where("observed < required").select("id", "observed", "required")


def fit_ranking(required: DataFrame, levels: DataFrame, allocations: DataFrame) -> DataFrame:
    """(subject, candidate, overlap, strength, busyness, score): how well candidates' skills fit what is required.

    Strength is the sum of levels (1 where none), busyness the current allocation; score = strength - busyness / 10.
    """
    met = required.join(levels, "skill").groupBy("subject", "candidate").agg(F.count_distinct("skill").alias("overlap"), F.sum(F.coalesce("level", F.lit(1))).cast("long").alias("strength"))
    busy = allocations.groupBy("candidate").agg(F.sum("allocation").cast("long").alias("busyness"))
    out = met.join(busy, "candidate", "left").withColumn("busyness", F.coalesce("busyness", F.lit(0)))
    return out.select("subject", "candidate", "overlap", "strength", "busyness", (F.col("strength") - F.col("busyness") / 10).alias("score"))
