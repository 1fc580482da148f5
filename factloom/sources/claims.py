"""Answers of a language model as claims, and claims as items of the fact log.

A pattern says what a document may claim: predicates (name, from, to, kind ``edge`` or ``value``) and types of entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BANDS, hash48, trimmed

PASSAGE = 1000
CONFIDENCE = ("explicit", "implied")
FIELDS = ("subject", "subjectType", "predicate", "object", "objectType", "effectiveFrom", "passage", "confidence")
TRIMMED = ("subject", "object", "effectiveFrom", "passage")


def answer_object(answer: Column) -> Column:
    """The object in an answer, as a variant: in the first fence if there is one, from the first brace to the last one. Null
    if there is none, or if it isn't JSON."""
    fence = r"```(?:json)?\s*([\s\S]*?)```"
    inside = F.when(answer.rlike(fence), F.regexp_extract(answer, fence, 1)).otherwise(answer)
    return F.try_parse_json(F.nullif(F.regexp_extract(inside, r"(?s)(\{.*\})", 1), F.lit("")))


def _text(claim: Column, name: str) -> Column:
    """A field that is text; null if it is anything else."""
    field = F.try_variant_get(claim, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(field) == "STRING", F.try_variant_get(claim, f"$.{name}", "string"))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def parsed_claims(answers: DataFrame, pattern: DataFrame) -> DataFrame:
    """(doc, nth, subject, subject_type, predicate, object, object_type, effective_from, passage, confidence) of answers (doc,
    answer) that fit the pattern.

    Claims are an answer's ``facts``; each is read by itself, so that one of an odd shape costs no other. Ends are trimmed
    and must not be empty, predicates must be the pattern's. Types that are missing or empty are the predicate's own; values
    have no object type. A passage is trimmed and at most PASSAGE characters; a confidence of any other word is none. What
    isn't text is missing. Several predicates of one name in a pattern are the first by from, to, kind.
    """
    c = F.col
    parsed = answers.select("doc", F.try_variant_get(answer_object(c("answer")), "$.facts", "array<variant>").alias("facts"))
    fields = lambda x: F.struct(*[(trimmed(_text(x, n)) if n in TRIMMED else _text(x, n)).alias(n) for n in FIELDS])
    rows = parsed.select("doc", F.posexplode(F.transform("facts", fields)).alias("nth", "x")).select("doc", "nth", "x.*")
    declared = pattern.groupBy("name").agg(F.min(F.struct("from", "to", "kind")).alias("d")).select(c("name").alias("predicate"), "d.*")
    said = rows.join(declared, "predicate").where("subject != '' and object != ''")
    return said.select("doc", "nth", "subject", F.coalesce(_filled(c("subjectType")), c("from")).alias("subject_type"), "predicate", "object", F.when(c("kind") == "edge", F.coalesce(_filled(c("objectType")), c("to"))).alias("object_type"), _filled(c("effectiveFrom")).alias("effective_from"), F.left(_filled(c("passage")), F.lit(PASSAGE)).alias("passage"), F.when(c("confidence").isin(*CONFIDENCE), c("confidence")).alias("confidence"))


def minted(claims: DataFrame, docs: DataFrame, types: DataFrame, floors: DataFrame) -> DataFrame:
    """Claims with what they mint: ``s`` and ``o``, the ids of their ends, null where an end is no entity of the pattern;
    ``level``, the stricter of the document's tier and the predicate's floor; ``floor``; ``said``, whether they are a fact.

    ``docs`` are (doc, key, tier, at): ``key`` is shared by revisions of a document, whose entities are the same ones. A
    subject of a type outside ``types`` (type) mints nothing and drops the claim. An object of such a type drops the claim
    and its floor, but its subject was minted before.
    """
    c = F.col
    known = lambda name: types.select(c("type").alias(name), F.lit(True).alias(f"{name}_known")).distinct()
    strict = floors.groupBy("predicate").agg(F.max("floor").alias("floor"))
    rows = claims.join(docs, "doc").join(known("subject_type"), "subject_type", "left").join(known("object_type"), "object_type", "left").join(strict, "predicate", "left")
    entity = lambda type_, name: hash48(F.concat_ws("|", c("key").cast("string"), type_, name)) + BANDS["entity"]
    subject_ok, object_ok = c("subject_type_known").isNotNull(), c("object_type").isNull() | c("object_type_known").isNotNull()
    floor = F.coalesce("floor", F.lit(0)).cast("int")
    rows = rows.withColumn("floor", floor).withColumn("level", F.greatest(F.coalesce("tier", F.lit(0)), floor).cast("int")).withColumn("said", subject_ok & object_ok)
    ends = F.struct(F.when(subject_ok, entity(c("subject_type"), c("subject"))).alias("s"), F.when(c("said") & c("object_type").isNotNull(), entity(c("object_type"), c("object"))).alias("o"))
    return rows.select(*claims.columns, "key", "tier", "at", "floor", "level", "said", F.inline(F.array(ends)))  # hashed once, wherever they are read


def _ends(rows: DataFrame) -> DataFrame:
    """(doc, key, at, level, id, type, name) of minted ends."""
    c = F.col
    ends = F.array(F.struct(c("s").alias("id"), c("subject_type").alias("type"), c("subject").alias("name")), F.struct(c("o").alias("id"), c("object_type").alias("type"), c("object").alias("name")))
    return rows.select("doc", "key", "at", "level", F.explode(ends).alias("e")).select("doc", "key", "at", "level", "e.*").where("id is not null")


def claim_nodes(rows: DataFrame) -> DataFrame:
    """(id, type, label) of ``minted`` rows: a label only rises, over all claims that mint the node."""
    return _ends(rows).groupBy("id", "type").agg(F.max("level").alias("label"))


def claim_items(rows: DataFrame, pattern: DataFrame) -> DataFrame:
    """Items (subject, predicate, object, valid_from, source, passage, confidence) of ``minted`` rows: facts from their
    effective date or else the document's instant; a name for each entity by ``<type>-name``, unless the pattern declares
    that predicate itself. All are from their document, not from the lane that reads it."""
    c = F.col
    source, none = F.concat(F.lit("drive:"), c("doc").cast("string")).alias("source"), F.lit(None).cast("string")
    effective = F.coalesce(F.unix_seconds(F.try_to_timestamp("effective_from")), F.lit(0))
    facts = rows.where("said").select(c("s").alias("subject"), "predicate", F.coalesce(c("o").cast("string"), c("object")).alias("object"), F.when(effective > 0, effective).otherwise(c("at")).cast("long").alias("valid_from"), source, "passage", "confidence")
    names = _ends(rows).select("doc", "at", "id", "name", F.concat(F.lower("type"), F.lit("-name")).alias("predicate")).distinct()
    names = names.join(pattern.select(c("name").alias("predicate")).distinct(), "predicate", "left_anti")
    return facts.unionByName(names.select(c("id").alias("subject"), "predicate", c("name").alias("object"), c("at").alias("valid_from"), source, none.alias("passage"), none.alias("confidence")))


def document_floors(rows: DataFrame) -> DataFrame:
    """(doc, floor) that a document's facts require of it: the strictest floor of those that are said; none if that is 0."""
    return rows.where("said").groupBy("doc").agg(F.max("floor").alias("floor")).where("floor > 0")


def family_keys(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(family, entity) keys ``Type|name`` of minted entities that ``known`` (family, entity) lacks; a family is what its
    documents' revisions share."""
    found = _ends(rows).select((hash48(F.col("key").cast("string")) + BANDS["family"]).alias("family"), F.concat_ws("|", "type", "name").alias("entity")).distinct()
    return found.join(known, ["family", "entity"], "left_anti")
