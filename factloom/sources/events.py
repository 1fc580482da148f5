"""What files can be read, what is known of their entities, and the simple lane of extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import BANDS, hash48


def known_entities(anchors: DataFrame) -> DataFrame:
    """(type, name) of ``Type|name`` texts, cut at the first bar; others are left out."""
    at = F.instr("entity", "|")
    return anchors.where(at > 1).select(F.expr("left(entity, instr(entity, '|') - 1)").alias("type"), F.expr("substring(entity, instr(entity, '|') + 1)").alias("name")).where("name != ''").distinct()


# Kinds of files that can be read, and words in a name that say it isn't the final version.
READABLE = ("application/pdf", "application/vnd.google-apps.document", "application/vnd.google-apps.presentation", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")
DRAFT = r"(?i)draft|下書き|案|copy|コピー|old|_v\d+|backup"


def classified(files: DataFrame, readable_kinds: tuple[str, ...] = READABLE, drafts: str = DRAFT) -> tuple[DataFrame, DataFrame]:
    """Files (id, name, mime, ...) that can be read, with their name or id and whether it looks like a draft; and (mime, n)
    of the others."""
    kind = F.coalesce("mime", F.lit("unknown"))
    name = F.coalesce("name", F.col("id").cast("string"))
    readable = files.where(kind.isin(*readable_kinds)).withColumn("name", name).withColumn("draft", F.col("name").rlike(drafts))
    skipped = files.where(~kind.isin(*readable_kinds)).groupBy(kind.alias("mime")).agg(F.count(F.lit(1)).alias("n"))
    return readable, skipped


def entity_names(claims: DataFrame) -> DataFrame:
    """(type, name) of what claims are about, each once."""
    ends = F.array(F.struct(F.col("subject_type").alias("type"), F.col("subject").alias("name")), F.struct(F.col("object_type").alias("type"), F.col("object").alias("name")))
    return claims.select(F.explode(ends).alias("e")).select("e.*").where("type is not null").distinct()


def shortlist(proposed: DataFrame, files: DataFrame) -> DataFrame:
    """(id, category, selected) of a proposal over files: known ids only, each once; no category is ``other``, and only
    what is plainly selected is."""
    rows = proposed.join(files.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min(F.coalesce("category", F.lit("other"))).alias("category"), F.max(F.coalesce(F.col("selected"), F.lit(False))).alias("selected"))
    return rows


EXTRACTED = "facts array<struct<subject: string, subjectType: string, predicate: string, object: string, objectType: string>>"


def extracted_facts(answers: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name) and facts of (doc, answer) texts in the simple lane; ``values`` holds predicates whose
    objects are values (predicate). Facts that lack an end or a predicate go. Names of one type that differ in case
    or outer blanks are one node, in all documents; it keeps the name of its least document. Each fact carries its document as
    provenance."""
    c = F.col
    rows = answers.select("doc", F.posexplode(F.from_json(F.regexp_extract("answer", r"(?s)(\{.*\})", 1), EXTRACTED)["facts"]).alias("at", "x")).select("doc", "at", "x.*")
    rows = rows.where("subject <> '' and predicate <> '' and object <> ''").join(values.select("predicate", F.lit(True).alias("is_value")).distinct(), "predicate", "left")
    node = lambda type_, name: hash48(F.concat_ws("|", type_, F.lower(F.trim(name)))) + BANDS["entity"]
    type_of = lambda name: F.when(c(name) != "", c(name))
    rows = rows.withColumn("subject_type", F.coalesce(type_of("subjectType"), F.lit("Person"))).withColumn("object_type", F.when(c("is_value").isNull(), type_of("objectType")))
    ends = F.array(F.struct(c("subject_type").alias("type"), c("subject").alias("name"), F.lit(0).alias("end")), F.struct(c("object_type").alias("type"), c("object").alias("name"), F.lit(1).alias("end")))
    named = rows.select("doc", "at", F.explode(ends).alias("e")).select("doc", "at", "e.*").where("type is not null")
    kept = named.groupBy("type", F.lower(F.trim("name")).alias("key")).agg(F.min_by(F.trim("name"), F.struct("doc", "at", "end")).alias("name"))
    nodes = kept.select(node(c("type"), c("key")).alias("id"), "type", "name")
    obj = F.when(c("object_type").isNull(), c("object")).otherwise(node(c("object_type"), c("object")).cast("string"))
    facts = rows.select(node(c("subject_type"), c("subject")).alias("subject"), "predicate", obj.alias("object"), F.lit(True).alias("derived"), F.concat(F.lit("doc:"), c("doc").cast("string")).alias("source"))
    return nodes, facts
