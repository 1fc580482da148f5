"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Stages: toxic documents go; of equal texts one row stays; of near duplicates one row stays; secrets are masked in the
texts; what is left is packed into sequences. All but the last return the columns of documents.

In all stages null texts are empty, and stay null where they stay; null ids are ids, the least ones; very long texts are
taken whole; empty tables stay empty; columns beside doc_id and text are passed on, whatever their names (but n_chars, which
follows a text that was masked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, near_dedup, packing, secrets
from factloom.llm import queries as llm
from factloom.llm import toxicity as ops
from factloom.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose probability of any toxic grade is below the limit: equal texts all or none. Without labels that
    tell toxic from clean all stay."""
    return ops.clean(docs, llm.toxicity_model(spark, sf_dir), llm.TOXIC_FROM)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of rows that repeat, one."""
    return exact_dedup.winners_only(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the least id stays; of rows that share it, one. Texts without words are equal."""
    return near_dedup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, those that repeat too, their secrets masked."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their place in sequences of 4,096 tokens; rows that share an id have pieces each."""
    made = packing.pieces(docs, llm.vocabulary("word_bpe_49k.json"), 1)
    return packing.pack(written(llm.with_crc(made), "pieces"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("secrets", mask_secrets), ("packing", pack)]
ORACLE_SQL = None  # a trained model, tokens and alignments aren't SQL; tests hold the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
