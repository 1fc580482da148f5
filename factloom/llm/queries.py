"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fingerprints, licenses, merge_dropout, near_dedup, ngram_join, packing, secrets, token_files, toxicity, vector_codes, warc, whitening
from .common import table, written

TOXIC_FROM = 0.5


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def with_crc(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by their unsigned CRC-32."""
    return rows.withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = token_files.write_tokens(table(spark, sf_dir, "documents"), token_files.token_path(spark), vocabulary("byte_bpe_50k.json"), 2)
    return with_crc(token_files.read_documents(spark, made)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1)
    return packing.pack(written(with_crc(made), "pieces"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(secrets.scan(table(spark, sf_dir, "documents")))


def secret_digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.resolve(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), ";")
    return made.select("record_id", "url", F.unix_seconds("date").alias("seconds"), "status", "refers_to", lines.alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")

    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = merge_dropout.segmenter(path)
        for b in batches:
            turns = [xxhash.xxh3_64_intdigest(str(i), of.seed) for i in b.column("doc_id").to_pylist()]
            ids = of.encode_all(b.column("text").to_pylist(), turns)
            back = [of.decode(x) == (t or "") for x, t in zip(ids, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(map(merge_dropout.crc32_of, ids), pa.int64()), pa.array(back, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "lossless"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(round_trip, "doc_id long, n_tokens long, ids_crc32 long, lossless boolean")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Fit on the labelled rows of the input's own documents."""
    return toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity_model(spark, sf_dir))
    return made.select("doc_id", "expected_severity", "p_toxic", "grade", (F.col("p_toxic") >= TOXIC_FROM).alias("rejected"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_report(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_files, op2_exact_dedup, op3_packing, op4_secrets, op5_warc_revisits, op6_merge_dropout, op7_toxicity, op8_licenses, op9_near_dedup, op10_fingerprints, op11_vector_codes, op12_whitening, op13_ngram_join]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_warc_revisits": warc.resolved_sql(), "op8_licenses": licenses.scan_sql()}
