"""Exact dedup against a minimal perfect hash over the historical distinct digests.

Texts are equal if they are identical after lower-casing A-Z; null counts as empty; very long texts are hashed whole.
Of equal texts the row with the largest doc_id stays (a null doc_id is the smallest; of rows that tie, one stays).
Rows that repeat are reported each. An empty table has no group. ``dedup_report`` reads no other columns, whatever their
names; ``winners_only`` passes them on.

The index is a table with a row for each shard of the digest space. A shard's hash function is a list of bit maps:
at each level the digests that land alone in a bit keep it and the rest go to the next level, so the rank of a
digest's bit is its slot, without gaps. Slots hold the full 32-byte digest, the winner's doc_id and the number of
copies. A lookup compares all bytes of the digest. Digests are distinct before they are dealt to shards, and the
number of shards follows their count, so a shard stays small whatever the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, salted_lookup, text_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_DIGESTS = 200_000
INDEX = "shard int, n long, levels array<long>, bits binary, digests binary, winners binary, copies binary"
NO_ID = -(2**63)


def normalised(column: str = "text") -> Column:
    text = text_of(column)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest_of(column: str = "text") -> Column:
    return F.unhex(F.sha2(normalised(column), 256))


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    x = words[:, level % 4] + np.uint64((level // 4 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8").reshape(-1, 4)


def build_shard(digests: list[bytes], winners: np.ndarray, copies: np.ndarray) -> dict:
    """The minimal perfect hash of distinct digests, and the slots in its order."""
    words, left, sizes, maps = _words(b"".join(digests)), np.arange(len(digests)), [], []
    slots: list[np.ndarray] = []
    while len(left):
        size = max(64, 2 * len(left))
        at = _mixed(words[left], len(sizes)) % np.uint64(size)
        hits = np.bincount(at.astype(np.int64), minlength=size)
        alone = hits[at.astype(np.int64)] == 1
        sizes.append(size)
        maps.append(hits == 1)
        slots.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    order = np.concatenate(slots) if slots else np.empty(0, np.int64)
    return {"n": len(digests), "levels": sizes, "bits": np.packbits(np.concatenate(maps) if maps else np.empty(0, bool)).tobytes(), "digests": b"".join(digests[i] for i in order), "winners": winners[order].astype("<i8").tobytes(), "copies": copies[order].astype("<i8").tobytes()}


def find(shard: dict, digests: list[bytes]) -> np.ndarray:
    """The slot of each digest, or -1; all 32 bytes are compared."""
    out = np.full(len(digests), -1, np.int64)
    if not digests or not shard["n"]:
        return out
    bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8)).astype(bool)[: sum(shard["levels"])]
    rank = np.cumsum(bits) - 1
    words, left, base = _words(b"".join(digests)), np.arange(len(digests)), 0
    for level, size in enumerate(shard["levels"]):
        at = base + (_mixed(words[left], level) % np.uint64(size)).astype(np.int64)
        out[left[bits[at]]] = rank[at[bits[at]]]
        left, base = left[~bits[at]], base + size
    kept = _words(shard["digests"])
    some = np.flatnonzero(out >= 0)
    out[some[(kept[out[some]] != words[some]).any(axis=1)]] = -1
    return out


def grouped(docs: DataFrame) -> DataFrame:
    """A row for each distinct text of ``docs`` (doc_id, digest): digest, winner, copies. Copies meet map-side first."""
    return docs.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def _shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def build_index(history: DataFrame) -> DataFrame:
    """The index over ``history`` (digest, winner, copies; distinct digests), written to the shared folder."""
    shards = max(1, -(-history.count() // SHARD_DIGESTS))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        made = build_shard(part["digest"].map(bytes).tolist(), part["winner"].fillna(NO_ID).to_numpy(np.int64), part["copies"].to_numpy(np.int64))
        return pd.DataFrame([{"shard": int(part["shard"].iloc[0]), **made}])

    return written(history.withColumn("shard", _shard_of(shards)).groupBy("shard").applyInPandas(build, INDEX), "mph")


def _probes(asked: int, shards: int) -> int:
    """How many tasks look up in one shard, so that each has no more than about SHARD_DIGESTS digests."""
    return max(1, -(-asked // (shards * SHARD_DIGESTS)))


def lookup(index: DataFrame, groups: DataFrame) -> DataFrame:
    """Every digest of the index and of ``groups`` once: digest, winner, copies, was_known.

    Members of the index update their slot; nonmembers are grouped by themselves. ``groups`` has distinct digests; where
    they are many more than the index has, several probes of a shard share them.
    """
    known = index.agg(F.max("shard")).first()[0]
    shards = 1 if known is None else known + 1
    columns = ["digest", "winner", "copies"]

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples():
                raw = bytes(row.digests)
                yield pd.DataFrame({"digest": [raw[i : i + 32] for i in range(0, len(raw), 32)], "winner": np.frombuffer(row.winners, "<i8"), "copies": np.frombuffer(row.copies, "<i8")})

    def probe(key: tuple, held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return asked[columns].assign(slot_winner=0, slot_copies=0, member=False)
        shard = {"n": 0} if held.empty else held.iloc[0].to_dict()
        asked = asked.assign(winner=asked["winner"].fillna(NO_ID).astype(np.int64))
        at = find(shard, asked["digest"].map(bytes).tolist())
        some = at >= 0
        out = asked[columns].assign(slot_winner=NO_ID, slot_copies=0, member=some)
        if some.any():
            out.loc[some, "slot_winner"] = np.frombuffer(shard["winners"], "<i8")[at[some]]
            out.loc[some, "slot_copies"] = np.frombuffer(shard["copies"], "<i8")[at[some]]
        return out

    probes = _probes(groups.count(), shards)
    probe_of = F.pmod(F.xxhash64("digest", F.lit("probe")), F.lit(probes)).cast("int")
    asked = groups.select(*columns).withColumn("shard", _shard_of(shards)).withColumn("probe", probe_of)
    held = index.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))))
    probed = written(held.groupBy("shard", "probe").cogroup(asked.groupBy("shard", "probe")).applyInPandas(probe, "digest binary, winner long, copies long, slot_winner long, slot_copies long, member boolean"), "probed")
    members = probed.where("member")
    new = probed.where("not member").select(*columns, F.lit(False).alias("was_known"))
    old = index.select("digests", "winners", "copies").mapInPandas(slots, "digest binary, winner long, copies long")
    updates = members.select("digest", F.col("winner").alias("later"), F.col("copies").alias("more"))
    old = old.join(updates, "digest", "left").select("digest", F.greatest("winner", "later").alias("winner"), (F.col("copies") + F.coalesce("more", F.lit(0))).alias("copies"), F.lit(True).alias("was_known"))
    return old.unionByName(new).withColumn("winner", F.when(F.col("winner") != NO_ID, F.col("winner")))


def dedup_report(docs: DataFrame, history_share: float = 0.5) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    The rows up to the ``history_share`` quantile of doc_id (null ids too) are the history that is indexed; the rest
    are looked up. The result doesn't depend on the split.
    """
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of().alias("digest")), "digests")
    split, total = rows.agg(F.percentile_approx("doc_id", history_share), F.count(F.lit(1))).first()
    split = 0 if split is None else split
    earlier = F.coalesce(F.col("doc_id") <= split, F.lit(True))
    index = build_index(written(grouped(rows.where(earlier)), "history"))
    groups = written(lookup(index, written(grouped(rows.where(~earlier)), "asked")), "groups")
    rows = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("m"))  # rows that repeat outright meet map-side
    joined = salted_lookup(rows, groups, "digest", groups.select("digest", F.col("copies").alias("n")), total, ["doc_id"])
    out = joined.select("doc_id", F.col("winner").alias("keep_id"), F.col("copies").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("winner")).alias("wins"), F.lower(F.hex("digest")).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("m"))).alias("nth"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("wins") & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def winners_only(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that repeat an equal text."""
    report = written(dedup_report(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias("digest")), "kept")
    id_, digest, keep_id, keep_digest = free_names(docs, "__i", "__d", "__ki", "__kd")
    named = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(digest, digest_of())
    # Rows that repeat both doc_id and text are told apart by nothing, so one of them is taken; the usual case, no such
    # rows, passes without a second exchange.
    repeated = named.groupBy(id_, digest).count().where("count > 1")
    keep = report.select(F.col("doc_id").alias(keep_id), F.col("digest").alias(keep_digest))
    kept = named.join(keep, F.col(id_).eqNullSafe(F.col(keep_id)) & (F.col(digest) == F.col(keep_digest)), "left_semi")
    return (kept if repeated.isEmpty() else kept.dropDuplicates([id_, digest])).drop(id_, digest)
