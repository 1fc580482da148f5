"""Near-dedup by order MinHash with banded alignment.

A text is the sequence of its words in lower case; its k-mers are runs of five words, each labelled with how often it
occurred before in the text (a text of fewer words is one k-mer). A sketch takes the SKETCH k-mers that are least by a
keyed hash and hashes them in text order, so that it is sensitive to edit similarity, not to the set of k-mers alone.
Each text has REPEATS sketches by different keys; texts with a sketch in common are candidates. Texts of up to SHORT
k-mers also share keys of themselves with one k-mer left out, which finds all their partners of up to SHORT k-mers.

A candidate pair is verified by alignment: labelled k-mers match one to one, matches within the band that the
threshold allows are kept, and the longest chain in both orders has m of them. Texts of n and k k-mers are near
duplicates if m / (n + k - m) is at least ``threshold``. Classes are the connected components of those links.

Equal word sequences are one node from the start. A bucket first links its texts to one centre; then its texts of
different components meet, block by block of BLOCK texts where their k-mers lie, and those that a link of the same
block joins no more. So groups of copies cost a row for each text and block, not for each pair, and no link between
components is lost to a centre that is like neither, however large the bucket.

Null texts are empty; texts without words are equal to each other. Null ids sort below all; of rows with the least id
of a class one is kept. Repeated rows are members of their class each. Very long texts are sketched and aligned whole:
a step for each word, then n log n for the chain. An empty table has no class. ``classes`` reads no other columns,
whatever their names; ``one_of_each`` passes them on.

SHORT is where left-out keys end: they only add candidates, above it sketches alone find them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, free_names, lean, salted_lookup, stored, text_of, written
from .components import components

K, SKETCH, REPEATS, THRESHOLD = 5, 6, 36, 0.8
SHORT, BLOCK = 9, 512
WORDS = re.compile(r"\w+").findall
KNOWN_WORDS = 200_000
ODD = [int.from_bytes(xxhash.xxh3_64_digest(f"order {j}")) | 1 for j in range(REPEATS)]  # keys of the orders
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_known: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return WORDS(text.lower())


def digest_of(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def kmers(words: list[str]) -> np.ndarray:
    """Hashes of the occurrence-labelled k-mers, in text order."""
    if len(_known) > KNOWN_WORDS:
        _known.clear()
    try:
        ids = list(map(_known.__getitem__, words))
    except KeyError:
        for w in words:
            if w not in _known:
                _known[w] = xxhash.xxh3_64_intdigest(w)
        ids = list(map(_known.__getitem__, words))
    x = np.array(ids, np.uint64)
    if len(x) < K:
        x = np.concatenate([x, np.full(K - len(x), len(x), np.uint64)])
    n = len(x) - K + 1
    h = np.zeros(n, np.uint64)
    for k in range(K):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        starts = np.where(same, 0, np.arange(n))
        label = np.empty(n, np.uint64)
        label[order] = np.arange(n) - np.maximum.accumulate(starts)
        h = _mix(h + label * np.uint64(0xD6E8FEB86659FD93))
    return h


def forget_words() -> None:
    """Empties the worker's own table of words; functions that Spark sends hold copies of this module's other names."""
    _known.clear()


def _joined(h: np.ndarray, salt: int) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes(), salt) - 2**63


def sketches(h: np.ndarray) -> list[int]:
    """The bucket keys of a text from its k-mers."""
    keys, n = [], len(h)
    few = np.uint64(2**64 * 24 // max(n, 24) - 1)
    for j in range(REPEATS):
        if n > SKETCH:
            g = h * np.uint64(ODD[j])  # the least by a product with an odd key: another order of all hashes for each
            at = np.flatnonzero(g < few) if n > 128 else np.arange(n)
            if len(at) < SKETCH:
                at = np.arange(n)
            keys.append(_joined(h[np.sort(at[np.argpartition(g[at], SKETCH - 1)[:SKETCH]])], j))
        elif not j:
            keys.append(_joined(h, 0))
    if len(h) <= SHORT:
        keys.append(_joined(h, 1000))
        keys += [_joined(np.delete(h, i), 1000) for i in range(len(h))] if len(h) > 1 else []
    return sorted(set(keys))


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """m / (n + k - m) of two sequences of distinct codes, m the longest chain of matches in the band."""
    n, k = len(a), len(b)
    if n == k and (a == b).all():
        return 1.0
    least = threshold / (1 + threshold) * (n + k)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = (n + k) - 2 * least + 1  # beyond it more k-mers are unmatched than the threshold allows
    near = np.abs(at_a - at_b) <= band
    if near.sum() < least - 1e-9:
        return 0.0
    chain: list[int] = []
    for y in at_b[near][np.argsort(at_a[near])].tolist():
        if not chain or y > chain[-1]:
            chain.append(y)
        else:
            chain[bisect_left(chain, y)] = y
    return len(chain) / (n + k - len(chain))


SKETCHED = "doc_id long, digest binary, n long, keys array<long>"
PARTS = 128


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the word sequence, number of k-mers and bucket keys of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                h = kmers(words)
                digests.append(digest_of(words))
                sizes.append(len(h))
                keys.append(sketches(h))
            forget_words()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "digest", "n", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(each), SKETCHED)


def _sizes_near(n: Column, k: Column, threshold: float) -> Column:
    return F.least(n, k) >= F.greatest(n, k) * F.lit(threshold)


def coded(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, str]:
    """(digest, codes) of the nodes that ``needed`` (digest) names: their k-mers, in 64 bits each; and the table's path."""
    wanted = nodes.join(needed, "digest", "left_semi").select(F.col("first_id").alias("__id"), F.col("digest").alias("__digest"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, codes = [], []
            for text, asked in zip(batch.column("text").to_pylist(), batch.column("__digest").to_pylist()):
                words = words_of(text)
                if digest_of(words) == asked:  # else another text with the same id
                    found.append(asked)
                    codes.append(kmers(words).tobytes())
            forget_words()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(codes, pa.binary())], ["digest", "codes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("__i"), text_of().alias("text"))
    codes = texts.join(wanted, F.col("__i").eqNullSafe(F.col("__id"))).select("text", "__digest").mapInArrow(lean(code), "digest binary, codes binary")
    codes, path = stored(codes, "codes")
    return codes if codes.groupBy("digest").count().where("count > 1").isEmpty() else codes.dropDuplicates(["digest"]), path


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts align. Codes travel once for each pair of a text."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("codes_a"), batch.column("codes_b")
            good = [i for i in range(batch.num_rows) if aligned(np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64), threshold) >= threshold]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    codes, codes_at = coded(pairs.select(F.col("a").alias("digest")).union(pairs.select(F.col("b").alias("digest"))).distinct(), nodes, docs)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    left = salted_lookup(pairs, codes.select(F.col("digest").alias("a"), F.col("codes").alias("codes_a")), "a", counts, pairs.count(), ["b"])
    counts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    both = salted_lookup(left, codes.select(F.col("digest").alias("b"), F.col("codes").alias("codes_b")), "b", counts, pairs.count(), ["a"])
    links = written(both.select("a", "b", "codes_a", "codes_b").mapInArrow(lean(align), "a binary, b binary"), "links")
    forget(pairs.sparkSession, codes_at)
    return links


UNIT = ["key", "unit", "whole", "main", "block", "centre", "digest", "label", "keys", "codes"]


def _at_keys(rows: DataFrame, sizes: DataFrame, lookup: DataFrame) -> DataFrame:
    """``rows`` with what ``lookup`` says of their key, keys of many rows dealt to several tasks."""
    total = sizes.agg(F.sum(F.col("others") + F.col("mains"))).first()[0] or 0
    return salted_lookup(rows, lookup, "key", sizes.select("key", (F.col("others") + F.col("mains")).alias("n")), total, ["digest"])


def _units(open_: DataFrame, sizes: DataFrame) -> DataFrame:
    """The rows of ``open_`` (key, digest, label, main, centre) in the units (key, unit) in which their pairs meet.

    ``sizes`` has (key, others, mains): texts outside and in the bucket's largest component. Both are dealt to blocks,
    and each two blocks meet in one unit, but for those of the largest component. ``whole`` says that texts of one
    block meet there as well.
    """
    c = F.col
    rows = _at_keys(open_, sizes, sizes.select("key", F.ceil(c("others") / BLOCK).alias("p"), F.greatest(F.ceil(c("mains") / BLOCK), F.lit(1)).alias("q")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.when(c("main"), c("q")).otherwise(c("p"))))
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    unit = lambda u, whole: F.struct(u.alias("unit"), whole.alias("whole"))
    inner = F.transform(span(c("p")), lambda j: unit(F.least(c("block"), j) * c("p") + F.greatest(c("block"), j), j == c("block")))
    outer = F.transform(span(c("q")), lambda j: unit(c("p") * c("p") + c("block") * c("q") + j, F.lit(False)))
    of_main = F.transform(span(c("p")), lambda i: unit(c("p") * c("p") + i * c("q") + c("block"), F.lit(False)))
    one = F.array(unit(F.lit(0).cast("long"), F.lit(True)))
    units = F.when((c("p") == 1) & (c("q") == 1), one).when(c("main"), of_main).otherwise(F.concat(inner, outer))
    return rows.select("key", "digest", "label", "main", "centre", "block", F.explode(units).alias("u")).select("key", "u.*", "main", "block", "centre", "digest", "label")


def _meet(key: int, rows: list[dict], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links (a, b) between components of one unit: as many as join what alignment joins, no pair that they join twice.

    A pair is taken in the bucket of its least common key only; pairs with the centre are known. Texts share no more
    k-mers than the lesser count of each part of the code space, so others needn't be aligned: nothing is lost.
    """
    rows.sort(key=lambda r: (r["main"], r["digest"]))
    codes = [np.frombuffer(r["codes"], np.uint64) for r in rows]
    n = np.array([len(x) for x in codes])
    parts = np.stack([np.bincount((x % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) for x in codes]).astype(np.int32)
    main, centre = (np.array([r[f] for r in rows]) for f in ("main", "centre"))
    block, whole, keys = np.array([r["block"] for r in rows]), rows[0]["whole"], [set(r["keys"]) for r in rows]
    names = {x: i for i, x in enumerate(dict.fromkeys(r["label"] for r in rows))}
    group = np.array([names[r["label"]] for r in rows])
    links = []
    for i in range(len(rows) - 1 if not main.all() else 0):
        if main[i]:
            break  # what follows is of the largest component, too
        j = np.arange(i + 1, len(rows))
        j = j[(group[j] != group[i]) & ~(centre[j] | centre[i]) & (whole | (main[j] | (block[j] != block[i])))]
        j = j[np.minimum(n[j], n[i]) >= np.maximum(n[j], n[i]) * threshold - 1e-9]
        j = j[np.minimum(parts[j], parts[i]).sum(1) >= (threshold / (1 + threshold) - 1e-9) * (n[j] + n[i])]
        for k in j.tolist():
            if group[k] != group[i] and min(keys[i] & keys[k]) == key and aligned(codes[i], codes[k], threshold) >= threshold:
                group[group == group[k]] = group[i]
                a, b = sorted((rows[i]["digest"], rows[k]["digest"]))
                links.append((a, b))
    return links


def across(open_: DataFrame, sizes: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between components of the same bucket."""
    units, units_at = stored(_units(open_, sizes), "units")
    codes, codes_at = coded(units.select("digest").distinct(), nodes, docs)
    facts = codes.join(nodes.select("digest", "keys"), "digest")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def links() -> pa.RecordBatch:
            found = _meet(at[0], rows, threshold) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for r in (x for i in range(0, batch.num_rows, BLOCK) for x in batch.slice(i, BLOCK).to_pylist()):
                if (r["key"], r["unit"]) != at:
                    if rows:
                        yield links()
                    at, rows = (r["key"], r["unit"]), []
                rows.append(r)
        if rows:
            yield links()

    dealt = units.join(facts, "digest").select(UNIT).repartition("key", "unit").sortWithinPartitions("key", "unit")
    links = written(dealt.mapInArrow(lean(meet), "a binary, b binary"), "across")
    forget(units.sparkSession, units_at, codes_at)
    return links


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, class_id (the least id of the class), class_size, links
    (verified links of its text to other texts) and kept (whether it is the one document that stays)."""
    spark = docs.sparkSession
    rows, sketches_at = stored(sketched(docs), "sketches")
    nodes = rows.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("first"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.max("keys").alias("keys"))
    nodes, nodes_at = stored(nodes.select("digest", F.col("first.doc_id").alias("first_id"), "copies", "n", "keys"), "nodes")
    rows = written(rows.select("doc_id", "digest"), "rows")
    forget(spark, sketches_at)
    buckets = nodes.select("digest", "n", F.explode("keys").alias("key"))
    centres = buckets.groupBy("key").agg(F.min(F.struct("digest", "n")).alias("c"), F.count(F.lit(1)).alias("members")).where("members > 1")
    centres, centres_at = stored(centres, "centres")
    total = centres.agg(F.sum("members")).first()[0] or 0
    buckets, buckets_at = stored(salted_lookup(buckets, centres.select("key", "c"), "key", centres.select("key", F.col("members").alias("n")), total, ["digest"]).select("key", "digest", "n", F.col("c.digest").alias("a"), F.col("c.n").alias("an")), "buckets")
    stars = buckets.where(F.col("digest") != F.col("a")).where(_sizes_near(F.col("n"), F.col("an"), threshold)).select("a", F.col("digest").alias("b")).distinct()
    stars, stars_at = stored(stars, "stars")
    links = verified(stars, nodes, docs, threshold)
    forget(spark, centres_at, stars_at)
    labels = written(components(links), "labels")

    # Of buckets with several components, texts of different ones meet; a bucket's largest stands on one side only.
    open_ = _labelled(buckets.select("key", "digest", "a"), labels)
    sizes = open_.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.max("c").alias("mains"), (F.sum("c") - F.max("c")).alias("others")).where("others > 0")
    sizes, sizes_at = stored(sizes, "sizes")
    open_ = _at_keys(open_, sizes, sizes.select("key", "most")).select("key", "digest", "label", (F.col("label") == F.col("most")).alias("main"), (F.col("digest") == F.col("a")).alias("centre"))
    if not sizes.isEmpty():
        more = across(open_, sizes, nodes, docs, threshold)
        if not more.isEmpty():
            links = links.union(more)
            labels = written(components(links), "labels")
    forget(spark, buckets_at, sizes_at)

    degrees = links.select(F.col("a").alias("digest")).union(links.select(F.col("b").alias("digest"))).groupBy("digest").agg(F.count(F.lit(1)).alias("links"))
    named = written(_labelled(nodes.select("digest", "first_id", "copies"), labels).join(degrees, "digest", "left"), "named")
    forget(spark, nodes_at)
    groups = named.groupBy("label").agg(F.min(F.struct("first_id", "digest")).alias("keep"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "groups")
    told = salted_lookup(named, groups.drop("n"), "label", groups.select("label", "n"), rows.count(), ["digest"])
    told = written(told.select("digest", "copies", F.col("keep.first_id").alias("class_id"), F.col("keep.digest").alias("keep_digest"), "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links")), "told")
    out = salted_lookup(rows.select("doc_id", "digest").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("m")), told.drop("copies"), "digest", told.select("digest", F.col("copies").alias("n")), rows.count(), ["doc_id"])
    wins = (F.col("digest") == F.col("keep_digest")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    out = out.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))))
    return out.select("doc_id", "class_id", "class_size", "links", (wins & (F.col("nth") == 1)).alias("kept"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with all its columns, one row of each class: the one with the least id."""
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _numbered(docs, threshold)
    kept = written(classes(docs, threshold).where("kept").select(F.col("doc_id").alias("__id")), "kept")
    (id_, keep_id) = free_names(docs, "__i", "__id")
    named = docs.withColumn(id_, F.col("doc_id").cast("long"))
    return named.join(kept.withColumnRenamed("__id", keep_id), F.col(id_).eqNullSafe(F.col(keep_id)), "left_semi").drop(id_)


def _numbered(docs: DataFrame, threshold: float) -> DataFrame:
    """The same where ids repeat: rows are numbered first, and the number stands for the id."""
    (n,) = free_names(docs, "__n")
    numbered = written(docs.withColumn(n, F.monotonically_increasing_id()), "numbered")
    kept = classes(numbered.select(F.col(n).alias("doc_id"), "text"), threshold).where("kept").select(F.col("doc_id").alias(n))
    return numbered.join(kept, n, "left_semi").drop(n)
