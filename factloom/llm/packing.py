"""Best-fit packing of documents into sequences by exact-complement hashing.

Only the number of pieces of each length decides how to pack, so the plan is made from a table of at most
``capacity`` lengths and counts. It indexes the sums that one, two and three available lengths reach; from the
longest length down it consumes combinations that exactly fill the gap, as often as the counts allow; lengths
without an exact complement are packed by best fit. The plan is a list of runs: so many pieces of a length go to so
many successive sequences at an offset. Pieces are numbered within their length on the cluster and meet their run.

Null texts are empty and hold the end id alone; very long ones are cut, whole, a batch of pieces at a time; rows that
repeat are packed as often as they occur, pieces that tie in (doc_id, piece, start) in any order; null ids are ids. An
empty table gives no piece. Other columns of ``docs`` are not read; ``pack`` passes those of pieces on.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CHUNKS, encoder, free_names, lean, text_of

PIECES = "doc_id long, piece int, start long, length long, ids binary"
ROWS_A_BUCKET = 1_000_000


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, chunks: str | None = WORD_CHUNKS) -> DataFrame:
    """The documents' ids (little-endian unsigned 32-bit) with the end id, longer ones cut into ``capacity``."""
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, chunks, "I").encode
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    rows.append((doc_id, k, at // 4, (min(at + step, len(ids)) - at) // 4, ids[at : at + step]))
                size += len(ids)
                if size > 8_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lean(cut, encodes=True), PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids"])


class SumIndex:
    """Which sums one, two or three available lengths reach. Counts only fall, so a sum once out of reach stays so."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        has = (counts > 0).astype(np.float64)
        size = len(counts)
        self.pairs = np.rint(np.convolve(has, has)[:size]) > 0
        self.triples = np.rint(np.convolve(self.pairs.astype(np.float64), has)[:size]) > 0

    def pair(self, total: int) -> tuple[int, ...] | None:
        if total < 2 or not self.pairs[total]:
            return None
        a = np.arange((total + 1) // 2, total)
        c = self.counts
        ok = (c[a] > 0) & (c[total - a] > 0) & ((2 * a != total) | (c[a] > 1))
        if not ok.any():
            self.pairs[total] = False
            return None
        first = int(a[ok][-1])
        return first, total - first

    def find(self, total: int) -> tuple[int, ...] | None:
        """Lengths that sum to ``total``: one, else two, else three, the longest first."""
        if total < 1:
            return None
        if self.counts[total]:
            return (total,)
        if two := self.pair(total):
            return two
        if not self.triples[total]:
            return None
        c = self.counts
        a = np.arange(total - 2, 0, -1)
        for first in a[(c[a] > 0) & self.pairs[total - a]].tolist():
            c[first] -= 1
            two = self.pair_now(total - first)
            c[first] += 1
            if two:
                return (first, *two)
        self.triples[total] = False
        return None

    def pair_now(self, total: int) -> tuple[int, ...] | None:
        before = self.pairs[total]
        two = self.pair(total)
        self.pairs[total] = before  # one count was lent, so that a miss proves nothing
        return two


def plan(lengths: dict[int, int], capacity: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences), for all pieces of the given counts."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {capacity}")
        counts[length] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if counts[capacity]:
        out.append(((capacity,), int(counts[capacity])))
        counts[capacity] = 0
    index = SumIndex(counts)
    residual: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        while counts[length]:
            counts[length] -= 1
            rest = index.find(capacity - length)
            counts[length] += 1
            if not rest:
                residual[length] = int(counts[length])
                counts[length] = 0
                break
            used = (length, *rest)
            n = min(int(counts[x]) // used.count(x) for x in set(used))
            for x in used:
                counts[x] -= n
            out.append((used, n))
    return out + best_fit(residual, capacity)


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, with sequences of one filling handled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                a_sequence = capacity // length
                many, rest = divmod(left, a_sequence)
                for k, n in ((a_sequence, many), (rest, 1)):
                    if k and n:
                        open_.setdefault(capacity - k * length, []).append(((length,) * k, n))
                break
            filling, n = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            used = min(n, left)
            if n > used:
                open_.setdefault(gap, []).append((filling, n - used))
            open_.setdefault(gap - length, []).append(((*filling, length), used))
            left -= used
    return [x for some in open_.values() for x in some]


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first piece of that length, pieces, first sequence, offset) of each place in each pattern."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for used, n in patterns:
        offset = 0
        for x in used:
            first = taken.get(x, 0)
            taken[x] = first + n
            out.append((x, first, n, sequence, offset))
            offset += x
        sequence += n
    return out


def _dealt(placed: list[tuple[int, int, int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(length, width) and the runs with their block: blocks of ``width`` ranks, so that each has some two runs."""
    pieces_, runs_ = Counter(), Counter()
    for length, _, n, _, _ in placed:
        pieces_[length] += n
        runs_[length] += 1
    width = {x: -(-pieces_[x] // runs_[x]) for x in runs_}
    blocks = [(r[0], k, *r[1:]) for r in placed for k in range(r[1] // width[r[0]], (r[1] + r[2] - 1) // width[r[0]] + 1)]
    return list(width.items()), blocks


def pack(some: DataFrame, capacity: int = 4096) -> DataFrame:
    """``some`` pieces (doc_id, piece, start, length, and any more; a written table) with sequence_id and offset.

    A length that holds a third of all pieces is numbered in buckets by the hash of (doc_id, piece). Columns of those
    two names are replaced; others pass, whatever their names.
    """
    spark = some.sparkSession
    histogram = {r[0]: r[1] for r in some.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(histogram.values())
    buckets = max(64, -(-total // ROWS_A_BUCKET))
    bucket, count, before, nth, rank, width, block, first, n, sequence, place = free_names(some, *"__bucket __count __before __n __rank __width __block __first __m __sequence __place".split())
    widths, blocks = _dealt(runs(plan(histogram, capacity)))
    rows = some.withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    by_length = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    # The plan has some runs for each of `capacity` lengths at most, whatever the number of pieces: both tables are small.
    counts = rows.groupBy("length", bucket).agg(F.count(F.lit(1)).alias(count)).withColumn(before, F.coalesce(F.sum(count).over(by_length), F.lit(0))).drop(count)
    counts = counts.join(F.broadcast(spark.createDataFrame(widths, f"length long, {width} long")), "length")
    within = Window.partitionBy("length", bucket).orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn(nth, F.row_number().over(within)).join(counts, ["length", bucket]).withColumn(rank, F.col(before) + F.col(nth) - 1).withColumn(block, F.floor(F.col(rank) / F.col(width)))
    placed = spark.createDataFrame(blocks, f"length long, {block} long, {first} long, {n} long, {sequence} long, {place} long")
    joined = ranked.join(F.broadcast(placed), ["length", block]).where((F.col(rank) >= F.col(first)) & (F.col(rank) < F.col(first) + F.col(n)))
    kept = [F.col(f"`{c}`") for c in some.columns if c.lower() not in ("sequence_id", "offset")]
    return joined.select(*kept, (F.col(sequence) + F.col(rank) - F.col(first)).alias("sequence_id"), F.col(place).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids and ids, from pieces with their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most `capacity` tokens
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"]))).alias("h")).select("sequence_id", "n_tokens", "doc_ids", F.unhex("h").alias("ids"))
