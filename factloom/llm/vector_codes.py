"""Vectors as short codes: product quantization whose codebooks are fit by Lloyd rounds with Elkan's bounds.

A vector of integers is cut into PARTS equal parts. Each part keeps, from round to round, its entry, an upper bound of
the distance to it, and a lower bound for each entry of its codebook. When entries move, bounds are shifted by how far
they moved. An entry is measured only if neither its lower bound nor half its distance to the part's own entry is
greater than the upper bound. Both tests are strict and the bounds are rounded away from pruning, so an entry as near as
the best is always measured; measured distances are exact integers, of which the lower index wins a tie. So codes are
those of plain Lloyd rounds.

Bounds are a table in the shared folder, a row a vector: lower bounds take a byte each, floored to 255ths of the greatest.
A round reads its predecessor's table and writes its own, then sums are taken from that; the older table is removed only
when the next is whole, so that lost executors cost tasks, not rounds. What meets in the driver is bounded by the
codebooks: ENTRIES * width sums.

Null, non-finite and unequal vectors: see ``embeddings``; widths are filled up to a multiple of PARTS. With fewer than
ENTRIES vectors a codebook has an entry for each. Null ids sort last as seeds; of equal ids all rows are vectors of their
own, seeds by their components. Null labels are one group. An empty table has no rows. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, salted_lookup, stored
from .embeddings import integers, kept, packed, unpacked, width_of

PARTS, ENTRIES, ROUNDS = 4, 256, 4
OUTWARD = 1 + 1e-9  # bounds are kept that much looser than the square roots that made them
BLOCK = 4096
BOUNDS = "x binary, entry binary, upper binary, lower binary, step binary"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * float(most) ** 2 * x.shape[1] < 2**53:  # all sums are whole numbers that doubles hold
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return np.rint((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def _measured(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x - entries
    return np.einsum("ij,ij->i", d, d)


def first_round(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, lower bounds) of each row, all entries measured."""
    d = distances(x, entries)
    own = d.argmin(1)
    return own, d[np.arange(len(x)), own], np.sqrt(d) / OUTWARD


def next_round(x: np.ndarray, entries: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, squared distance, upper, lower) from bounds that hold for ``entries``; the distance is -1 where the bounds
    alone settle a row and ``every`` doesn't ask for it."""
    half = np.sqrt(distances(entries, entries)) / 2 / OUTWARD
    np.fill_diagonal(half, np.inf)
    own, upper, lower, found = own.copy(), upper.copy(), lower.copy(), np.full(len(x), -1, np.int64)
    asked = np.flatnonzero((upper >= half.min(1)[own]) | every)
    found[asked] = _measured(x[asked], entries[own[asked]])
    upper[asked] = np.sqrt(found[asked]) * OUTWARD
    for rows in np.array_split(asked, max(1, -(-len(asked) // BLOCK))):
        open_ = (lower[rows] <= upper[rows, None]) & (half[own[rows]] <= upper[rows, None])
        at, entry = np.nonzero(open_)  # in the order of entries within a row
        d = np.empty(len(at), np.int64)
        for k in range(0, len(at), 64 * BLOCK):
            s = slice(k, k + 64 * BLOCK)
            d[s] = _measured(x[rows[at[s]]], entries[entry[s]])
        lower[rows[at], entry] = np.sqrt(d) / OUTWARD
        lower[rows, own[rows]] = np.sqrt(found[rows]) / OUTWARD
        best = np.lexsort((np.concatenate([own[rows], entry]), np.concatenate([found[rows], d]), np.concatenate([np.arange(len(rows)), at])))
        who = np.concatenate([np.arange(len(rows)), at])[best]
        lead = best[np.concatenate([[True], who[1:] != who[:-1]])] if len(best) else best
        own[rows] = np.concatenate([own[rows], entry])[lead]
        found[rows] = np.concatenate([found[rows], d])[lead]
        upper[rows] = np.sqrt(found[rows]) * OUTWARD
    return own, found, upper, lower


def _floored(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes, and the step of each row."""
    step = np.maximum(lower.max(1) / 255, 1e-6).astype(np.float32)
    return np.clip(np.floor(lower / step[:, None] * (1 - 1e-6)), 0, 255).astype(np.uint8), step


def _bounds(batch: pa.RecordBatch, width: int, k: int) -> tuple[np.ndarray, ...]:
    return unpacked(batch["x"], np.int32, PARTS, width // PARTS).astype(np.int64), unpacked(batch["entry"], np.uint8, PARTS), unpacked(batch["upper"], np.float64, PARTS), unpacked(batch["lower"], np.uint8, PARTS, k), unpacked(batch["step"], np.float32, PARTS)


def _moved_round(batch: pa.RecordBatch, width: int, books: np.ndarray, moved: np.ndarray, every: bool) -> list[tuple]:
    """``next_round`` of each part, its bounds shifted by how far the entries moved."""
    x, entry, upper, lower, step = _bounds(batch, width, books.shape[1])
    out = []
    for p in range(PARTS):
        own = entry[:, p].astype(np.int64)
        up = (upper[:, p] + moved[p][own]) * OUTWARD
        low = np.maximum(lower[:, p] * step[:, p, None].astype(np.float64) - moved[p], 0) / OUTWARD
        out.append(next_round(x[:, p], books[p], own, up, low, every))
    return out


def _round(rows: DataFrame, keep: str, width: int, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """The table of bounds after assigning every part: of vectors, or of the table before if entries have ``moved``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if moved is None:
                x = integers(batch["vector"], width).reshape(batch.num_rows, PARTS, width // PARTS)
                made = [(own, d, np.sqrt(d) * OUTWARD, low) for own, d, low in (first_round(x[:, p], books[p]) for p in range(PARTS))]
                x = packed(x.astype(np.int32))
            else:
                made, x = _moved_round(batch, width, books, moved, False), batch["x"]
            lower, step = zip(*(_floored(m[3]) for m in made))
            columns = [x, packed(np.stack([m[0] for m in made], 1).astype(np.uint8)), packed(np.stack([m[2] for m in made], 1)), packed(np.stack(lower, 1)), packed(np.stack(step, 1))]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], *columns], ["vec_id", "label", "x", "entry", "upper", "lower", "step"])

    return rows.mapInArrow(each, f"{keep}, {BOUNDS}")


def _entries(assigned: DataFrame, width: int, books: np.ndarray) -> np.ndarray:
    """The codebooks after an update: floors of the means of what is assigned; unused entries stay."""
    k, w = books.shape[1], width // PARTS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, k, w + 1), np.int64)  # the last place counts
        for batch in batches:
            x, entry = unpacked(batch["x"], np.int32, PARTS, w).astype(np.int64), unpacked(batch["entry"], np.uint8, PARTS)
            for p in range(PARTS):
                np.add.at(total[p, :, :w], entry[:, p], x[:, p])
                total[p, :, w] += np.bincount(entry[:, p], minlength=k)
        part, at = np.nonzero(total[:, :, w])
        places = np.tile(np.arange(w + 1, dtype=np.int32), len(part))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.astype(np.int32), w + 1)), pa.array(np.repeat(at.astype(np.int32), w + 1)), pa.array(places), pa.array(total[part, at].ravel())], ["part", "entry", "place", "s"])

    made = assigned.select("x", "entry").mapInArrow(sums, "part int, entry int, place int, s long").groupBy("part", "entry", "place").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((PARTS, k, w + 1), np.int64)
    total[tuple(made[c].to_numpy() for c in ("part", "entry", "place"))] = made["s"].to_numpy()
    used = total[:, :, w] > 0
    out = books.copy()
    out[used] = total[used][:, :w] // total[used][:, w:]
    return out


def compress(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of (vec_id, embedding, label): the code's entries in hex, two
    digits a part; the squared distance to what they stand for; its sum over the label."""
    vectors = kept(rows, "label")
    spark, width = rows.sparkSession, width_of(vectors, PARTS)
    keep = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}"
    seeds = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").toArrow()["vector"]
    seeds = integers(seeds.combine_chunks(), width) if len(seeds) else np.zeros((1, width), np.int64)
    books = np.ascontiguousarray(seeds.reshape(len(seeds), PARTS, width // PARTS).transpose(1, 0, 2))
    table, path, moved = vectors, None, None
    for _ in range(rounds):
        table, made = stored(_round(table, keep, width, books, moved), "bounds")
        if path:
            forget(spark, path)
        path, before = made, books
        books = _entries(table, width, before)
        moved = np.sqrt(((books - before) ** 2).sum(2)) * OUTWARD
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if moved is None:
                x = integers(batch["vector"], width).reshape(batch.num_rows, PARTS, width // PARTS)
                made = [first_round(x[:, p], books[p]) for p in range(PARTS)]
            else:
                made = _moved_round(batch, width, books, moved, True)
            codes = np.stack([m[0] for m in made], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(m[1] for m in made), pa.int64())], ["vec_id", "label", "code", "error"])

    coded, _ = stored(table.mapInArrow(last, f"{keep}, code string, error long"), "codes")
    if path:
        forget(spark, path)
    named = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums, _ = stored(named.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    told = salted_lookup(named, sums.drop("n"), "__label", sums.select("__label", "n"), total, ["vec_id", "code"])
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
