"""N-gram Jaccard join: documents linked at a Jaccard similarity of 0.9 and more of their three-word shingles, exactly.

Sets at symmetric difference are a metric space. What of a set x lies outside a pivot set P is a distance to P that the
triangle inequality bounds: |x - P| <= |x - y| + |y - P|. Documents are dealt to pivots, each the union of its own
documents' shingles, which are at distance 0 of it: the nearest pivot, so a Voronoi region. If x and y link, at most a
tenth of x lies outside y; so x needn't meet documents of a region whose pivot leaves out more of it. Documents within that
window are replicated to the region, and each region is joined by itself, with pivots of its own. A pair of two regions
meets in the one of the lesser number. At the leaves sets are compared whole, as products of matrices of shared shingles.
No pair that links is lost, whatever the pivots.

1. Of each document a sample of its shingles (by hash; all of a short one) is held against the pivots of REGIONS random
   regions. Those that no other text within any window can reach link with nothing and are done.
2. The rest take pivot documents: by each of KEYS orders of hashes, those with the same least shingle gather around one of
   them, drawn by lot. Exact distances to it give links, and links cells: what is linked already needn't meet again, so that
   a group of near copies costs a row for each copy, not for each pair.
3. Of each, ``free`` shingles that no other cell has are counted. If x and y link, free(x) + free(y) is at most a tenth of
   their union, thus a ninth of the lesser. So texts with more than a tenth are done; two with more than an eighteenth each
   (heavy ones) never link. Another round of pivot documents takes those with the least share of free shingles, the middles
   of their groups.
4. Texts go to regions by their least shingle, which near texts share mostly, level by level, until regions have LEAF
   documents or windows no longer separate them; heavy ones only go where a light one of another cell is within reach.
   Large leaves are dealt in blocks, each two of which meet once.

Shingles are counted against pivots in slots of hashes: tasks deal packed arrays, about SLOT shingles to a slot. A shingle
of many cells among a task's rows is in most regions: it is counted as covered everywhere (windows only widen), and at most
two cells of each region go to its slot. A shingle of many documents of one cell asks once for all of them; who they are
waits in a slot of its own, where the answer, if there is one, is dealt on. So no slot has a hot group's rows.

Words are maximal runs without space, tab, line feed, vertical tab, form feed or return, A-Z in lower case. Texts of one or
two words have one shingle. Null and empty texts have none, are linked with nothing, and are components of their own.
Shingles and cells are told apart by 64-bit hashes, sets by 128. Null ids don't name a component while another id is there.
Repeated rows have a row each. Very long texts are taken whole. Other columns aren't read. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, salted_lookup, stored, text_of
from .components import components
from .embeddings import unpacked

SHINGLE, PERCENT = 3, 90
REGIONS, LEVELS, LEAF, BLOCK, BLOCK_HASHES = 32, 4, 2048, 512, 1_000_000
KEYS, FEWEST = 16, 96
COARSE, FINE = 0.22, 1.0  # shares of a long text's shingles that are held against pivots, first and within regions
SLOT, BUFFER, COMMON = 2_000_000, 1_500_000, 96
KNOWN_WORDS = 300_000
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
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
    if len(x) < SHINGLE:
        x = np.concatenate([x, np.full(SHINGLE - len(x), len(x), np.uint64)])
    n = len(x) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * M3 + x[k : k + n]
    return np.unique(_mix(h))


def digest_of(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _limits(n: np.ndarray, share: float) -> np.ndarray:
    """The greatest hash that texts of n shingles hold against pivots: less of longer ones."""
    rate = np.maximum(share, np.minimum(1.0, FEWEST / np.maximum(n, 1.0)))
    return np.where(rate >= 1, 2.0**64 - 2048, rate * (2.0**64 - 2048)).astype(np.uint64)


def _build_limits(n: np.ndarray, share: float) -> np.ndarray:
    """The same for the shortest text that links with one of n."""
    return _limits(np.floor(n * (PERCENT / 100)), share)


def sets(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the set, its size n, and the part of its hashes that may be held against pivots."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, parts = [], [], []
            for text in batch["text"].to_pylist():
                h = shingles(text)
                digests.append(digest_of(h))
                sizes.append(len(h))
                parts.append(h[: np.searchsorted(h, _build_limits(np.array([len(h)]), COARSE)[0], "right")].tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "digest", "n", "part"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, "doc_id long, digest binary, n long, part binary")


# Shingles against pivots

PARTS = ["keys", "refs", "cells", "asks", "told", "masks", "who", "members", "facts"]
DEALT = "slot long, grouped boolean, " + ", ".join(f"{c} binary" for c in PARTS)
ALL = np.uint64(2**64 - 1)
FACT = np.dtype([("ref", np.int64), ("n", np.int64), ("asked", np.int64), ("bit", np.int64)])
NO_ANSWER, ONE, GROUP = 0, 1, 2  # what of a row asks: nothing, an entry, several of a cell
KIND, BIT = np.uint8(3), np.uint8(2)  # of ``asks``: the kind, and from which bit on its region's number (heavy ones' from REGIONS on)


def _split(slots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each slot with the places of its rows."""
    order = np.argsort(slots, kind="stable")
    cut = np.flatnonzero(np.diff(slots[order])) + 1
    for at in np.split(order, cut) if len(order) else []:
        yield int(slots[at[0]]), at


def _cells_of(keys: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """How many cells each key has; keys are sorted."""
    order = np.lexsort((cells, keys))
    k, c = keys[order], cells[order]
    new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (c[1:] != c[:-1])
    return np.bincount(np.cumsum(new_key) - 1, new)


class _Dealt:
    """Rows of DEALT, made of arrays that are dealt to slots."""

    def __init__(self, slots: int):
        self.slots, self.rows = np.uint64(slots), []

    def add(self, by: np.ndarray, grouped: bool = False, **parts: np.ndarray) -> None:
        for slot, at in _split((by.view(np.uint64) % self.slots).astype(np.int64)):
            self.put(slot, grouped, **{c: x[at].tobytes() for c, x in parts.items()})

    def put(self, slot: int, grouped: bool = False, **parts: bytes) -> None:
        self.rows.append((slot, grouped, *(parts.get(c, b"") for c in PARTS)))

    def batch(self) -> pa.RecordBatch:
        types = [pa.int64(), pa.bool_(), *[pa.binary()] * len(PARTS)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in self.rows], t) for k, t in enumerate(types)], ["slot", "grouped", *PARTS])


def _deal(share: float, slots: int, common: int) -> Callable:
    """Entries (ref, cell, region, bit, n, part) as rows of DEALT: their shingles by slot of the hash, what is known of them by
    slot of the entry."""

    def asked_once(keys: np.ndarray, refs: np.ndarray, cells: np.ndarray, asks: np.ndarray, out: _Dealt) -> tuple[np.ndarray, ...]:
        """The rows with one for each shingle, cell and region of which more than ``common`` entries ask."""
        order = np.lexsort((asks >> BIT, cells, keys))
        keys, refs, cells, asks = keys[order], refs[order], cells[order], asks[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1]) | (asks[1:] >> BIT != asks[:-1] >> BIT)
        group = np.cumsum(new) - 1
        big = (np.bincount(group, asks & KIND) > common)[group] if len(group) else new
        if not big.any():
            return keys, refs, cells, asks
        lead = big & new
        nonce = np.uint64(xxhash.xxh3_64_intdigest(refs.tobytes()))
        names = _mix(keys ^ _mix(cells.view(np.uint64) + (asks >> BIT)) ^ nonce).view(np.int64)  # of the groups, in this buffer
        names[big] = names[np.flatnonzero(new)][group[big]]
        members = big & (asks & KIND == ONE)
        out.add(names[members], True, who=names[members], members=refs[members])
        refs, asks = np.where(lead, names, refs), np.where(lead, (asks & ~KIND) | GROUP, asks).astype(np.uint8)
        stay = ~big | lead
        return keys[stay], refs[stay], cells[stay], asks[stay]

    def known_everywhere(keys: np.ndarray, refs: np.ndarray, cells: np.ndarray, asks: np.ndarray, out: _Dealt) -> tuple[np.ndarray, ...]:
        """The rows with two cells of each region for shingles of more than ``common`` cells."""
        h = asks >> BIT
        order = np.lexsort((cells, h, keys))
        keys, refs, cells, asks, h = keys[order], refs[order], cells[order], asks[order], h[order]
        new_key = np.ones(len(keys), bool)
        new_key[1:] = keys[1:] != keys[:-1]
        new_home = new_key.copy()
        new_home[1:] |= h[1:] != h[:-1]
        new_cell = new_home.copy()
        new_cell[1:] |= cells[1:] != cells[:-1]
        of_key, of_home, nth = np.cumsum(new_key) - 1, np.cumsum(new_home) - 1, np.cumsum(new_cell)
        often = (_cells_of(keys, cells) > common)[of_key] if len(keys) else new_key
        if not often.any():
            return keys, refs, cells, asks
        for kind in (ONE, GROUP):
            told = refs[often & (asks & KIND == kind)]
            out.add(told, kind == GROUP, told=told, masks=np.full(len(told), ALL))
        second = nth - nth[np.flatnonzero(new_home)][of_home] < 2
        stay = ~often | (new_cell & second)
        return keys[stay], refs[stay], cells[stay], np.where(often, asks & ~KIND, asks).astype(np.uint8)[stay]

    def flush(some: list[tuple]) -> pa.RecordBatch:
        ref, cell, region, bit, n, counts, flat = (np.concatenate([s[k] for s in some]) for k in range(7))
        at = np.repeat(np.arange(len(ref)), counts)
        again = np.ones(len(ref), bool)
        again[np.unique(ref, return_index=True)[1]] = False  # copies within the buffer say nothing new
        fits = ~again[at] & (flat <= _build_limits(n, share)[at])
        at, flat = at[fits], flat[fits]
        asks = (flat <= _limits(n, share)[at]).astype(np.uint8)
        facts = np.zeros(len(ref), FACT)
        facts["ref"], facts["n"], facts["asked"], facts["bit"] = ref, n, np.bincount(at, asks, len(ref)), bit
        out = _Dealt(slots)
        out.add(facts["ref"][~again].copy(), facts=facts[~again])
        rows = (_mix(flat ^ region.view(np.uint64)[at]), ref[at], cell[at], asks | (bit[at].astype(np.uint8) << BIT))
        keys, refs, cells, asks = known_everywhere(*asked_once(*rows, out), out)
        out.add(keys, keys=keys, refs=refs, cells=cells, asks=asks)
        return out.batch()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for b in batches:
            counts = np.array([len(x.as_py()) // 8 for x in b["part"]], np.int64)
            some.append((*(b[c].to_numpy() for c in ("ref", "cell", "region", "bit", "n")), counts, unpacked(b["part"], np.uint64)))
            held += counts.sum() + len(counts)
            if held >= BUFFER:
                yield flush(some)
                some, held = [], 0
        if some:
            yield flush(some)

    return each


def _slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one slot together; they come sorted by it."""
    slot, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["slot"] != slot:
                if rows:
                    yield slot, rows
                slot, rows = r["slot"], []
            rows.append(r)
    if rows:
        yield slot, rows


def _all(rows: list[dict], column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _elsewhere(keys: np.ndarray, cells: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each row, the regions in which its key has another cell than its own, as bits."""
    order = np.lexsort((cells, bits, keys))
    k, c, b = keys[order], cells[order], np.uint64(1) << bits[order].astype(np.uint64)
    new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    alone = c[starts] == c[np.concatenate([starts[1:], [len(k)]]) - 1]  # a region with one cell only
    every = np.bitwise_or.reduceat(b, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
    of_own = np.where(alone, b[starts], np.uint64(0))[np.cumsum(new) - 1]
    by_cell = np.lexsort((c, k))
    new[1:] = (k[by_cell][1:] != k[by_cell][:-1]) | (c[by_cell][1:] != c[by_cell][:-1])
    own = np.empty(len(k), np.uint64)
    own[by_cell] = np.bitwise_or.reduceat(of_own[by_cell], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.empty(len(k), np.uint64)
    out[order] = every & ~own
    return out


def _cover(slots: int) -> Callable:
    """For each shingle that is asked of: the regions in which another cell has it, as bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in _slots_of(batches):
            out = _Dealt(slots)
            for r in rows:
                if not r["keys"]:  # on its way to where its entry is
                    out.put(slot, r["grouped"], **{c: r[c] for c in PARTS})
            keys, refs, cells, asks = (_all(rows, c, t) for c, t in (("keys", np.uint64), ("refs", np.int64), ("cells", np.int64), ("asks", np.uint8)))
            if len(keys):
                masks = _elsewhere(keys, cells, asks >> BIT)
                for kind in (ONE, GROUP):
                    found = np.flatnonzero((asks & KIND == kind) & (masks != 0))
                    found = found[np.lexsort((refs[found], keys[found]))]
                    first = np.ones(len(found), bool)
                    first[1:] = (keys[found][1:] != keys[found][:-1]) | (refs[found][1:] != refs[found][:-1])
                    found = found[first]
                    out.add(refs[found], kind == GROUP, told=refs[found], masks=masks[found])
            yield out.batch()

    return each


def _expand(slots: int) -> Callable:
    """Answers to groups as answers to their members."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _slots_of(batches):
            out = _Dealt(slots)
            who, members, told, masks = (_all(rows, c, t) for c, t in (("who", np.int64), ("members", np.int64), ("told", np.int64), ("masks", np.uint64)))
            order = np.argsort(who, kind="stable")
            who, members = who[order], members[order]
            low, high = np.searchsorted(who, told), np.searchsorted(who, told, "right")
            at = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum()) if len(told) else np.empty(0, np.int64)
            out.add(members[at], told=members[at], masks=np.repeat(masks, high - low))
            yield out.batch()

    return each


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, bit, regions, free): the regions whose window an entry is in, as bits, and how many of the shingles that it
    asks of no other cell has. Entries in no window have no row."""
    for _, rows in _slots_of(batches):
        facts = np.unique(_all(rows, "facts", FACT))
        told, masks = _all(rows, "told", np.int64), _all(rows, "masks", np.uint64)
        at = np.searchsorted(facts["ref"], told)
        order = np.argsort(at, kind="stable")
        at, masks = at[order], masks[order]
        spare = facts["asked"] - facts["n"] * (100 - PERCENT) // 100  # so many of what it asks of must be covered
        free = np.maximum(facts["asked"] - np.bincount(at, minlength=len(facts)), 0)
        regions = np.where(spare <= 0, ALL, np.uint64(0))
        if len(at):
            who, starts = np.unique(at, return_index=True)
            for bit in range(2 * REGIONS):
                covered = np.add.reduceat((masks >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
                regions[who] |= np.where(covered >= spare[who], np.uint64(1) << np.uint64(bit), np.uint64(0))
        some = (regions != 0) & (free * 100 <= facts["n"] * (100 - PERCENT))
        yield pa.RecordBatch.from_arrays([pa.array(facts["ref"][some]), pa.array(facts["bit"][some].astype(np.int32)), pa.array(regions[some].view(np.int64)), pa.array(free[some])], ["ref", "bit", "regions", "free"])


def windows(entries: DataFrame, shingle_count: int, share: float, common: int = COMMON) -> tuple[DataFrame, str]:
    """(ref, bit, regions, free) of entries (ref, cell, region, bit, n, part) that are in a window of another cell. ``bit`` is
    the number of an entry's own region, from REGIONS on for heavy ones."""
    slots = max(16, shingle_count // SLOT)
    grouped = lambda df: df.repartition("slot").sortWithinPartitions("slot")
    dealt = entries.select("ref", "cell", "region", F.col("bit").cast("long").alias("bit"), "n", "part").mapInArrow(_deal(share, slots, common), DEALT)
    covered, path = stored(grouped(dealt).mapInArrow(_cover(slots), DEALT), "covered")
    answers = covered.where("not grouped").union(grouped(covered.where("grouped")).mapInArrow(_expand(slots), DEALT))
    told = stored(grouped(answers).mapInArrow(_windows, "ref long, bit int, regions long, free long"), "windows")
    forget(entries.sparkSession, path)
    return told


# Pivot documents

CODED = "digest binary, n long, codes binary, keys array<long>"
ODD = [int.from_bytes(xxhash.xxh3_64_digest(f"pivot {j}")) | 1 for j in range(KEYS)]


def coded(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """digest, n, all hashes and pivot keys of the sets that ``wanted`` (first_id, digest) names."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, asked in zip(batch["text"].to_pylist(), batch["__digest"].to_pylist()):
                h = shingles(text)
                if digest_of(h) == asked:  # else another text with the same id
                    found.append((asked, len(h), h.tobytes(), [int(_mix((h * np.uint64(o)).min()[None])[0] >> np.uint64(1)) ^ j for j, o in enumerate(ODD)]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["digest", "n", "codes", "keys"])

    texts = docs.select(F.col("doc_id").cast("long").alias("__i"), text_of().alias("text"))
    asked = wanted.select(F.col("first_id").alias("__id"), F.col("digest").alias("__digest"))
    return texts.join(asked, F.col("__i").eqNullSafe(F.col("__id"))).select("text", "__digest").mapInArrow(code, CODED)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays have in common."""
    at = np.searchsorted(a, b)
    return int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    both = shared(a, b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def pivot_links(sets_: DataFrame, central: bool = False) -> DataFrame:
    """Links (a, b) of sets to the pivots with which they share a least shingle: drawn by lot for each key, or those with the
    least share of ``free`` shingles. Of a cell (``label``) that has its pivot, if sets have one, only other cells' meet it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["codes_a"], batch["codes_b"]
            good = [i for i in range(batch.num_rows) if linked(np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64))]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    spark, c = sets_.sparkSession, F.col
    label = c("label") if "label" in sets_.columns else c("digest")
    buckets = sets_.select("digest", "n", label.alias("label"), (c("free") / c("n") if central else F.lit(0.0)).alias("share"), F.explode("keys").alias("key"))
    order = F.struct("share", F.xxhash64("digest") if central else F.xxhash64("digest", "key"), "digest")
    pivots = buckets.groupBy("key").agg(F.min_by(F.struct("digest", "n", "label"), order).alias("p"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pivots, first = stored(pivots.select("key", c("p.digest").alias("a"), c("p.n").alias("an"), c("p.label").alias("al"), "members"), "pivots")
    total = pivots.agg(F.sum("members")).first()[0] or 0
    met = salted_lookup(buckets, pivots.drop("members"), "key", pivots.select("key", c("members").alias("n")), total, ["digest"])
    near = (c("label") != c("al")) & (100 * F.least("n", "an") >= PERCENT * F.greatest("n", "an"))
    pairs, second = stored(met.where(near).select("a", c("digest").alias("b")).distinct(), "pairs")
    counts, codes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), sets_.select("digest", "codes")
    left = pairs.join(codes.select(c("digest").alias("b"), c("codes").alias("codes_b")), "b")
    both = salted_lookup(left, codes.select(c("digest").alias("a"), c("codes").alias("codes_a")).join(counts.select("a"), "a", "left_semi"), "a", counts, pairs.count(), ["b"])
    links, _ = stored(both.select("a", "b", "codes_a", "codes_b").mapInArrow(measure, "a binary, b binary"), "links")
    forget(spark, first, second)
    return links


# Regions

MEMBER = ["region", "digest", "label", "n", "heavy"]


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))


def _bit(level: int) -> Column:
    """A set's region at a level by its least shingle of that order; that of heavy ones from REGIONS on."""
    return F.pmod(F.xxhash64(F.get("keys", F.lit(level % KEYS))), F.lit(REGIONS)) + F.when(F.col("heavy"), REGIONS).otherwise(0)


def opened(sets_: DataFrame, labels: DataFrame, common: int = COMMON) -> tuple[DataFrame, str]:
    """The sets that may link with another cell's (digest, label, n, codes, keys, free, heavy), and the path of the table."""
    spark, c = sets_.sparkSession, F.col
    ref = F.xxhash64("digest")
    named, at = stored(_labelled(sets_, labels).withColumn("heavy", F.lit(False)), "named")
    count = named.agg(F.sum("n")).first()[0] or 0
    entries = named.select(ref.alias("ref"), F.xxhash64("label").alias("cell"), F.lit(0).cast("long").alias("region"), _bit(0).alias("bit"), "n", c("codes").alias("part"))
    told, used = windows(entries, count, FINE, common)
    out = named.drop("heavy").withColumn("ref", ref).join(told.select("ref", "free"), "ref").drop("ref")
    out = stored(out.withColumn("heavy", 200 * c("free") > (100 - PERCENT) * F.floor(100 * c("n") / F.lit(PERCENT))), "opened")
    forget(spark, at, used)
    return out


def regions_of(sets_: DataFrame, leaf: int = LEAF, common: int = COMMON) -> tuple[DataFrame, list[str]]:
    """(region, digest, label, n) of the leaves of ``opened`` sets: those of different cells that are within each other's
    windows; and the paths of the tables that hold them."""
    spark, c = sets_.sparkSession, F.col
    members, leaves, paths = sets_.select(F.lit(0).cast("long").alias("region"), "digest", "label", "n", "heavy"), [], []
    size = members.count()
    for level in range(1, LEVELS + 1):
        if size <= leaf or level == LEVELS:
            leaves.append(members)
            break
        ref = F.xxhash64("region", "digest")
        entries = members.join(sets_.select("digest", "keys", c("codes").alias("part")), "digest").withColumn("bit", _bit(level))
        count = members.agg(F.sum("n")).first()[0]
        told, used = windows(entries.withColumn("ref", ref).withColumn("cell", F.xxhash64("label")), count, FINE, common)
        light = F.expr("regions & 4294967295")
        inside = lambda j: F.getbit(light, j) == 1
        of_light = F.filter(F.sequence(F.lit(0), F.lit(REGIONS - 1)), lambda j: (j < c("bit")) & inside(j))
        stays = F.expr("shiftrightunsigned(regions & 4294967295, bit) != 0 or shiftrightunsigned(regions, 32) != 0")  # pairs of two regions meet in the lesser, heavy ones where light ones are
        to = F.when(c("bit") >= REGIONS, F.filter(F.sequence(F.lit(0), F.lit(REGIONS - 1)), inside)).otherwise(F.concat(of_light, F.when(stays, F.array("bit")).otherwise(F.array().cast("array<int>"))))
        named = members.withColumn("ref", ref).join(told.select("ref", F.explode(to).alias("to")), "ref")
        made, path = stored(named.select(F.xxhash64("region", "to", F.lit(level)).alias("region"), "digest", "label", "n", "heavy"), "members")
        forget(spark, used)
        paths.append(path)
        sizes, sizes_at = stored(made.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("label").alias("cells")).where("cells > 1"), "sizes")
        paths.append(sizes_at)
        total = made.count()
        if total > 4 * size:  # windows don't separate them: blocks cost less than another level
            leaves.append(members)
            break
        rows = salted_lookup(made, sizes.select("region", "size"), "region", sizes.select("region", c("size").alias("n")), total, ["digest"])
        leaves.append(rows.where(c("size") <= leaf).select(*MEMBER))
        members = rows.where(c("size") > leaf).select(*MEMBER)
        size = members.count()
        if not size:
            break
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return out.select("region", "digest", "label", "n"), paths


def _units(leaves: DataFrame) -> DataFrame:
    """(region, unit, whole, block, digest, label): large leaves dealt to blocks, each two of which meet in a unit; ``whole``
    units also compare what is in one block. A leaf's largest cell doesn't meet itself."""
    c = F.col
    cells = leaves.groupBy("region", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    most = F.struct("k", "label", "s")
    cells = cells.groupBy("region").agg(F.max(most).alias("most"), F.sum("k").alias("n"), F.sum("s").alias("s"))
    blocks = lambda k, s: F.greatest(F.ceil(k / BLOCK), F.ceil(s / BLOCK_HASHES))
    sizes = cells.select("region", c("most.label").alias("most"), "n", blocks(c("n") - c("most.k"), c("s") - c("most.s")).alias("p"), blocks(c("most.k"), c("most.s")).alias("q"))
    rows = salted_lookup(leaves.drop("n"), sizes.drop("n"), "region", sizes.select("region", "n"), leaves.count(), ["digest"])
    rows = rows.withColumn("main", c("label") == c("most")).withColumn("block", F.pmod(F.xxhash64("digest"), F.when(c("main"), c("q")).otherwise(c("p"))))
    to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    unit = lambda u, whole: F.struct(u.alias("unit"), whole.alias("whole"))
    inner = F.transform(to(c("p")), lambda j: unit(F.least(c("block"), j) * c("p") + F.greatest(c("block"), j), j == c("block")))
    outer = F.transform(to(c("q")), lambda j: unit(c("p") * c("p") + c("block") * c("q") + j, F.lit(False)))
    of_main = F.transform(to(c("p")), lambda i: unit(c("p") * c("p") + i * c("q") + c("block"), F.lit(False)))
    one = F.array(unit(F.lit(0).cast("long"), F.lit(True)))
    units = F.when((c("p") == 1) & (c("q") == 1), one).when(c("main"), of_main).otherwise(F.concat(inner, outer))
    return rows.select("region", "digest", "label", "main", "block", F.explode(units).alias("u")).select("region", "u.*", "main", "block", "digest", "label")


def common_counts(sets_: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each two arrays have in common, by products of matrices of what occurs more than once."""
    flat, who = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), [len(s) for s in sets_])
    _, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    place, keep = np.cumsum(often) - 1, often[at]
    who, at = who[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    out = np.zeros((len(sets_), len(sets_)), np.float32)
    for k in range(0, int(often.sum()), columns):
        low, high = np.searchsorted(at, [k, k + columns])
        m = np.zeros((len(sets_), min(columns, int(often.sum()) - k)), np.float32)
        m[who[low:high], at[low:high] - k] = 1
        out += m @ m.T
    return out.astype(np.int64)


def meet(rows: list[dict]) -> list[tuple[bytes, bytes]]:
    """Links (a, b) that join cells of one unit: as many as connect what links connect."""
    sets_ = [np.frombuffer(r["codes"], np.uint64) for r in rows]
    n = np.array([len(s) for s in sets_])
    both = common_counts(sets_)
    names = {x: i for i, x in enumerate(dict.fromkeys(r["label"] for r in rows))}
    cell, block, whole = np.array([names[r["label"]] for r in rows]), np.array([r["block"] + (1 << 40) * r["main"] for r in rows]), rows[0]["whole"]
    good = (100 * both >= PERCENT * (n[:, None] + n[None, :] - both)) & (cell[:, None] != cell[None, :])
    if not whole:
        good &= block[:, None] != block[None, :]
    links = []
    for i, j in zip(*np.nonzero(np.triu(good, 1))):
        if cell[i] != cell[j]:
            cell[cell == cell[j]] = cell[i]
            links.append(tuple(sorted((rows[i]["digest"], rows[j]["digest"]))))
    return links


def region_links(leaves: DataFrame, sets_: DataFrame) -> DataFrame:
    """Links (a, b) between cells of the same leaf."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked_rows(rows: list[dict]) -> pa.RecordBatch:
            found = meet(rows) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        at, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["region"], r["unit"]) != at:
                    if rows:
                        yield linked_rows(rows)
                    at, rows = (r["region"], r["unit"]), []
                rows.append(r)
        if rows:
            yield linked_rows(rows)

    dealt = _units(leaves).join(sets_.select("digest", "codes"), "digest").select("region", "unit", "whole", "main", "block", "digest", "label", "codes")
    return dealt.repartition("region", "unit").sortWithinPartitions("region", "unit").mapInArrow(each, "a binary, b binary")


def join(docs: DataFrame, leaf: int = LEAF, common: int = COMMON) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text): the size of its set, and the least doc_id that links
    reach from it."""
    spark, c = docs.sparkSession, F.col
    every, every_at = stored(sets(docs), "sets")
    count = every.agg(F.sum(F.length("part") / 8)).first()[0] or 0
    ref = F.xxhash64("digest")
    entries = every.where("n > 0").select(ref.alias("ref"), ref.alias("cell"), F.lit(0).cast("long").alias("region"), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(REGIONS)).alias("bit"), "n", "part")
    open_, open_at = windows(entries, int(count), COARSE, common)
    rows, _ = stored(every.drop("part"), "rows")
    forget(spark, every_at)
    nodes, nodes_at = stored(rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "nodes")
    some = coded(nodes.withColumn("ref", ref).join(open_.select("ref"), "ref", "left_semi"), docs)
    sets_, sets_at = stored(some.dropDuplicates(["digest"]) if not rows.groupBy("doc_id").count().where("count > 1").isEmpty() else some, "codes")
    forget(spark, open_at)
    links = pivot_links(sets_)
    labels, labels_at = stored(components(links), "labels")
    near, near_at = opened(sets_, labels, common)
    forget(spark, sets_at, labels_at)
    links = links.union(pivot_links(near, central=True))
    labels, labels_at = stored(components(links), "labels")
    near, last_at = opened(near.drop("label", "free", "heavy"), labels, common)
    forget(spark, near_at)
    leaves, paths = regions_of(near, leaf, common)
    more, _ = stored(region_links(leaves, near), "links")
    forget(spark, last_at, labels_at, *paths)
    labels, _ = stored(components(links.union(more)), "labels")
    named, named_at = stored(_labelled(nodes, labels), "named")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    least, _ = stored(least, "least")
    told = salted_lookup(named, least.drop("n"), "label", least.select("label", "n"), nodes.count(), ["digest"])
    told, _ = stored(told.select("digest", "copies", "component_id"), "told")
    forget(spark, named_at, nodes_at)
    out = salted_lookup(rows.where("n > 0").select("doc_id", "digest", "n"), told.drop("copies"), "digest", told.select("digest", c("copies").alias("n")), rows.count(), ["doc_id"])
    out = out.select("doc_id", c("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", "n", c("doc_id").alias("component_id")))
