"""Seeded merge-dropout: byte-fallback BPE whose candidate merges are skipped by a keyed hash.

Merges run from an agenda ordered by score, then place. A candidate that comes up is skipped for good with
probability ``dropout``, decided by a hash of (seed, document, place of the chunk in it, number of the candidate), so a
run repeats exactly and another seed gives other segmentations; without dropout they are the library's. Every
segmentation decodes to the same text.

Texts are cut before runs of spaces, and between letters and other characters where no piece of the vocabulary
crosses. Each chunk of each text has draws of its own: a hash gives how many candidates pass until the next that is
skipped. What a chunk becomes depends on the numbers of its skipped candidates alone, so that is kept, with how many
candidates come up. Chunks without skips are the library's to cut; those with skips that aren't known are taken together. The mark for spaces itself is spelt in bytes, so that it, too, decodes to itself.

Null texts are empty and have no token. Very long chunks take n log n steps. Candidates of one piece that tie go by
place. Rows that repeat get equal tokens. Other columns are not read, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import math
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"
KEPT_CHUNKS, KEPT_CHARS = 500_000, 40  # in each of two generations, with what becomes of them by skips
MASK = 2**64 - 1
NEVER = 2**62
GONE = -(2**30)  # of a place whose piece went into the one before
TOGETHER = 2048  # chunks with skips that are taken together
DRAWS = 5  # of a chunk, that are taken with those of other chunks of a text; what becomes of chunks by more isn't looked up
_CANDIDATES, _KEPT_IDS = itemgetter(0), itemgetter(1)  # of what is kept of a chunk


class Pieces:
    """The vocabulary of a model file: scores of pieces that merges make, ids, byte pieces, and bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.get_piece_size())
        other = {i for i in every if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.id = {sp.id_to_piece(i): i for i in every if i not in other}
        self.piece = sorted(self.id, key=lambda p: -sp.get_score(self.id[p]))  # by rank, which stands for a piece below
        self.rank = {p: k for k, p in enumerate(self.piece)}
        self.ids = [self.id[p] for p in self.piece]
        splits = ((p, p[:k], p[k:]) for p in self.piece for k in range(1, len(p)))
        self.pair = {self.rank[a] << 32 | self.rank[b]: self.rank[p] for p, a, b in splits if a in self.rank and b in self.rank}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [b"" if i in other else sp.id_to_piece(i).replace(MARK, " ").encode() for i in every]
        for b, i in enumerate(self.byte):
            self.bytes[i] = bytes([b])
        self.pair_keys = np.array(sorted(self.pair), np.int64)
        self.pair_made = np.array([*map(self.pair.get, self.pair_keys.tolist()), NEVER], np.int64)
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)  # ranks, and numbers below 0 as of ``_ranks``
        for p, k in self.rank.items():
            if len(p) == 1:
                self.of_char[ord(p)] = k
        self.id_of = np.array(self.ids, np.uint16)
        self.byte_ids = frozenset(self.byte)
        self.mark = array("H", [self.byte[b] for b in MARK.encode()]).tobytes()
        self.chunks = re.compile(self._cuts()).findall

    def _cuts(self) -> str:
        """Letters and other characters apart, but for letters that some piece joins with others."""
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id):
            return r"(?s).+"
        sticky = "_"
        while True:
            letter, rest = rf"[^\W{sticky}]", rf"(?:(?!{MARK})[\W{sticky}])"
            joints = [m for p in self.id for m in re.findall(f"(?=({letter}{rest}|{rest}{letter}))", p)]
            more = {c for j in joints for c in j if re.fullmatch(letter, c)}
            if not more:
                return f"{MARK}*{letter}+|{MARK}*{rest}+|{MARK}+"
            sticky += "".join(sorted(more))


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def _mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Segmenter:
    """``variants`` is not used: draws are for each chunk of each text."""

    def __init__(self, path: str, seed: int, dropout: float, variants: int | None = None):
        self.pieces, self.seed, self.below = Pieces(path), seed, round(dropout * 2**16)
        self.scale = -1 / math.log1p(-self.below / 2**16) if 0 < self.below < 2**16 else 0.0
        self.known: dict[str, list] = {}  # of each chunk, by skips: how many candidates come up (or -1), ids, what follows
        self.older: dict[str, list] = {}  # the generation before; of chunks that are met again, what becomes of them without skips is kept
        self.n_made = 0

    def _stream(self, chunk: str, variant: int) -> Iterator[bool]:
        """For one candidate after another, whether it is skipped."""
        key = self.seed * 1_000_003 + variant
        for block in itertools.count():
            for x in memoryview(xxhash.xxh3_128_digest(chunk, (key + block * 0x9E3779B97F4A7C15) & MASK)).cast("H"):
                yield x < self.below

    def _draw(self, x: np.ndarray, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The next draw of each key, and how many candidates it lets pass before one is skipped; ``later`` if there was one."""
        x = _mixed_all(x + np.uint64(0x9E3779B97F4A7C15) if later else x)
        if not self.below:
            return x, np.full(len(x), NEVER)
        return x, (-np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * self.scale).astype(np.int64)

    def _gaps(self, start: int, n: int, times: int = 1) -> list[np.ndarray]:
        """For each of n keys from ``start``, how many candidates pass before the first skipped one, from there to the
        next, and so on, ``times`` times."""
        x, out = np.uint64(start) + np.arange(n, dtype=np.uint64), []
        for k in range(times):
            x, gaps = self._draw(x, k > 0)
            out.append(gaps)
        return out

    def _later(self, n: int, key: int) -> Iterator[int]:
        """The numbers of the candidates that are skipped after number ``n``, whose draw ended in ``key``."""
        while True:
            key = _mixed((key + 0x9E3779B97F4A7C15) & MASK)
            n += 1 + int(-math.log(((key >> 11) + 0.5) * 2.0**-53) * self.scale)
            yield n

    def _made(self, chunk: str, skips: tuple[int, ...]) -> tuple[int, bytes]:
        """How many candidates come up if those of the numbers ``skips`` are skipped, and the ids."""
        n, at, _ = self._short(chunk, skips)
        return n, self._ids(at)

    def _again(self, chunk: str, first: int, key: int) -> bytes:
        """The ids of a chunk whose candidate ``first`` is skipped; ``key`` decides on the later ones."""
        return self._ids(self._short(chunk, itertools.chain([first], self._later(first, key)))[1])

    def _in_turn(self, gap: int, key: int) -> Iterator[bool]:
        """The same draws as ``_again`` takes, for one candidate after another."""
        while True:
            yield from itertools.repeat(False, gap)
            yield True
            key = _mixed((key + 0x9E3779B97F4A7C15) & MASK)
            gap = int(-math.log(((key >> 11) + 0.5) * 2.0**-53) * self.scale)

    def segment(self, chunk: str, skipped: Callable[[], bool] = bool) -> bytes:
        """The ids of one chunk, as unsigned 16-bit integers."""
        return self._ids(self._long(chunk, skipped))

    def _ids(self, at: list[int]) -> bytes:
        """The ids of pieces by rank; characters without a piece are spelt in bytes."""
        if min(at) >= 0:
            return array("H", [self.pieces.ids[r] for r in at]).tobytes()
        ids = array("H")
        for r in at:
            ids.extend([self.pieces.ids[r]] if r >= 0 else [self.pieces.byte[b] for b in chr(-1 - r).encode()])
        return ids.tobytes()

    def _ranks(self, chunk: str) -> list[int]:
        """The characters by the ranks of their pieces; those without one have numbers below 0, which no pair has."""
        rank = self.pieces.rank
        at = list(map(rank.get, chunk))
        return [-1 - ord(c) if r is None else r for r, c in zip(at, chunk)] if None in at else at

    def _short(self, chunk: str, skips: Iterable[int]) -> tuple[int, list[int], list[int]]:
        """The agenda as a list with a place for each pair of neighbours: how many candidates came up, the pieces, and
        which of the numbers ``skips`` (ascending) were skipped."""
        pair, at, n = self.pieces.pair.get, self._ranks(chunk), 0
        skips, done = iter(skips), []
        skip = next(skips, -1)
        agenda = [pair(a << 32 | b, NEVER) for a, b in zip(at, at[1:])]
        agenda.append(NEVER)  # after the last pair
        while (first := min(agenda)) != NEVER:
            i = agenda.index(first)
            if n == skip:
                agenda[i] = NEVER
                done.append(skip)
                skip = next(skips, -1)
                n += 1
                continue
            n += 1
            del agenda[i], at[i]
            at[i] = first
            if i + 1 < len(at):
                agenda[i] = pair(first << 32 | at[i + 1], NEVER)
            if i:
                agenda[i - 1] = pair(at[i - 1] << 32 | first, NEVER)
        return n, at, done

    def _long(self, chunk: str, skipped: Callable[[], bool]) -> list[int]:
        """The same order of candidates from a heap."""
        pair, at, n, gone = self.pieces.pair, self._ranks(chunk), len(chunk), None
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(pair[k], i, i + 1, a, b) for i, (a, b) in enumerate(zip(at, at[1:])) if (k := a << 32 | b) in pair]
        heapq.heapify(agenda)
        while agenda:
            made, i, j, a, b = heapq.heappop(agenda)
            if at[i] != a or at[j] != b or skipped():
                continue
            at[i], at[j] = made, gone
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := made << 32 | at[k]) in pair:
                    heapq.heappush(agenda, (pair[p], i, k, made, at[k]))
            if (k := before[i]) >= 0 and (p := at[k] << 32 | made) in pair:
                heapq.heappush(agenda, (pair[p], k, i, at[k], made))
        return [r for r in at if r is not gone]

    def _whole(self, chunk: str) -> tuple[int, bytes]:
        """How many candidates come up if none is skipped, and the ids. A chunk after one space is the library's to cut, if
        it spells the same characters by pieces alone: each merge then leaves one piece less."""
        if chunk[0] == MARK != chunk[1:2]:
            ids = self.pieces.library.encode(chunk[1:])
            if self.pieces.byte_ids.isdisjoint(ids) and b"".join(map(self.pieces.bytes.__getitem__, ids)) == chunk.replace(MARK, " ").encode():
                return len(chunk) - len(ids), array("H", ids).tobytes()
        return self._made(chunk, ())

    def _node(self, chunk: str) -> list:
        """What becomes of a chunk without skips, kept; long ones always count as skipped, as nothing is kept of them."""
        if len(chunk) > KEPT_CHARS:
            return [NEVER + 1, b"", {}]
        self.n_made += 1
        if (old := self.older.get(chunk)) is None:
            node = [*self._whole(chunk), {}]
        else:
            node = [*old[:2], {}]  # without what its skips came to, which would add up from one generation to the next
        self.known[chunk] = node
        return node

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What merges make of the ranks, or NEVER."""
        key, known = a << 32 | b, self.pieces.pair_keys
        at = np.searchsorted(known, key)
        return self.pieces.pair_made[np.where(known.take(at, mode="clip") == key, at, len(known))]

    def _together(self, chunks: list[str], skip: np.ndarray, x: np.ndarray) -> tuple[list[int], list[bytes], list[list[int]]]:
        """What ``_short`` gives for many chunks, one candidate of each at a time: how many came up, ids, skipped ones.
        ``skip`` are the first numbers that are skipped, ``x`` the draws of those."""
        sizes = np.array(list(map(len, chunks)))
        m, w = len(chunks), int(sizes.max())
        within = np.arange(w + 1) < sizes[:, None]
        at = np.full((m, w + 1), GONE)  # the last place of each row is none, so that it has no pair
        at[within] = self.pieces.of_char[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        agenda = np.full((m, w + 1), NEVER)
        agenda[:, :w] = self._pairs(at[:, :w], at[:, 1:])
        after, before = np.tile(np.arange(1, w + 2), (m, 1)), np.tile(np.arange(-1, w), (m, 1))
        n, skip, x, live, skipped = np.zeros(m, np.int64), skip.copy(), x.copy(), np.arange(m), [[] for _ in chunks]
        while True:
            i = agenda[live].argmin(1)
            made = agenda[live, i]
            on = made != NEVER
            live, i, made = live[on], i[on], made[on]
            if not len(live):
                break
            out = n[live] == skip[live]
            if out.any():
                rows = live[out]
                agenda[rows, i[out]] = NEVER
                for r, k in zip(rows.tolist(), skip[rows].tolist()):
                    skipped[r].append(k)
                x[rows], gaps = self._draw(x[rows], True)
                skip[rows] += 1 + gaps
            n[live] += 1
            rows, i, made = live[~out], i[~out], made[~out]
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            at[rows, i], at[rows, j], agenda[rows, j] = made, GONE, NEVER
            after[rows, i], before[rows, k] = k, i
            agenda[rows, i] = self._pairs(made, at[rows, k])
            agenda[rows, h] = self._pairs(at[rows, h], made)
        left = at != GONE
        flat, ends = at[left], np.cumsum(left.sum(1)).tolist()
        ids, odd = self.pieces.id_of[np.maximum(flat, 0)].tobytes(), ((at < 0) & left).any(1).tolist()
        starts = [0, *ends[:-1]]
        return n.tolist(), [self._ids(flat[a:b].tolist()) if o else ids[2 * a : 2 * b] for a, b, o in zip(starts, ends, odd)], skipped

    def _settle(self, waiting: list[tuple]) -> None:
        """Puts the ids of chunks with skips, (node, chunk, first, draw, out, place), in their places; they are kept as well."""
        waiting.sort(key=lambda one: len(one[1]))
        for at in range(0, len(waiting), TOGETHER):
            nodes, chunks, firsts, draws, outs, places = zip(*waiting[at : at + TOGETHER])
            for node, out, i, n, ids, skips in zip(nodes, outs, places, *self._together(chunks, np.array(firsts, np.int64), np.array(draws, np.uint64))):
                out[i] = ids
                for k in skips:
                    if k not in node[2]:
                        node[2][k] = [-1, b"", {}]
                    node = node[2][k]
                node[0], node[1] = n, ids
        self.n_made += len(waiting)
        waiting.clear()

    def _part(self, text: str, start: int, waiting: list[tuple]) -> list[bytes]:
        """The ids of the chunks of a part of a text, which have the keys from ``start``.

        All chunks are taken as if nothing were skipped; then those in which a skipped candidate comes up are replaced,
        at once if it is known what becomes of them, else by ``_settle``, which gets them in ``waiting``.
        """
        chunks = self.pieces.chunks(text)
        if self.n_made > KEPT_CHUNKS:
            self.known, self.older, self.n_made = {}, self.known, 0
        nodes = list(map(self.known.get, chunks))
        if None in nodes:
            nodes = [self.known.get(c) or self._node(c) if node is None else node for node, c in zip(nodes, chunks)]
        out = list(map(_KEPT_IDS, nodes))
        x, firsts = self._draw(np.uint64(start) + np.arange(len(chunks), dtype=np.uint64))
        skipped = np.flatnonzero(firsts < np.fromiter(map(_CANDIDATES, nodes), np.int64, len(nodes)))
        more, x = [x[skipped].tolist()], x[skipped]
        for _ in range(DRAWS - 1):
            x, gaps = self._draw(x, True)
            more.append(gaps.tolist())
        for i, first, draw, *gaps in zip(skipped.tolist(), firsts[skipped].tolist(), *more):
            node, skip, c = nodes[i], first, chunks[i]
            if node[0] > NEVER:
                out[i] = self.segment(c, self._in_turn(first, _mixed((start + i) & MASK)).__next__ if self.below else bool)
                continue
            level = 0
            while skip < node[0]:  # it comes up; nodes that no draw has ended at have -1
                if level == DRAWS - 1 or (after := node[2].get(skip)) is None:
                    node = None
                    break
                node = after
                skip += 1 + gaps[level]
                level += 1
            if node is None or node[0] < 0:
                waiting.append((nodes[i], c, first, draw, out, i))
            else:
                out[i] = node[1]
        return out

    def encode(self, text: str, turn: int = 0) -> bytes:
        """The ids of a text; ``turn`` is the document's hash, which decides on its draws with the seed."""
        return self.encode_all([text], [turn])[0]

    def encode_all(self, texts: Iterable[str], turns: Iterable[int]) -> list[bytes]:
        """The ids of several texts, each with its document's hash."""
        done, begun, waiting = [], [], []
        for text, turn in zip(texts, turns):
            begun.append(self._begun(text, turn, waiting) if text else [])
            if len(waiting) >= 2 * TOGETHER:
                self._settle(waiting)
                done += [self.pieces.mark.join(map(b"".join, parts)) for parts in begun]
                begun = []
        self._settle(waiting)
        return done + [self.pieces.mark.join(map(b"".join, parts)) for parts in begun]

    def _begun(self, text: str, turn: int, waiting: list[tuple]) -> list[list[bytes]]:
        """The ids of the chunks of each part of a text between marks, without those in ``waiting``."""
        out, at = [], _mixed((turn + self.seed * 0x9E3779B97F4A7C15) & MASK)
        for i, p in enumerate(text.split(MARK)):
            out.append(self._part((MARK if not i else "") + p.replace(" ", MARK), at, waiting))
            at = (at + len(out[-1])) & MASK
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.bytes.__getitem__, array("H", ids)))[1:].decode()


_SEGMENTERS: dict[tuple, Segmenter] = {}


def segmenter(path: str, seed: int = 1, dropout: float = 0.1, variants: int = 2) -> Segmenter:
    """One for each worker process and setting."""
    key = (path, seed, dropout, variants)
    if key not in _SEGMENTERS:
        gc.set_threshold(200_000)  # what is kept of chunks is a million objects without cycles
        _SEGMENTERS[key] = Segmenter(*key)
    return _SEGMENTERS[key]


def encode(docs: DataFrame, model_path: str, seed: int = 1, dropout: float = 0.1, variants: int = 2) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit) and n_tokens of each row of ``docs`` (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = segmenter(model_path, seed, dropout, variants).encode_all
        for batch in batches:
            turns = (xxhash.xxh3_64_intdigest(str(i), seed) for i in batch.column("doc_id").to_pylist())
            ids = list(map(_little, of(batch.column("text").to_pylist(), turns)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, "doc_id long, ids binary, n_tokens long")


def _little(ids: bytes) -> bytes:
    if sys.byteorder == "little":
        return ids
    swapped = array("H", ids)
    swapped.byteswap()
    return swapped.tobytes()


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text of each row of ``encoded`` (doc_id, ids)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = segmenter(model_path, 1, 0.0, 1).decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([of(_little(x)) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)
