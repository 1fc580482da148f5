"""What several operators share: the shared folder, written cut points, joins on hot keys, chunked tokenizing."""

from __future__ import annotations

import ctypes
import json
import os
import re
import string
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # each a letter to any tokenizer, and its own composed form
WORD = rf"[{LETTERS}]+(?=[ \n!-&(-/:-@\[-`{{-~]|\Z)"  # up to white space or ASCII punctuation other than an apostrophe
BYTE_CHUNKS = rf"[ \n]*{WORD}|[ \n]*[^ \n]+|[ \n]+"
WORD_CHUNKS = rf"{WORD}|[^ \n]+"
CACHE_ENTRIES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used and whatever filter is pushed down."""
    return F.get(F.transform(F.array(value), use), 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without a setting one is made, but for local sessions only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, which survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and the path to ``forget`` when what follows is written."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Removes tables of ``stored`` that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup`` (one row a key), with hot keys dealt to several tasks.

    ``counts`` holds (key, n): rows of each key. A key over a thousandth of all rows is hot, so that at most 1,000
    keys are, whatever the input; that list alone is broadcast. A hot key's lookup row is repeated for each of its
    shares, and its rows go to a share by the hash of ``spread``.
    """
    step = max(64, total // 1000)
    hot = F.broadcast(counts.where(F.col("n") > step).select(F.col(key).alias("__key"), F.ceil(F.col("n") / step).cast("int").alias("__shares")))
    left = rows.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__shares")), F.lit(0)).cast("int")).drop("__key", "__shares")
    right = lookup.join(hot, F.col(key) == F.col("__key"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__shares") - 1, F.lit(0))))).drop("__key", "__shares")
    return left.join(right, [key, "__salt"], how).drop("__salt")


# The steps before the model, as types of normalizers and of pre-tokenizers, that keep a word whole.
_WORD_STEPS = ([[], ["ByteLevel"]], [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]])
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level models
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class ChunkEncoder:
    """Ids of whole texts from a tokenizer file, with the ids of each distinct chunk kept.

    Texts are cut only where the tokenizer's own pre-tokenizer always cuts: before a run of spaces and line feeds
    (``BYTE_CHUNKS``), or around it if the tokenizer drops white space (``WORD_CHUNKS``), and between a word and
    punctuation. With ``BYTE_CHUNKS`` a text with other white space is encoded whole, as runs of mixed white space are
    cut by what follows them. Strings of special tokens are ordinary text. A chunk that is one word goes to the
    tokenizer's model at once, if the steps before it (``_WORD_STEPS``) would do no more than map its bytes.
    Chunks are kept in two generations of ``CACHE_ENTRIES``, so that frequent ones outlive the rest.
    """

    def __init__(self, path: str, chunks: str | None, typecode: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.find = re.compile(chunks).findall if chunks else None
        self.odd = re.compile(r"[^\S \n]").search if chunks == BYTE_CHUNKS else None
        self.typecode = typecode
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.one_word, self.lower = self._words() if chunks else (None, False)

    def _words(self) -> tuple[Callable | None, bool]:
        """What tells chunks of one word, and whether they are lower-cased; nothing for steps that aren't known."""
        steps = json.loads(self.tokenizer.to_str())
        kind = [[x["type"] for x in (step or {}).get(name, [step] if step else [])] for step, name in ((steps["normalizer"], "normalizers"), (steps["pre_tokenizer"], "pretokenizers"))]
        if any(set(x["content"]) <= set(string.ascii_letters) for x in steps["added_tokens"]) or kind not in _WORD_STEPS:
            return None, False
        split = [x["pattern"] for x in (steps["pre_tokenizer"].get("pretokenizers") or []) if x["type"] == "Split"]
        if split and "[\\p{L}]+" not in split[0].get("Regex", "").split("|"):
            return None, False
        space = "" if split else " ?"
        return re.compile(f"{space}[{LETTERS}]+").fullmatch, "Lowercase" in kind[0]

    def whole(self, texts: Iterable[str]) -> list[bytes]:
        return [array(self.typecode, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _word(self, chunk: str) -> bytes:
        chunk = chunk.lower() if self.lower else chunk
        mapped = chunk.replace(" ", "Ġ") if chunk.isascii() else chunk.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array(self.typecode, [x.id for x in self.model.tokenize(mapped)]).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        """Ids of chunks that aren't known."""
        if len(self.known) > CACHE_ENTRIES:
            self.known, self.older = {}, self.known
        rest = []
        for c in chunks:
            if c in self.older:
                self.known[c] = self.older[c]
            elif self.one_word and self.one_word(c):
                self.known[c] = self._word(c)
            else:
                rest.append(c)
        if rest:
            self.known.update(zip(rest, self.whole(rest)))

    def encode(self, text: str) -> bytes:
        if self.find is None or (self.odd and self.odd(text)):
            return self.whole([text])[0]
        chunks = self.find(text)
        ids = list(map(self.known.get, chunks))
        try:
            return b"".join(ids)
        except TypeError:  # most texts have some chunk of their own: only those are looked at again
            missing = [i for i, x in enumerate(ids) if x is None]
            self._learn({chunks[i] for i in missing})
            for i in missing:
                ids[i] = self.known[chunks[i]]
            return b"".join(ids)


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, chunks: str | None, typecode: str) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer."""
    key = (path, chunks, typecode)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]


def forget_encoders() -> None:
    """Encoders of this worker process go, with the chunks that they know."""
    _ENCODERS.clear()


def give_back() -> None:
    """Memory that this worker process holds for later use goes back to the system: workers outlive their tasks, and the
    executor's memory is theirs together."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # another C library than glibc


def lean(each: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """``each``, for mapInArrow: before it, encoders of earlier steps go, unless it ``encodes`` itself; after it, unused memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget_encoders()
        try:
            yield from each(batches)
        finally:
            give_back()

    return run
