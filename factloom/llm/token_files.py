"""Token-ID output: Arrow stream files of fixed-size-list batches, read back by position without copies.

A shard is two stream files: ``shard-N-ATTEMPT.tokens.arrows`` with ``tokens`` and ``mask`` (both fixed-size lists of
``sequence_length``; the mask has a bit for each token, set where it is real), and ``shard-N-ATTEMPT.docs.arrows`` with each document's id, start in
the shard and number of tokens. All batches of a tokens file but the last have equal sizes, so a sequence's place
in the file is computed, and its values are views of the mapped file.

Documents are dealt to shards by ranges of (doc_id, hash of the text), so shards in order hold documents in
ascending doc_id; null ids come first and rows of one id go by the hash. Null texts are empty and hold the end id
alone; very long ones run over as many sequences as they need. An empty table gives no shard. Repeated rows are written
as often as they occur. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BYTE_CHUNKS, encoder, scratch, text_of, written

MANIFEST = "shard int, path string, n_tokens long, n_sequences long, n_documents long"


def _schema(length: int, value: pa.DataType) -> pa.Schema:
    return pa.schema([("tokens", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


class ShardWriter:
    """Writes one shard, under names of its own: a task that runs again writes another, and the manifest has the one
    whose task finished, so that nothing is renamed or replaced."""

    def __init__(self, base: str, length: int, rows: int, dtype: str):
        self.fs, path = _place(base)
        names = (f"{path}.tokens.arrows", f"{path}.docs.arrows")
        self.length, self.room, self.dtype = length, rows * length, np.dtype(dtype)
        self.schema = _schema(length, pa.from_numpy_dtype(self.dtype))
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.files = [self.fs.open_output_stream(p) for p in names]
        self.tokens, self.docs = ipc.new_stream(self.files[0], self.schema), ipc.new_stream(self.files[1], self.docs_schema)
        self.held, self.n_held, self.n_tokens, self.n_docs = [], 0, 0, 0

    def add(self, ids: list, tokens: list[bytes]) -> None:
        sizes = np.array([len(t) // self.dtype.itemsize for t in tokens], np.int64)
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        self.docs.write_batch(pa.record_batch([pa.array(ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.docs_schema))
        self.n_docs += len(ids)
        self.n_tokens += int(sizes.sum())
        self.held += tokens
        self.n_held += int(sizes.sum())
        if self.n_held >= self.room:
            values = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(values) // self.room * self.room
            for at in range(0, whole, self.room):
                self._batch(values[at : at + self.room], self.room)
            self.held, self.n_held = [values[whole:].tobytes()], len(values) - whole

    def _batch(self, values: np.ndarray, real: int) -> None:
        mask = np.arange(len(values)) < real
        self.tokens.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)], schema=self.schema))

    def close(self) -> tuple[int, int, int]:
        if self.n_held:
            values = np.frombuffer(b"".join(self.held), self.dtype)
            self._batch(np.concatenate([values, np.zeros(-len(values) % self.length, self.dtype)]), len(values))
        for x in (self.tokens, self.docs, *self.files):
            x.close()
        return self.n_tokens, -(-self.n_tokens // self.length), self.n_docs


class Shard:
    """A tokens file opened by mapping it: ``sequence(i)`` and ``mask_bits(i)`` (Arrow booleans) are views of the file;
    ``mask(i)`` is the mask unpacked for numpy, which has no arrays of bits."""

    def __init__(self, path: str):
        fs, place = _place(path)
        self.file = pa.memory_map(place) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(place)
        self.schema = ipc.open_stream(self.file).schema
        self.length = self.schema.field("tokens").type.list_size
        self.data = self.file
        self.file.seek(0)
        ipc.read_schema(self.file)
        self.first, self.size = self.file.tell(), self.file.size()  # of the first batch, of the file
        self.step, self.rows = 0, 1
        if (batch := self._at(self.first)) is not None:
            self.step, self.rows = self.file.tell() - self.first, len(batch)

    def _at(self, offset: int) -> pa.RecordBatch | None:
        if offset + 8 > self.size:  # beyond a last batch of fewer rows
            return None
        self.file.seek(offset)
        head = self.file.read(8)
        if struct.unpack("<Ii", head)[1] == 0:
            return None
        self.file.seek(offset)
        return ipc.read_record_batch(ipc.read_message(self.file), self.schema)

    def batch(self, k: int) -> pa.RecordBatch | None:
        return self._at(self.first + k * self.step) if self.step else None

    def _row(self, column: str, i: int) -> pa.Array:
        batch = self.batch(i // self.rows) if i >= 0 else None
        if batch is None or i % self.rows >= len(batch):
            raise IndexError(i)
        values = batch.column(column).values
        at = (batch.column(column).offset + i % self.rows) * self.length
        return values.slice(at, self.length)

    def sequence(self, i: int) -> np.ndarray:
        return self._row("tokens", i).to_numpy(zero_copy_only=True)

    def mask_bits(self, i: int) -> pa.BooleanArray:
        return self._row("mask", i)

    def mask(self, i: int) -> np.ndarray:
        return self.mask_bits(i).to_numpy(zero_copy_only=False)

    def batches(self) -> Iterator[np.ndarray]:
        """The tokens of each batch, one after another."""
        k = 0
        while (b := self.batch(k)) is not None:
            yield b.column("tokens").flatten().to_numpy(zero_copy_only=True)
            k += 1


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, sequence_length: int = 2048, batch_rows: int = 64, dtype: str = "uint16", chunks: str | None = BYTE_CHUNKS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shards below ``path``; returns the manifest, a row for each shard.

    One exchange: the texts by range of doc_id. Tokens are written by the task that makes them, a batch at a time.
    """
    end = np.array([end_id], dtype).tobytes()
    typecode = {"uint16": "H", "uint32": "I"}[dtype]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, number = encoder(tokenizer_path, chunks, typecode).encode, None, TaskContext.get().partitionId()
        base = f"{path}/shard-{number:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows:
                writer = writer or ShardWriter(base, sequence_length, batch_rows, dtype)
                writer.add(batch.column("doc_id").to_pylist(), [encode(t) + end for t in batch.column("text").to_pylist()])
        if writer:
            n_tokens, n_sequences, n_docs = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([number], pa.int32()), "path": [base], "n_tokens": [n_tokens], "n_sequences": [n_sequences], "n_documents": [n_docs]})

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    made = written(dealt.mapInArrow(shard, MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, not for each document
    return made.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents from the shards of a manifest: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit)."""

    def docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            fs, place = _place(f"{row['path']}.docs.arrows")
            tokens = Shard(f"{row['path']}.tokens.arrows").batches()
            held, at = np.empty(0, np.uint32), 0
            with fs.open_input_stream(place) as f:
                for index in ipc.open_stream(f):
                    ids, starts, sizes = (index.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                    done = 0
                    while done < len(sizes):  # no more than some 4 M tokens, or one document, at once
                        upto = max(done + 1, int(np.searchsorted(starts + sizes, starts[done] + 4_000_000, "right")))
                        parts, have, end = [held], at + len(held), int(starts[upto - 1] + sizes[upto - 1])
                        while have < end:
                            parts.append(next(tokens).astype("<u4"))
                            have += len(parts[-1])
                        flat = np.concatenate(parts)
                        out = [flat[s - at : s - at + n].tobytes() for s, n in zip(starts[done:upto].tolist(), sizes[done:upto].tolist())]
                        held, at = flat[end - at :], end
                        yield pa.RecordBatch.from_pydict({"doc_id": index.column(0)[done:upto], "start": pa.array(starts[done:upto] + row["first_token"]), "n_tokens": pa.array(sizes[done:upto]), "ids": pa.array(out, pa.binary())})
                        done = upto

    n = max(1, manifest.count())
    return manifest.select("path", "first_token").repartition(n).mapInArrow(docs, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)


def token_path(spark: SparkSession) -> str:
    return scratch(spark, "tokens")
