"""Token files: the ids of whole documents one after the other, their bounds in Elias-Fano code.

A shard is ``MAGIC | ids | footer | footer length | MAGIC``; ids are little-endian unsigned 16- or 32-bit numbers and
the footer holds two Elias-Fano codes: of the n+1 bounds (about ``2 + log2(ids / documents)`` bits a document) and of the
ascending doc_ids.  Neither is ever a 64-bit table: a stored directory of select samples leads to any entry, and readers
select the bounds of the range that they read.

Rows: null text is empty text (one id, the end id); a null doc_id sorts first and comes back null; equal doc_ids keep
one entry each, in the order of their text's hash; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowmill.llm import encoder as enc
from flowmill.llm import storage, textbuf

MAGIC = b"FMTOKEN2"
#: One select sample every so many entries.
SELECT_STEP = 256
READ_IDS = 1 << 20
_U = np.uint64


class EliasFano:
    """A non-decreasing sequence of n unsigned 64-bit numbers: ``low`` bits verbatim, the rest in unary; ``samples`` holds
    the place of every SELECT_STEP-th one among the unary bits."""

    def __init__(self, n: int, low: int, low_bits: np.ndarray, high_bits: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.low_bits, self.high_bits, self.samples = n, low, low_bits, high_bits, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(_U)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts, step = np.arange(low, dtype=_U), 1 << 13  # a step's bits fill whole bytes
        lows = [np.packbits(((values[k : k + step, None] >> shifts) & _U(1)).astype(np.uint8), bitorder="little") for k in range(0, n, step)]
        places = (values >> _U(low)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> low) + n + 1, np.uint8)
        high[places] = 1
        return cls(n, low, np.concatenate(lows) if lows else np.zeros(0, np.uint8), np.packbits(high, bitorder="little"), places[::SELECT_STEP].astype("<i8"))

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low or first >= last:
            return np.zeros(last - first, _U)
        a, b = first * self.low, last * self.low
        bits = np.unpackbits(self.low_bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return (bits.reshape(-1, self.low).astype(_U) << np.arange(self.low, dtype=_U)).sum(1, dtype=_U)

    def slice(self, first: int, last: int) -> np.ndarray:
        """Numbers first to last (not included), from the unary bits between the samples around them alone."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, _U)
        block, after = first // SELECT_STEP, -(-last // SELECT_STEP)
        begin = int(self.samples[block]) // 8
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high_bits)
        ones = np.flatnonzero(np.unpackbits(self.high_bits[begin:end], bitorder="little")) + 8 * begin
        # ones of the first byte that come before the sample belong to entries before the block
        ones = ones[np.searchsorted(ones, self.samples[block]) + first - block * SELECT_STEP :][: last - first]
        return ((ones - np.arange(first, last)).astype(_U) << _U(self.low)) | self._low(first, last)

    def select(self, i: int) -> int:
        """The i-th number (from 0) without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def find(self, value: int) -> int:
        """How many numbers are at most ``value``, by binary search over select."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) <= value else (lo, mid)
        return lo

    def decode(self) -> np.ndarray:
        return self.slice(0, self.n)

    def pack(self) -> bytes:
        head = struct.pack("<QBQQQ", self.n, self.low, len(self.low_bits), len(self.high_bits), len(self.samples))
        return head + self.low_bits.tobytes() + self.high_bits.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> EliasFano:
        at = struct.calcsize("<QBQQQ")
        n, low, a, b, c = struct.unpack("<QBQQQ", raw[:at])
        return cls(n, low, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<i8", c, at + a + b))


def write_shard(out, documents: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]], width: int) -> tuple[int, int]:
    """documents: (doc_ids, null first then ascending, ids, n+1 bounds) a batch.  The numbers of documents and ids."""
    names, bounds, total, nulls = [], [np.zeros(1, np.int64)], 0, 0
    out.write(MAGIC)
    for doc_ids, ids, bound in documents:
        out.write(ids.astype(f"<u{width}").tobytes())
        named = [x for x in doc_ids if x is not None]
        nulls += len(doc_ids) - len(named)
        names.append(np.array(named, np.int64))
        bounds.append(total + np.asarray(bound[1:], np.int64))
        total += int(bound[-1])
    named = np.concatenate(names) if names else np.zeros(0, np.int64)
    least = int(named[0]) if len(named) else 0
    ids = EliasFano.encode(named.view(_U) - np.array([least], np.int64).view(_U)).pack()
    footer = struct.pack("<BQQqQ", width, nulls, total, least, len(ids)) + ids + EliasFano.encode(np.concatenate(bounds)).pack()
    out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
    return nulls + len(named), total


class Shard:
    """Random access to one shard through any seekable file."""

    def __init__(self, f, size: int):
        f.seek(size - 16)
        tail = f.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<Q", tail[:8])
        f.seek(size - 16 - n)
        footer = f.read(n)
        at = struct.calcsize("<BQQqQ")
        self.f = f
        self.width, self.nulls, self.n_ids, self.least, n = struct.unpack("<BQQqQ", footer[:at])
        self.names, self.bounds = EliasFano.unpack(footer[at : at + n]), EliasFano.unpack(footer[at + n :])
        self.n_docs = self.nulls + self.names.n

    def ids(self, first: int, last: int) -> np.ndarray:
        self.f.seek(len(MAGIC) + first * self.width)
        return np.frombuffer(self.f.read((last - first) * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        a, b = self.bounds.slice(k, k + 2).tolist()
        return self.ids(a, b)

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        some = self.names.slice(max(0, first - self.nulls), max(0, last - self.nulls)) + np.array([self.least], np.int64).view(_U)
        return [None] * (min(last, self.nulls) - min(first, self.nulls)) + some.view(np.int64).tolist()

    def place(self, doc_id: int) -> int | None:
        """The last document of that id, by its code alone."""
        k = self.names.find(doc_id - self.least) - 1 if doc_id >= self.least else -1
        return self.nulls + k if k >= 0 and self.names.select(k) == doc_id - self.least else None


SHARD_SCHEMA = "shard int, path string, n_docs long, n_ids long"
ENTRY_SCHEMA = "shard int, doc_id long, start long, n_tokens long, ids binary"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, width: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards under ``folder`` in ascending doc_id order; the table of shards.  Ids take
    2 bytes where the vocabulary allows it, else 4, or ``width``.

    Shards are ranges of doc_id, ties spread by the text's hash.  A task that runs again writes a file of its own and
    only the file named in the table of shards counts.
    """

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        first = next(batches, None)
        if first is None:
            return
        fs, root = storage.filesystem(folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/{shard:06d}-{uuid.uuid4().hex[:8]}.tok"
        encoder = enc.encoder(vocabulary)

        def documents():
            batch = first
            while batch is not None:
                names = batch.column(0).to_pylist()
                for k, ids, per in encoder.batches(batch.column(1)):
                    ids, bound = enc.with_end(ids, per, end_id)
                    yield names[k : k + len(per)], ids, bound
                batch = next(batches, None)

        with fs.open_output_stream(path) as out:
            n_docs, n_ids = write_shard(out, documents(), width or (2 if encoder.kind is np.uint16 and end_id < 1 << 16 else 4))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [folder[: len(folder) - len(root)] + path if folder.endswith(root) else path], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    shards = ordered.mapInArrow(textbuf.frugal(write), SHARD_SCHEMA)
    return storage.materialize(shards, "tokens-shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Every document of the shards with its ids (little-endian unsigned 32-bit) and the ids before it in all shards."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = shards.select("shard", "path", F.coalesce(before, F.lit(0)).alias("base"))
    tasks = max(1, shards.count())

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = storage.filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    shard = Shard(f, f.size())
                    k, at = 0, 0
                    while k < shard.n_docs:  # documents of about READ_IDS ids, or one long one
                        last = min(shard.n_docs, max(k + 1, shard.bounds.find(at + READ_IDS) - 1))
                        bounds = shard.bounds.slice(k, last + 1).astype(np.int64)
                        ids = shard.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                        cut = bounds - bounds[0]
                        binary = pa.Array.from_buffers(pa.binary(), last - k, [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_pydict(
                            {
                                "shard": pa.array([row["shard"]] * (last - k), pa.int32()),
                                "doc_id": pa.array(shard.doc_ids(k, last), pa.int64()),
                                "start": bounds[:-1] + row["base"],
                                "n_tokens": np.diff(cut),
                                "ids": binary,
                            }
                        )
                        k, at = last, int(bounds[-1])

    return listed.repartition(tasks).mapInArrow(textbuf.frugal(read), ENTRY_SCHEMA)


def token_ids(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write, then read back: (shard, doc_id, start, n_tokens, ids)."""
    return read_tokens(write_tokens(docs, storage.shared_dir(spark, "tokens"), vocabulary, end_id))


def crc32(raw: bytes) -> int:
    return zlib.crc32(raw)
