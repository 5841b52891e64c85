"""Cost-balanced packing: documents into sequences of bounded length, with even attention cost and no padding.

A piece of n ids costs ``linear * n + quadratic * n * n``.  Within a block of about ``block_tokens`` ids, pieces go in
descending length to the sequence of lowest cost that still has room for the whole piece; a piece that fits nowhere
whole is cut and fills the sequences of lowest cost that have room.  A block has just as many full sequences as its ids
fill; what is left over makes one sequence for each power of two in its number of ids, and a sequence of such a length is
not padded.  Blocks are made of consecutive rows of a partition: one pass, no shuffle, and a task holds one block at a
time, so neither many partitions nor many blocks cost padding.

Rows: null text is empty text (the end id alone); null doc_ids and repeated doc_ids are packed row by row; an empty
table gives no piece; other columns are ignored.  Equal lengths go by the order of rows in the block, equal costs to the
first sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm import encoder as enc
from flowmill.llm import textbuf

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cost(n: float, linear: float = 1.0, quadratic: float = 1 / 1024) -> float:
    """Estimated cost of attending within a piece of n ids."""
    return linear * n + quadratic * n * n


def sizes(total: int, capacity: int) -> list[int]:
    """Lengths of the sequences for ``total`` ids: full ones, then the powers of two that make up the rest."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of pieces that cover all documents once and fill ``sizes`` of them."""
    out: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start
    full = 0
    for d, n in enumerate(lengths):
        at = 0
        while n - at >= capacity:
            out.append((d, at, capacity, full, 0))
            full, at = full + 1, at + capacity
        if n > at:
            rest.append((n - at, d, at))
    rest.sort(key=lambda x: (-x[0], x[1]))
    room = np.array(sizes(sum(x[0] for x in rest), capacity), np.int64)
    size, spent = room.copy(), np.zeros(len(room))
    short = size < capacity  # they take cuts only, or their low cost would draw whole pieces that leave no even rest

    def put(d: int, at: int, n: int, s: int) -> None:
        out.append((d, at, n, full + s, int(size[s] - room[s])))
        spent[s] += cost(n, linear, quadratic)
        room[s] -= n

    left: list[tuple[int, int, int]] = []
    for n, d, at in rest:
        fits = (room >= n) & ~short
        if fits.any():
            put(d, at, n, int(np.where(fits, spent, np.inf).argmin()))
        else:
            left.append((n, d, at))
    for n, d, at in left:
        while n:
            s = int(np.where(room > 0, spent, np.inf).argmin())
            take = min(n, int(room[s]))
            put(d, at, take, s)
            n, at = n - take, at + take
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 4096, block_tokens: int = 2 << 20, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text) with their ids as little-endian unsigned 32-bit numbers.

    ``sequence_id`` is the partition in the upper 31 bits and a number within the partition in the lower 32."""

    def run(batches):
        from pyspark import TaskContext

        encoder, base = enc.encoder(vocabulary), TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        lengths: list[int] = []
        held, used = 0, 0

        def flush():
            nonlocal names, parts, lengths, held, used
            ids = np.concatenate(parts).astype("<u4")
            first = np.concatenate([[0], np.cumsum(lengths)])
            pieces = pack(lengths, capacity, linear, quadratic)
            step = 4096
            for k in range(0, len(pieces), step):
                d, at, n, s, off = (np.array(x, np.int64) for x in zip(*pieces[k : k + step], strict=True))
                bound = np.concatenate([[0], np.cumsum(n)])
                take = np.repeat(first[d] + at - bound[:-1], n) + np.arange(bound[-1])
                binary = pa.Array.from_buffers(pa.binary(), len(d), [None, pa.py_buffer((bound * 4).astype(np.int32)), pa.py_buffer(ids[take])])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([names[x] for x in d.tolist()], pa.int64()), "start": at, "length": n, "doc_tokens": np.diff(first)[d], "sequence_id": base + used + s, "offset": off, "ids": binary}
                )
            used += max(p[3] for p in pieces) + 1
            names, parts, lengths, held = [], [], [], 0

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for k, ids, per in encoder.batches(batch.column(1)):
                ids, bound = enc.with_end(ids, per, end_id)
                names += doc_ids[k : k + len(per)]
                parts.append(ids)
                lengths += np.diff(bound).tolist()
                held += len(ids)
                if held >= block_tokens:
                    yield from flush()
        if names:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(textbuf.frugal(run), PIECE_SCHEMA)
