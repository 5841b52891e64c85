"""Whole batches of UTF-8 text as numpy buffers: word bounds, exact word keys and a vectorised word memo."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

PAD = 32
GROUP_BYTES = 1 << 20
#: Words up to this many bytes have an exact key of three 64-bit numbers and a length.
KEY_BYTES = 24
MAKE = 8192  # new slices at a time
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_U = np.uint64


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches that gives its free memory back to the system at its end: workers wait between tasks, and
    what they then hold counts beside that of the JVM."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets from 0) of runs of texts of about ``size`` bytes; one long text is one run."""
    raw, offsets = buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        lo, hi = int(offsets[first]), int(offsets[last])
        yield first, last, raw[lo:hi], offsets[first : last + 1] - lo
        first = last


def padded(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + PAD, np.uint8)
    out[: len(buf)] = buf
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes, cut where a text ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = offsets[:-1]
    cut = cut[(cut < n)]
    begin[cut] = inside[cut]
    starts = np.flatnonzero(begin)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    ends = offsets[1:]
    ends = ends[ends > 0] - 1
    stop[ends] = inside[ends]
    return starts, np.flatnonzero(stop) + 1


def low_bytes(n: int) -> np.uint64:
    return _MASK[n]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64, in place on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def keys(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes 0-8, 8-16 and 16-24 of each word as numbers; ``buf`` is padded."""
    wide = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    a = wide[starts] & _MASK[np.minimum(lens, 8)]
    b, c = np.zeros(len(starts), _U), np.zeros(len(starts), _U)
    long = np.flatnonzero(lens > 8)
    if len(long):
        b[long] = wide[starts[long] + 8] & _MASK[np.minimum(lens[long] - 8, 8)]
        long = long[lens[long] > 16]
        c[long] = wide[starts[long] + 16] & _MASK[np.minimum(lens[long] - 16, 8)]
    return a, b, c


def key_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray, lens: np.ndarray) -> np.ndarray:
    h = mix(a + lens.astype(_U) * _U(0x9E3779B97F4A7C15))
    long = np.flatnonzero(lens > 8)
    if len(long):
        h[long] = mix(mix(h[long] + b[long]) + c[long])
    return h


def hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of padded ``buf``."""
    h = key_hash(*keys(buf, starts, np.minimum(lens, KEY_BYTES)), lens)
    for j in np.flatnonzero(lens > KEY_BYTES).tolist():
        h[j] = int.from_bytes(hashlib.blake2b(buf[starts[j] : starts[j] + lens[j]].tobytes(), digest_size=8).digest(), "little")
    return h


class WordMemo:
    """Byte slice -> dense index, exact, for millions of slices a second.

    ``make(list of bytes)`` is told the slices not seen since the last reset, in the order of their indexes and some at a
    time; what it makes of them it keeps itself, and drops when ``generation`` has changed.
    Slices of up to KEY_BYTES bytes are compared by all their bytes and length in an open-addressing table; longer ones
    go through a dict.  ``limit`` bounds the memory: past it the memo starts afresh.
    """

    def __init__(self, make: Callable[[list[bytes]], None], limit: int = 500_000):
        self.make, self.limit = make, limit
        self.bits = (2 * limit - 1).bit_length()
        self.reset()

    def reset(self) -> None:
        n = 1 << self.bits
        self.k = [np.zeros(n, _U) for _ in range(3)]
        self.len = np.zeros(n, np.int16)
        self.at = np.full(n, -1, np.int32)
        self.n = 0
        self.long: dict[bytes, int] = {}
        self.generation = getattr(self, "generation", -1) + 1

    def room(self) -> None:
        """Call between batches: indexes of earlier batches end here if the memo is full."""
        if self.n > self.limit:
            self.reset()

    def _add(self, words: list[bytes]) -> None:
        for k in range(0, len(words), MAKE):
            self.make(words[k : k + MAKE])
        self.n += len(words)

    def _find(self, a, b, c, lens, h):
        mask = (1 << self.bits) - 1
        slot = (h & _U(mask)).astype(np.int64)
        out = np.full(len(a), -1, np.int32)
        todo = np.arange(len(a))
        while len(todo):
            s = slot[todo]
            at = self.at[s]
            same = (at >= 0) & (self.k[0][s] == a[todo]) & (self.len[s] == lens[todo])
            long = same & (lens[todo] > 8)
            if long.any():
                same[long] &= (self.k[1][s[long]] == b[todo[long]]) & (self.k[2][s[long]] == c[todo[long]])
            out[todo[same]] = at[same]
            todo = todo[~same & (at >= 0)]
            slot[todo] = (slot[todo] + 1) & mask
        return out, slot

    def index(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Index of each slice of the padded ``buf``."""
        out = np.full(len(starts), -1, np.int32)
        short = np.flatnonzero(lens <= KEY_BYTES)
        a, b, c = keys(buf, starts[short], lens[short])
        ln = lens[short]
        h = key_hash(a, b, c, ln)
        todo = np.arange(len(short))
        while len(todo):
            if self.n >= (1 << self.bits) * 3 // 4:
                self._grow()
            found, _ = self._find(a[todo], b[todo], c[todo], ln[todo], h[todo])
            out[short[todo]] = found
            todo = todo[found < 0]
            if len(todo):
                _, first = np.unique(h[todo], return_index=True)
                new = todo[first].tolist()
                for k, j in enumerate(new, self.n):
                    self._put(int(h[j]), a[j], b[j], c[j], int(ln[j]), k)
                at = starts[short[new]]
                self._add([buf[s : s + n].tobytes() for s, n in zip(at.tolist(), ln[new].tolist(), strict=True)])
        fresh: list[bytes] = []
        for j in np.flatnonzero(lens > KEY_BYTES).tolist():
            word = buf[int(starts[j]) : int(starts[j] + lens[j])].tobytes()
            k = self.long.get(word)
            if k is None:
                k = self.long[word] = self.n + len(fresh)
                fresh.append(word)
            out[j] = k
        if fresh:
            self._add(fresh)
        return out

    def _put(self, h: int, a, b, c, ln: int, k: int) -> None:
        mask = (1 << self.bits) - 1
        s = h & mask
        while self.at[s] >= 0:
            s = (s + 1) & mask
        self.k[0][s], self.k[1][s], self.k[2][s], self.len[s], self.at[s] = a, b, c, ln, k

    def _grow(self) -> None:
        old, full = (self.k, self.len, self.at), np.flatnonzero(self.at >= 0)
        self.bits += 1
        n = 1 << self.bits
        self.k, self.len, self.at = [np.zeros(n, _U) for _ in range(3)], np.zeros(n, np.int16), np.full(n, -1, np.int32)
        a, b, c = (k[full] for k in old[0])
        for x in zip(key_hash(a, b, c, old[1][full].astype(np.int64)).tolist(), a, b, c, old[1][full].tolist(), old[2][full].tolist(), strict=True):
            self._put(*x)
