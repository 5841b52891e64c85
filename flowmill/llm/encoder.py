"""Whole texts to ids by the tokenizers library, a few times faster than text by text.

Both vocabularies cut a text into pre-tokens before any merge, and no merge crosses a cut, so the ids of a text are
those of its pre-tokens in turn.  The cuts are found for a whole batch at once with numpy; each distinct pre-token goes
through the library's model once and is then remembered.  Texts with characters beyond Latin Extended-A (or with
white space that is not ASCII), or with the string of an added token, go to the library whole, so the result always
equals ``Tokenizer.encode(text, add_special_tokens=False)`` of the file as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from flowmill.llm import textbuf

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The apostrophe endings that both vocabularies keep as pre-tokens of their own.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of an ASCII byte, class of a two-byte character, lower case of the first and of the second kind."""

    def kind(ch: str) -> int:
        return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(ch)[0], SPACE if ch in "\t\n\v\f\r " else OTHER)

    one = np.array([kind(chr(x)) for x in range(128)] + [OTHER] * 128, np.uint8)
    two, low2 = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint16)
    for x in range(0x80, 0x180):
        raw = chr(x).encode()
        two[raw[0] << 8 | raw[1]] = kind(chr(x))
        small = chr(x).lower().encode()
        if len(small) == 2:
            low2[raw[0] << 8 | raw[1]] = small[0] << 8 | small[1]
    low1 = np.arange(256, dtype=np.uint8)
    low1[65:91] += 32
    return one, two, low1, low2


def plain(buf: np.ndarray, offsets: np.ndarray, lower: bool) -> np.ndarray:
    """Which texts the vectorised cuts hold for."""
    odd = buf >= 0xC6
    lead = np.flatnonzero(buf == 0xC2)
    if len(lead):
        odd[lead[np.isin(buf[lead + 1], (0x85, 0xA0))]] = True
    if lower:  # U+0130 becomes two characters
        lead = np.flatnonzero(buf == 0xC4)
        odd[lead[buf[lead + 1] == 0xB0]] = True
    total = np.concatenate([[0], np.cumsum(odd)])
    return total[offsets[1:]] == total[offsets[:-1]]


def classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to; ``buf`` is padded."""
    one, two, _, _ = _tables()
    out = one[buf]
    lead = np.flatnonzero((buf >= 0xC2) & (buf <= 0xC5))
    if len(lead):
        out[lead] = out[lead + 1] = two[buf[lead].astype(np.uint16) << 8 | buf[lead + 1]]
    return out


def lowered(buf: np.ndarray) -> np.ndarray:
    _, _, low1, low2 = _tables()
    out = low1[buf]
    lead = np.flatnonzero((buf >= 0xC2) & (buf <= 0xC5))
    if len(lead):
        code = low2[buf[lead].astype(np.uint16) << 8 | buf[lead + 1]]
        out[lead], out[lead + 1] = code >> 8, code & 255
    return out


def cuts(buf: np.ndarray, offsets: np.ndarray, joined: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pre-tokens of padded ``buf``.  joined: a space goes with what follows it and white
    space is kept (byte-level vocabulary); else white space is dropped and each number character stands alone."""
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = classes(buf)
    edge = np.zeros(n + textbuf.PAD, bool)
    edge[offsets] = True
    start = edge.copy()
    start[1:n] |= cls[1:n] != cls[: n - 1]
    # an apostrophe ending stays within its text: the cut after the apostrophe must be a class change, not a text's end
    apostrophe = np.flatnonzero((buf[:n] == 39) & start[:n])
    if joined:
        space = cls == SPACE
        space[n:] = False
        last = np.flatnonzero(space[:n] & ~space[1 : n + 1] & ~edge[1 : n + 1])
        start[last] = True
        start[last[buf[last] == 32] + 1] = False
        apostrophe = apostrophe[start[apostrophe]]
    else:
        number = np.flatnonzero((cls[:n] == NUMBER) & ((buf[:n] & 0xC0) != 0x80))
        start[number] = True
    at = apostrophe[(cls[apostrophe + 1] == LETTER) & ~edge[apostrophe + 1]]
    if len(at):
        first, second = buf[at + 1], buf[at + 2]
        one = np.isin(first, np.frombuffer(ENDINGS_1.encode(), np.uint8))
        two = np.zeros(len(at), bool)
        for x in ENDINGS_2:
            two |= (first == ord(x[0])) & (second == ord(x[1]))
        two &= ~edge[at + 2]
        for flag, size in ((one, 1), (two & ~one, 2)):
            start[at[flag] + 1] = False
            start[at[flag] + 1 + size] = True
    begin = np.flatnonzero(start[:n])
    lens = np.diff(np.append(begin, n))
    if not joined:
        keep = cls[begin] != SPACE
        begin, lens = begin[keep], lens[keep]
    return begin, lens


class Encoder:
    """ids of whole texts.  joined: as in ``cuts``; a vocabulary without it lower-cases."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode().lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.joined = self.tok.normalizer is None
        self.model = self.tok.model
        marks = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        names = dict(zip(marks, map(chr, marks), strict=True))
        for x in range(256):
            names.setdefault(x, chr(256 + len(names) - len(marks)))
        self.names = names
        self.kind = np.uint16 if max(self.tok.get_vocab().values(), default=0) < 1 << 16 else np.uint32
        self.memo = textbuf.WordMemo(self._remember, limit)
        self._generation, self._seen, self._used = 0, 0, 0
        self._first, self._count, self._pool = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, self.kind)

    def _remember(self, words: list[bytes]) -> None:
        """The ids of pre-tokens, behind those of the words before them."""
        if self._generation != self.memo.generation:
            self._generation, self._seen, self._used = self.memo.generation, 0, 0
        new = [[t.id for t in self.model.tokenize(w.decode("latin-1").translate(self.names))] for w in words]
        count = np.fromiter(map(len, new), np.int32, len(new))
        flat = np.fromiter((x for v in new for x in v), self.kind, int(count.sum()))
        k = self._seen + len(new)
        while len(self._first) < k:
            self._first, self._count = np.resize(self._first, 2 * len(self._first)), np.resize(self._count, 2 * len(self._count))
        while len(self._pool) < self._used + len(flat):
            self._pool = np.resize(self._pool, 2 * len(self._pool))
        self._count[self._seen : k] = count
        self._first[self._seen : k] = self._used + np.cumsum(count) - count
        self._pool[self._used : self._used + len(flat)] = flat
        self._seen, self._used = k, self._used + len(flat)

    def vectorised(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts need not go to the library whole."""
        ok = plain(raw, offsets, not self.joined)
        low = raw.tobytes().lower()
        for token in self.added:
            at = low.find(token)
            while at >= 0:  # a find over a text's end only sends one text more to the library
                ok[np.searchsorted(offsets, at, side="right") - 1] = False
                at = low.find(token, at + 1)
        return ok

    def counts(self, buf: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Memo index and number of ids of each pre-token of padded ``buf``."""
        index = self.memo.index(buf, begin, lens)
        return index, self._count[index].astype(np.int64)

    def batches(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(index of the first text, ids of some texts one after the other, number of ids of each)."""
        for first, last, raw, offsets in textbuf.groups(column):
            self.memo.room()
            ok = self.vectorised(raw, offsets)
            turns = [0, *(np.flatnonzero(ok[1:] != ok[:-1]) + 1).tolist(), last - first]
            for a, b in zip(turns[:-1], turns[1:], strict=True):
                if ok[a]:
                    ids, per = self._ids(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    yield first + a, ids, per
                    continue
                for k in range(a, b):
                    ids = np.array(self.tok.encode(raw[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids, self.kind)
                    yield first + k, ids, np.array([len(ids)])

    def lengths(self, column: pa.Array) -> np.ndarray:
        """Number of ids of every text."""
        out = np.zeros(len(column), np.int64)
        for first, last, raw, offsets in textbuf.groups(column):
            self.memo.room()
            ok = self.vectorised(raw, offsets)
            buf = textbuf.padded(raw) if self.joined else lowered(textbuf.padded(raw))
            begin, lens = cuts(buf, offsets, self.joined)
            total = np.concatenate([[0], np.cumsum(self.counts(buf, begin, lens)[1])])
            out[first:last] = np.diff(total[np.searchsorted(begin, offsets)])
            for k in np.flatnonzero(~ok).tolist():
                out[first + k] = len(self.tok.encode(raw[offsets[k] : offsets[k + 1]].tobytes().decode(), add_special_tokens=False).ids)
        return out

    def _ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        buf = textbuf.padded(raw)
        if not self.joined:
            buf = lowered(buf)
        begin, lens = cuts(buf, offsets, self.joined)
        index, count = self.counts(buf, begin, lens)
        total = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(self._first[index] - total[:-1], count) + np.arange(total[-1])
        bound = total[np.searchsorted(begin, offsets)]
        return self._pool[take], np.diff(bound)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder of a vocabulary file in each Python worker."""
    return Encoder(path)


def offsets_with_end(per: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(per + 1)])


def with_end(ids: np.ndarray, per: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with ``end_id`` behind each text, and n+1 bounds."""
    bound = offsets_with_end(per)
    out = np.empty(int(bound[-1]), np.uint32)
    out[bound[1:] - 1] = end_id
    keep = np.ones(len(out), bool)
    keep[bound[1:] - 1] = False
    out[keep] = ids
    return out, bound
