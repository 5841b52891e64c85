"""Edit-aware token counts: each document keeps a segment tree over chunks of its pre-tokens; edits re-encode only there.

A chunk ends where the vocabulary cuts whatever stands around: before a space between two characters that are not
white space.  A leaf holds a chunk's characters and its number of ids, inner nodes hold sums.  ``build_trees`` stores the
leaves beside the texts once; ``apply_edits`` reads them back and never encodes a chunk that no edit touches.  An edit finds
its chunks by descent over the character sums and takes in what lies within CONTEXT characters on either side; that
region is encoded anew, cut again where it has grown past MOST characters, and the sums above it are updated.  The regions
that a group of documents needs at a time are encoded together.

Rows: null text counts as empty; null or empty edit lists leave the count as it is; an edit's position and length are
cut to the text as it then is; repeated rows and null ids are counted row by row; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm import encoder as enc
from flowmill.llm import storage, textbuf

CHUNK = 64  # pre-tokens a chunk, about
STEP = 6 * CHUNK  # characters a chunk at least, where its pre-tokens are not known
MOST = 4 * STEP  # characters of a chunk past which it is cut again
CONTEXT = 2  # characters on either side of a cut that decide it
TREE_SCHEMA = "doc_id long, text string, leaf_chars array<int>, leaf_ids array<int>"
COUNT_SCHEMA = "doc_id long, n_tokens_before long, n_tokens long, n_chars long, n_edits long, n_reencoded long, n_nodes long"
EDITS = "array<struct<pos: long, n_deleted: long, inserted: string>>"


def _encoder(vocabulary: str) -> enc.Encoder:
    encoder = enc.encoder(vocabulary)
    if not encoder.joined:
        raise ValueError("chunks need a vocabulary that keeps white space")
    return encoder


def _space(ch: str) -> bool:
    return ch.isspace() or "\x1c" <= ch <= "\x1f"


def safe_cut(text: str, p: int) -> bool:
    """Whether the pre-tokens on either side of p do not depend on each other."""
    return 0 < p < len(text) - 1 and text[p] == " " and not _space(text[p - 1]) and not _space(text[p + 1])


def chunks(text: str) -> list[str]:
    """The text cut into chunks of STEP characters and more."""
    cut, at = [0], 0
    while (at := text.find(" ", at + STEP)) >= 0:
        while at >= 0 and not safe_cut(text, at):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        cut.append(at)
    return [text[a:b] for a, b in zip(cut, [*cut[1:], len(text)], strict=True)]


class SegmentTree:
    """Sums of (characters, ids) over the chunks of a text; a touched chunk keeps its own text, others are read from it."""

    def __init__(self, text: str, chars: list[int], ids: list[int]):
        self.base, self.nodes = text, 0
        at, leaves = 0, []
        for n, k in zip(chars, ids, strict=True):
            leaves.append((at, n, k))
            at += n
        self._set(leaves)

    def _set(self, leaves: list[tuple]) -> None:
        """leaves: (first character in the base text, or the chunk itself, characters, ids)."""
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.leaves = leaves + [("", 0, 0)] * (self.size - len(leaves))
        self.chars, self.ids = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (_, n, m) in enumerate(leaves, self.size):
            self.chars[k], self.ids[k] = n, m
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k], self.ids[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.ids[2 * k] + self.ids[2 * k + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_ids(self) -> int:
        return self.ids[1]

    def piece(self, leaf: int) -> str:
        where, n, _ = self.leaves[leaf]
        return where if isinstance(where, str) else self.base[where : where + n]

    def find(self, p: int) -> tuple[int, int]:
        """(leaf, its first character) of the chunk that holds character p; the last chunk with characters at the end."""
        k, at = 1, 0
        p = min(p, self.n_chars - 1)
        while k < self.size:
            k *= 2
            if p - at >= self.chars[k]:
                at += self.chars[k]
                k += 1
        return k - self.size, at

    def region(self, p: int, n: int, inserted: str) -> tuple[int, int, list[str]]:
        """First and last chunk that an edit touches (n characters from p on give way to ``inserted``) and the chunks that
        take their place."""
        p = max(0, min(p, self.n_chars))
        n = max(0, min(n, self.n_chars - p))
        if not self.n_chars:
            new, first, last = inserted, 0, self.size - 1
        else:
            first, at = self.find(max(0, p - CONTEXT))
            last, _ = self.find(p + n + CONTEXT)
            old = "".join(map(self.piece, range(first, last + 1)))
            new = old[: p - at] + inserted + old[p - at + n :]
        return first, last, chunks(new) if len(new) > MOST else [new]

    def put(self, first: int, last: int, pieces: list[str], ids: list[int]) -> None:
        """Chunks first to last give way to ``pieces``; the sums above them follow."""
        new = [(x, len(x), k) for x, k in zip(pieces, ids, strict=True)]
        if len(new) > last - first + 1:  # no room: all leaves move, none is encoded
            self._set([x for x in self.leaves[:first] + new + self.leaves[last + 1 :] if x[1]])
            self.nodes += 2 * self.size
            return
        touched = set()
        for leaf, x in enumerate(new + [("", 0, 0)] * (last - first + 1 - len(new)), first):
            if x[1] or self.leaves[leaf][1]:
                self.leaves[leaf] = x
                self.chars[leaf + self.size], self.ids[leaf + self.size] = x[1:]
                touched.add((leaf + self.size) // 2)
        while touched and max(touched):
            for k in touched:
                self._sum(k)
            self.nodes += len(touched)
            touched = {k // 2 for k in touched if k > 1}

    def text(self) -> str:
        return "".join(map(self.piece, range(self.size)))

    def stored(self) -> tuple[list[int], list[int]]:
        """Characters and ids of the chunks."""
        some = [x for x in self.leaves if x[1]]
        return [x[1] for x in some], [x[2] for x in some]


def edit(trees: list[SegmentTree], edits: list[tuple[int, int, str] | None], encoder: enc.Encoder) -> list[int]:
    """One edit (position, deleted characters, inserted text) of each tree, or none; all regions are encoded together.
    Characters encoded by tree."""
    some = [k for k, e in enumerate(edits) if e is not None]
    regions = [trees[k].region(*edits[k]) for k in some]
    ids = encoder.lengths(pa.array([x for *_, pieces in regions for x in pieces], pa.string())).tolist()
    out, at = [0] * len(trees), 0
    for k, (first, last, pieces) in zip(some, regions, strict=True):
        trees[k].put(first, last, pieces, ids[at : at + len(pieces)])
        at += len(pieces)
        out[k] = sum(map(len, pieces))
    return out


def leaves(raw: np.ndarray, offsets: np.ndarray, encoder: enc.Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters and ids of the chunks of some texts, one text after the other, and n+1 bounds."""
    encoder.memo.room()
    n, ok = len(offsets) - 1, encoder.vectorised(raw, offsets)
    buf = textbuf.padded(raw)
    begin, lens = enc.cuts(buf, offsets, True)
    total = np.concatenate([[0], np.cumsum(encoder.counts(buf, begin, lens)[1])])
    text = np.searchsorted(offsets, begin, side="right") - 1
    first = np.searchsorted(begin, offsets)
    white = np.isin(buf, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    place = np.arange(len(begin)) - first[text]
    # a pre-token that starts with one space after a character and has another character behind it
    cut = (place == 0) | ((place % CHUNK == 0) & (buf[begin] == 32) & ~white[begin - 1] & (begin + 1 < offsets[text + 1]) & ~white[begin + 1])
    at = np.flatnonzero(cut)
    edge, owner = np.append(begin[at], len(raw)), text[at]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars, ids = np.diff(before[edge]), np.diff(total[np.append(at, len(begin))])
    if not ok.all():
        parts = []
        for k in range(n):
            mine = slice(*np.searchsorted(owner, [k, k + 1]))
            if ok[k]:
                parts.append((chars[mine], ids[mine]))
            else:
                pieces = chunks(raw[offsets[k] : offsets[k + 1]].tobytes().decode())
                parts.append((np.array(list(map(len, pieces))), encoder.lengths(pa.array(pieces))))
        return np.concatenate([c for c, _ in parts]), np.concatenate([i for _, i in parts]), np.concatenate([[0], np.cumsum([len(c) for c, _ in parts])])
    return chars, ids, np.searchsorted(owner, np.arange(n + 1))


def build_trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text, leaf_chars, leaf_ids) of every row: the texts and the leaves of their trees, to be stored."""

    def run(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            for first, last, raw, offsets in textbuf.groups(batch.column(1)):
                chars, ids, bound = leaves(raw, offsets, encoder)
                part = batch.slice(first, last - first)
                lists = [pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (chars, ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["doc_id", "text", "leaf_chars", "leaf_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textbuf.frugal(run), TREE_SCHEMA)


def apply_edits(trees: DataFrame, edits: Column, vocabulary: str, keep: bool = False) -> DataFrame:
    """Counts of every stored document before and after its ``edits``, an array of (pos, n_deleted, inserted) applied in
    turn.  keep: also text, leaf_chars and leaf_ids as they then are, to be stored for the next edits."""

    def run(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            for first, last, _, _ in textbuf.groups(batch.column(1)):
                part = batch.slice(first, last - first)
                names, texts, chars, ids, lists = (part.column(k).to_pylist() for k in range(5))
                some = [SegmentTree(t or "", c or [], i or []) for t, c, i in zip(texts, chars, ids, strict=True)]
                before, again = [t.n_ids for t in some], [0] * len(some)
                todo = [x or [] for x in lists]
                for r in range(max(map(len, todo), default=0)):
                    now = [(x[r]["pos"] or 0, x[r]["n_deleted"] or 0, x[r]["inserted"] or "") if r < len(x) else None for x in todo]
                    again = [a + b for a, b in zip(again, edit(some, now, encoder), strict=True)]
                out = [names, before, [t.n_ids for t in some], [t.n_chars for t in some], list(map(len, todo)), again, [t.nodes for t in some]]
                columns = [pa.array(x, pa.int64()) for x in out]
                if keep:
                    stored = [t.stored() for t in some]
                    columns += [pa.array([None if x is None and not t.n_chars else t.text() for x, t in zip(texts, some, strict=True)], pa.string())]
                    columns += [pa.array([s[k] for s in stored], pa.list_(pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, schema)

    schema = [x.split()[0] for x in COUNT_SCHEMA.split(", ")] + (["text", "leaf_chars", "leaf_ids"] if keep else [])
    kinds = COUNT_SCHEMA + (", text string, leaf_chars array<int>, leaf_ids array<int>" if keep else "")
    return trees.select("doc_id", "text", "leaf_chars", "leaf_ids", edits.cast(EDITS).alias("edits")).mapInArrow(textbuf.frugal(run), kinds)


def count_edits(docs: DataFrame, edits: Column, vocabulary: str) -> DataFrame:
    """Store the trees of ``docs``, then apply ``edits`` (over doc_id and text) to the stored trees."""
    return apply_edits(storage.materialize(build_trees(docs, vocabulary), "trees"), edits, vocabulary)


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits drawn from the document's id: an insertion, a deletion and a replacement anywhere in the text."""
    size = F.coalesce(F.length(text), F.lit(0)).cast("long") + 1

    def at(salt: int) -> Column:
        return F.pmod(F.xxhash64(doc_id, F.lit(salt)), size)

    def one(pos: Column, n: Column | int, inserted: str) -> Column:
        return F.struct(pos.alias("pos"), (n if isinstance(n, Column) else F.lit(n)).cast("long").alias("n_deleted"), F.lit(inserted).alias("inserted"))

    return F.array(one(at(1), 0, " added 2024's note"), one(at(2), F.pmod(F.xxhash64(doc_id, F.lit(4)), F.lit(40)), ""), one(at(3), 9, "été\n ok"))
