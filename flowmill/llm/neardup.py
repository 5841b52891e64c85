"""Near-duplicate documents: SetSketch registers, bands, joint likelihood, and a check on full shingle sets.

Texts of one shingle set are one class.  A class meets, in each bucket of a band, only the bucket's leader; links are
confirmed on the full sets and joined into components.  Members that still stand in different components of a bucket
are then compared with each other, block by block and in memory: first by likelihood, then, for members that may still
have a partner, on full sets; only links that join two components are emitted.  So a group of copies makes a number of
rows in proportion to its size, and no two texts of one bucket that are linked and pass the floor end in different
components.  A pair at the threshold shares no bucket with a probability below 4e-6 at 0.8 and about 2e-8 at 0.85; its
estimate falls below the floor of the full check (MARGIN) with about 1e-6 and 2e-6.

Rows: null, empty and blank texts have no shingles, are linked with nothing and kept; texts of fewer words than a
shingle are one shingle; a null doc_id never names a component (its row is kept only if no row of its component has
an id); rows of one doc_id are each classed by their own text; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm import setsketch, storage, textbuf
from flowmill.llm.components import components

GROUP_BYTES = 1 << 19
#: Members of a bucket that one task compares with as many others.
BLOCK = 2000
#: Estimates below the threshold by more standard errors than this are not checked on full sets.
MARGIN = 5.0
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(7)
_WEIGHTS = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)

SKETCH_SCHEMA = "doc_id long, text_key long, n_shingles long, class binary, sketch array<long>"
SET_SCHEMA = "class binary, shingles array<long>"


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word and the index of its text."""
    buf = textbuf.padded(_LOWER[raw])
    starts, ends = textbuf.runs(~_SPACE[buf[: len(raw)]], offsets)
    lens = ends - starts
    h = textbuf.hashes(buf, starts, lens)
    return h, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and n+1 bounds."""
    n = len(offsets) - 1
    h, doc = word_hashes(raw, offsets)
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)
    parts, bounds = [], np.zeros(n + 1, np.int64)
    if len(h) >= words:
        rolled = h[: len(h) - words + 1] * _WEIGHTS[0]
        for i in range(1, words):
            rolled = rolled + h[i : len(h) - words + 1 + i] * _WEIGHTS[i]
        rolled = textbuf.mix(rolled)
    for k in range(n):
        if size[k] >= words:
            s = np.unique(rolled[first[k] : first[k + 1] - words + 1])
        elif size[k]:
            few = h[first[k] : first[k + 1]]
            s = textbuf.mix((few * _WEIGHTS[: len(few)]).sum(keepdims=True) + _U(len(few)))
        else:
            s = h[:0]
        parts.append(s)
        bounds[k + 1] = bounds[k] + len(s)
    return (np.concatenate(parts) if parts else h[:0]), bounds


def _class(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, class, sketch) of every row; class and sketch are null without words."""

    def run(batches):
        for batch in batches:
            for first, last, raw, offsets in textbuf.groups(batch.column(1), GROUP_BYTES):
                s, bounds = shingle_sets(raw, offsets, words)
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                names = [None] * (last - first)
                keys = np.zeros((0, setsketch.M // setsketch.ROWS), np.int64)
                if len(some):
                    keys = setsketch.bands(setsketch.sketch(s, bounds[:-1][some]))
                    for k in some.tolist():
                        names[k] = _class(s[bounds[k] : bounds[k + 1]])
                width = keys.shape[1]
                cut = np.concatenate([[0], np.cumsum((size > 0) * width)])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(first, last - first), "text_key": batch.column(2).slice(first, last - first), "n_shingles": size, "class": pa.array(names, pa.binary()), "sketch": _lists(keys.ravel(), cut)}
                )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(textbuf.frugal(run), SKETCH_SCHEMA)


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """rows: (class, text).  Shingles of the rows whose text is of that class."""

    def run(batches):
        for batch in batches:
            want = batch.column(0).to_pylist()
            for first, last, raw, offsets in textbuf.groups(batch.column(1), GROUP_BYTES):
                s, bounds = shingle_sets(raw, offsets, words)
                mine = [k for k in range(last - first) if _class(s[bounds[k] : bounds[k + 1]]) == want[first + k]]
                if mine:
                    part = [s[bounds[k] : bounds[k + 1]] for k in mine]
                    cut = np.concatenate([[0], np.cumsum([len(x) for x in part])])
                    yield pa.RecordBatch.from_pydict({"class": pa.array([want[first + k] for k in mine], pa.binary()), "shingles": _lists(np.concatenate(part).view(np.int64), cut)})

    return rows.mapInArrow(textbuf.frugal(run), SET_SCHEMA)


def _floor(percent: float) -> float:
    j = percent / 100
    return j - MARGIN * (j * (1 - j) / setsketch.M) ** 0.5 - 0.005


def _likely(pairs: DataFrame, percent: float) -> DataFrame:
    """pairs (a, b, sketch and size of both) whose likeliest similarity may reach the threshold."""
    least = _floor(percent)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            x, y = (setsketch.registers(np.asarray(batch.column(c).flatten()).reshape(n, -1)) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(setsketch.may_reach(x, y, np.asarray(batch.column(4)), np.asarray(batch.column(5)), least)))

    return pairs.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(textbuf.frugal(run), "a binary, b binary")


def _full_sets(need: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(class, shingles) of the classes in ``need`` (class), from the text of one row each."""
    named = classes.select("class", "rep", "text_key").join(need, "class", "left_semi")
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    # rows without an id are told apart by their text alone: copies fold before the join
    bare = texts.filter("rep IS NULL").groupBy("text_key").agg(F.first("text").alias("text"))
    found = named.join(texts, ["rep", "text_key"]).select("class", "text").unionByName(named.filter("rep IS NULL").join(bare, "text_key").select("class", "text"))
    sets = _sets(found, words)
    return storage.materialize(sets.groupBy("class").agg(F.first("shingles").alias("shingles")), "sets")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: float) -> DataFrame:
    """The pairs (a, b) of classes that reach ``percent`` on their full sets."""
    pairs = storage.materialize(pairs, "pairs")
    sets = _full_sets(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), classes, docs, words)
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


class _Block:
    """The members of one block of a bucket; ``rivals`` lists those of row x that may be linked to it."""

    def __init__(self, band: int, i: int, j: int, rows: pd.DataFrame, least: float):
        self.band, self.least, self.within = band, least, i == j
        self.reg = setsketch.registers(np.array(rows["sketch"].tolist(), np.int64).reshape(len(rows), -1))
        self.keys = self.reg.view(np.int64)
        self.size = rows["n_shingles"].to_numpy()
        self.names = rows["class"].map(bytes).tolist()
        self.lead = np.array([bytes(x) == y for x, y in zip(rows["leader"], self.names, strict=True)])
        self.component = pd.factorize(rows["component"].map(bytes))[0]
        side = rows["own"].to_numpy()
        self.starts = np.flatnonzero(~self.lead & (self.within | (side == i)))
        self.others = ~self.lead & (self.within | (side == j))

    def rivals(self, x: int) -> np.ndarray:
        """Rows in another component, not the leader, first met in this band, of an estimate that may be enough."""
        y = np.flatnonzero(self.others & (self.component != self.component[x]))
        if self.within:
            y = y[y > x]
        y = y[~(self.keys[y, : self.band] == self.keys[x, : self.band]).any(1)]
        y = y[(self.reg[y] == self.reg[x]).sum(1) >= (self.least - 0.1) * self.reg.shape[1]]
        if not len(y):
            return y
        return y[setsketch.may_reach(self.reg[x][None, :], self.reg[y], np.full(len(y), self.size[x]), self.size[y], self.least)]

    def join(self, x: int, y: int) -> None:
        self.component[self.component == self.component[y]] = self.component[x]


def _open_members(members: DataFrame, percent: float) -> DataFrame:
    """The rows of ``members``, dealt as blocks (i, j) of at most about BLOCK by BLOCK members of a bucket, that have a
    rival there.  members: (band, key, class, leader, n, component, sketch, n_shingles)."""
    least = _floor(percent)
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = (
        members.withColumn("chunks", chunks)
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "leader", "component", "sketch", "n_shingles")
    )

    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(key[0], key[2], key[3], rows, least)
        has = np.zeros(len(rows), bool)
        for x in block.starts.tolist():
            y = block.rivals(x)
            has[y] = True
            has[x] |= len(y) > 0
        return rows[has]

    return dealt.groupBy("band", "key", "i", "j").applyInPandas(mark, dealt.schema)


def _joined(members: DataFrame, percent: float) -> DataFrame:
    """Links (a, b) found on the full sets of marked members (with shingles) that join components within a block."""
    least = _floor(percent)

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = _Block(key[0], key[2], key[3], rows, least)
        sets = [np.asarray(x, np.int64) for x in rows["shingles"]]
        flat, size = np.unique(np.concatenate(sets), return_inverse=True)[1], np.array([len(x) for x in sets])
        first = np.concatenate([[0], np.cumsum(size)])
        mine = np.zeros(int(flat.max()) + 1, bool)
        a, b = [], []
        for x in block.starts.tolist():
            y = block.rivals(x)
            if not len(y):
                continue
            own = flat[first[x] : first[x + 1]]
            mine[own] = True
            hit = mine[np.concatenate([flat[first[k] : first[k + 1]] for k in y.tolist()])]
            shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[y]) - size[y])
            mine[own] = False
            for k in y[100 * shared >= percent * (size[x] + size[y] - shared)].tolist():
                if block.component[k] != block.component[x]:
                    a.append(block.names[x])
                    b.append(block.names[k])
                    block.join(x, k)
        return pd.DataFrame({"a": a, "b": b}, dtype=object)

    return members.groupBy("band", "key", "i", "j").applyInPandas(link, "a binary, b binary")


def _linked(each: DataFrame, docs: DataFrame, words: int, percent: float) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Classes of equal sets, tables of links (a, b) between them, and their components (node, component)."""
    spark = each.sparkSession
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("place")
    classes = each.filter("class IS NOT NULL").groupBy("class").agg(place, F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = storage.materialize(classes.select("class", F.col("place.doc_id").alias("rep"), F.col("place.text_key").alias("text_key"), "n_shingles", "sketch"), "classes")
    banded = classes.select("class", F.posexplode("sketch").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = storage.materialize(banded.join(buckets, ["band", "key"]), "members")

    def side(x: str) -> DataFrame:
        return classes.select(F.col("class").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def joined(tables: list[DataFrame]) -> DataFrame:
        with storage.scratch(spark) as s:
            out = storage.materialize(components(tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])), "components")
            s.keep(out)
        return out

    star = members.filter("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b")).distinct()
    with storage.scratch(spark) as s:
        likely = _likely(star.join(side("a"), "a").join(side("b"), "b"), percent)
        links = [storage.materialize(_verified(likely, classes, docs, words, percent), "links")]
        s.keep(*links)
    found = joined(links)

    several = members.filter("n > 2")
    placed = several.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band", "key")
    open_ = placed.join(split, ["band", "key"]).join(classes.select("class", "sketch", "n_shingles"), "class")
    marked = storage.materialize(_open_members(open_, percent), "marked")
    if not marked.isEmpty():
        with storage.scratch(spark) as s:
            sets = _full_sets(marked.select("class").distinct(), classes, docs, words)
            extra = storage.materialize(_joined(marked.join(sets, "class"), percent).distinct(), "links")
            s.keep(extra)
        if not extra.isEmpty():
            links.append(extra)
            found = joined(links)
    return classes, links, found


def near_duplicates(docs: DataFrame, words: int = 5, percent: float = 80) -> DataFrame:
    """One row a document: doc_id, text_key, n_shingles, group (of the component; null without words), component_id (the
    smallest doc_id reachable over links), n_links (with other classes, as found), kept.  Linked: ``100 * shared >=
    percent * union`` of the sets of distinct shingles."""
    spark = docs.sparkSession
    each = storage.materialize(sketches(docs, words), "sketches")
    with storage.scratch(spark) as tables:
        classes, links, found = _linked(each, docs, words, percent)
        tables.keep(classes, *links, found)
    links = links[0] if len(links) == 1 else links[0].unionByName(links[1])

    ends = links.select(F.col("a").alias("class")).unionAll(links.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    named = found.join(classes.select(F.col("class").alias("node"), "rep"), "node")
    heads = named.groupBy("component").agg(F.min("rep").alias("head"))
    moved = found.join(heads, "component").select(F.col("node").alias("class"), "component", "head")
    home = classes.select("class", "rep").join(moved, "class", "left").join(ends, "class", "left")
    home = home.select("class", F.coalesce("component", "class").alias("group"), F.coalesce("head", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = each.filter("class IS NULL").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("binary").alias("group"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    classed = each.filter("class IS NOT NULL").select("doc_id", "text_key", "n_shingles", "class").join(home, "class").drop("class")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return classed.unionByName(alone).withColumn("kept", kept)


def keep_one(docs: DataFrame, words: int = 5, percent: float = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each group: the one of the smallest doc_id (a null one
    last), then of the smallest text hash; of rows that agree in both, any.  Rows without words all stay."""
    found = storage.materialize(near_duplicates(docs, words, percent).filter("group IS NOT NULL").select("doc_id", "text_key", "group"), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    each = found.groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = found.groupBy("group").agg(F.min(place).alias("first"))
    marked = storage.materialize(each.join(first, "group").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n", (place == F.col("first")).alias("stays")), "marked")

    def at(rows: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        m = marks.select("_id", "_key")
        return rows.join(m, rows["doc_id"].cast("long").eqNullSafe(m["_id"]) & (F.xxhash64(rows["text"].cast("string")) == m["_key"]), how)

    out = at(docs, marked.filter("NOT stays"), "left_anti")
    again = marked.filter("stays AND n > 1")
    if again.isEmpty():
        return out
    key = F.xxhash64(F.col("text").cast("string"))
    same = at(out, again, "left_semi").groupBy("doc_id", key).agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*")
    return at(out, again, "left_anti").unionByName(same)
