"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words and their first PREFIXES bytes, hashed to 2**BITS buckets, each present once, twice
or four times and more.  The machine learns a weight and a factor vector for each admitted term; inner products of the
factors score pairs, such as an insult with a mention of a group.  A term is admitted in either of two ways: its own
presence goes with the label by at least Z_LEAST standard errors; or it is one of a pair of words that interact: the label's
log-odds with both differ by at least PAIR_Z standard errors from what either adds without the other.  Pairs are looked
for among the PAIR_TERMS words that most sampled texts hold.

The fit runs on the driver over a bounded sample of labelled rows; ``sample`` is its bound, rare classes are sampled
less and rows weigh by the inverse of their rate.  Executors count the terms first, and only admissible ones are collected.

Rows: null and empty texts are scored by the intercept; repeated rows alike; rows without a doc_id are never learned
from; labels of one doc_id count once (the larger); with no labelled row at all, or one class only, all scores are the
rate of the labels (0 without any); an empty table gives no row; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm import letters, storage, textbuf

BITS = 20
Z_LEAST, LEAST = 4.0, 3  # of a term by itself: standard errors, and texts
PAIR_Z, PAIR_LEAST, PAIR_TERMS = 8.0, 20, 2000
PREFIXES = (4, 5, 6, 7, 8, 9, 10)
COUNTS = (1, 2, 4)
COUNT_SCHEMA = "term int, whole boolean, n long, seen double, toxic double"
TERM_SCHEMA = "label double, weight double, terms array<int>"
SCORE_SCHEMA = "doc_id long, score double"


def _terms(raw: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = PREFIXES) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of their prefixes, and their texts."""
    buf, starts, lens, doc = letters.words(raw, offsets)
    shift = np.uint64(64 - BITS)
    terms, docs = [(textbuf.hashes(buf, starts, lens) >> shift).astype(np.int64)], [doc]
    a, b, c = textbuf.keys(buf, starts, np.minimum(lens, max(PREFIXES)))
    for n in prefixes:
        some = np.flatnonzero(lens > n)
        x, y = (a[some] & textbuf.low_bytes(min(n, 8))), (b[some] & textbuf.low_bytes(max(0, n - 8)))
        h = textbuf.key_hash(x, y, c[some], np.full(len(some), n)) + np.uint64(0x5851F42D4C957F2D)
        terms.append((textbuf.mix(h) >> shift).astype(np.int64))
        docs.append(doc[some])
    return np.concatenate(terms), np.concatenate(docs)


def _counted(terms: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term) pairs: term = bin << BITS | bucket for every bin that the count of the bucket reaches."""
    pair, count = np.unique(doc << BITS | terms, return_counts=True)
    rows, out = [], []
    for k, least in enumerate(COUNTS):
        some = pair[count >= least]
        rows.append(some >> BITS)
        out.append(some & ((1 << BITS) - 1) | k << BITS)
    return np.concatenate(rows), np.concatenate(out)


class FactorizationMachine:
    """score = sigmoid(bias + sum w + half of (|sum v|^2 - sum |v|^2)) over the kept terms present in a text."""

    def __init__(self, kept: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.kept, self.bias, self.w, self.v = kept, bias, w, v
        self.slot = np.full(len(COUNTS) << BITS, -1, np.int32)
        self.slot[kept] = np.arange(len(kept))
        self.watched = (self.slot.reshape(len(COUNTS), -1) >= 0).any(0)

    def __reduce__(self):
        return type(self), (self.kept, self.bias, self.w, self.v)

    def raw(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """row, term: distinct pairs of text and kept bucket."""
        out = np.full(n, self.bias) + np.bincount(row, self.w[term], n)
        for f in range(self.v.shape[1]):
            x = self.v[term, f]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def score(self, terms: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        some = self.watched[terms]
        row, term = _counted(terms[some], doc[some])
        term = self.slot[term]
        row, term = row[term >= 0], term[term >= 0]
        return 1 / (1 + np.exp(-np.clip(self.raw(row, term, n), -40, 40)))

    @classmethod
    def fit(cls, texts: list[np.ndarray], label: np.ndarray, weight: np.ndarray, words: np.ndarray | None = None, factors: int = 8, steps: int = 200, decay: float = 1e-2, seed: int = 5) -> FactorizationMachine:
        """texts: the terms of each text; words: terms among which pairs are looked for (all)."""
        n, size = len(texts), len(COUNTS) << BITS
        rate = float((label * weight).sum() / weight.sum()) if n else 0.0
        if not 0 < rate < 1:
            return cls(np.zeros(0, np.int64), 40.0 if rate else -40.0, np.zeros(0), np.zeros((0, factors)))
        row = np.repeat(np.arange(n), [len(x) for x in texts])
        flat = np.concatenate(texts)
        own = admissible(np.bincount(flat, minlength=size), np.bincount(flat, weight[row], size), np.bincount(flat, (label * weight)[row], size), rate, weight.mean())
        words = np.unique(flat) if words is None else words
        kept = np.union1d(np.flatnonzero(own), paired(row, flat, label, words))
        rng, d = np.random.default_rng(seed), len(kept)
        out = cls(kept, float(np.log(rate / (1 - rate))), np.zeros(d), rng.normal(0, 0.05, (d, factors)))
        term = out.slot[flat]
        row, term = row[term >= 0], term[term >= 0]
        params = [np.array([out.bias]), out.w, out.v]
        first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        scale = weight / weight.sum()
        for t in range(1, steps + 1):
            out.bias = float(params[0][0])
            g = (1 / (1 + np.exp(-np.clip(out.raw(row, term, n), -40, 40))) - label) * scale
            gw = np.bincount(term, g[row], d) + decay * out.w / n**0.5
            gv = np.empty_like(out.v)
            for f in range(factors):
                x = out.v[term, f]
                s = np.bincount(row, x, n)
                gv[:, f] = np.bincount(term, g[row] * (s[row] - x), d)
            gv += 10 * decay * out.v / n**0.5
            for p, grad, a, b in zip(params, [np.array([g.sum()]), gw, gv], first, second, strict=True):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad * grad - b)
                p -= 0.05 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-9)
        out.bias = float(params[0][0])
        return out


def admissible(n: np.ndarray, seen: np.ndarray, toxic: np.ndarray, rate: float, mean: float) -> np.ndarray:
    """Terms that go with the label by themselves.  n: texts; seen and toxic: their weight, and that of the toxic ones."""
    return (np.abs(toxic - seen * rate) >= Z_LEAST * np.sqrt(np.maximum(seen, 1e-9) * rate * (1 - rate) * mean)) & (n >= LEAST)


def paired(row: np.ndarray, term: np.ndarray, label: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The words of pairs that interact: the log-odds of the label with both, less those with either, plus those with
    neither, is PAIR_Z of its standard errors from zero.  Weights by class cancel in it."""
    count = np.bincount(term, minlength=int(max(words, default=0)) + 1)[words]
    words = np.sort(words[np.lexsort((words, -count))][:PAIR_TERMS][: (count >= PAIR_LEAST).sum()])
    at = np.minimum(np.searchsorted(words, term), max(0, len(words) - 1))
    some = np.flatnonzero(words[at] == term) if len(words) else at[:0]
    there = np.zeros((len(label), len(words)), np.float32)
    place = np.empty(len(label), np.int64)
    place[np.argsort(label <= 0, kind="stable")] = np.arange(len(label))  # toxic texts first, so that classes are views
    there[place[row[some]], at[some]] = 1
    classes = np.split(there, [int((label > 0).sum())])
    hit = np.zeros(len(words), bool)
    for a in range(0, len(words), 256):
        odds, spread, texts = 0.0, 0.0, 0.0
        for x, sign in zip(classes, (1, -1), strict=True):
            both, mine, all_ = x[:, a : a + 256].T @ x, x[:, a : a + 256].sum(0)[:, None], x.sum(0)[None, :]
            for cell, side in ((both, 1), (mine - both, -1), (all_ - both, -1), (len(x) - mine - all_ + both, 1)):
                odds = odds + sign * side * np.log(cell + 0.5)
                spread = spread + 1 / (cell + 0.5)
            texts = texts + both
        z = np.where(texts >= PAIR_LEAST, np.abs(odds) / np.sqrt(spread), 0)
        z[np.arange(len(z)), np.arange(a, a + len(z))] = 0
        hit[a : a + 256] |= (z >= PAIR_Z).any(1)
    return words[hit]


def _fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = 4000) -> FactorizationMachine:
    """Fit on about ``sample`` rows at most of each class of ``labels`` (doc_id, toxic) whose doc_id passes ``learn``."""
    with storage.scratch(docs.sparkSession):
        return _fitted(docs, labels, learn, sample)


def _fitted(docs: DataFrame, labels: DataFrame, learn: Column | None, sample: int) -> FactorizationMachine:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("label")).filter("doc_id IS NOT NULL AND label IS NOT NULL")
    known = (known.filter(learn) if learn is not None else known).groupBy("doc_id").agg(F.max("label").alias("label"))
    size = {bool(r["y"]): r["n"] for r in known.groupBy((F.col("label") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = {y: min(1.0, sample / n) for y, n in size.items()}
    rate = F.when(F.col("label") > 0, F.lit(keep.get(True, 1.0))).otherwise(F.lit(keep.get(False, 1.0)))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(unit < rate).select("doc_id", F.when(F.col("label") > 0, 1.0).otherwise(0.0).alias("label"), (1 / rate).alias("weight"))
    # at most about 2 * sample rows, so the broadcast is bounded by the parameter, and so is the table of their texts
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "weight", "text")
    rows = storage.materialize(rows, "toxicity-sample")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("label") * F.col("weight")).alias("t")).first()
    rate = (total["t"] or 0.0) / (total["w"] or 1.0)
    if not 0 < rate < 1:
        return FactorizationMachine.fit([np.zeros(0, np.int64)] * min(total["n"], 1), np.full(min(total["n"], 1), rate), np.ones(min(total["n"], 1)))

    def count(batches):
        size = len(COUNTS) << BITS
        n, seen, toxic = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        word = np.zeros(size, bool)
        for batch in batches:
            label, weight = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for first, last, raw, offsets in textbuf.groups(batch.column(2)):
                row, term = _counted(*_terms(raw, offsets))
                y, w = label[first:last][row], weight[first:last][row]
                n += np.bincount(term, minlength=size)
                seen += np.bincount(term, w, size)
                toxic += np.bincount(term, w * y, size)
                word[_terms(raw, offsets, ())[0]] = True
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int32()), "whole": word[some], "n": n[some], "seen": seen[some], "toxic": toxic[some]})

    counted = rows.mapInArrow(textbuf.frugal(count), COUNT_SCHEMA).groupBy("term").agg(F.bool_or("whole").alias("whole"), *[F.sum(c).alias(c) for c in ("n", "seen", "toxic")])
    spread = F.sqrt(F.col("seen") * (rate * (1 - rate) * total["w"] / total["n"]))
    own = (F.abs(F.col("toxic") - F.col("seen") * rate) >= Z_LEAST * spread) & (F.col("n") >= LEAST)
    counted = storage.materialize(counted.withColumn("own", own), "toxicity-terms")
    often = counted.filter(F.col("whole") & (F.col("n") >= PAIR_LEAST)).orderBy(F.desc("n"), "term").limit(PAIR_TERMS)
    words = np.sort(np.array([r["term"] for r in often.select("term").collect()], np.int64))
    wanted = np.union1d(words, np.array([r["term"] for r in counted.filter("own").select("term").collect()], np.int64))
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def lists(batches):
        mine = np.zeros(len(COUNTS) << BITS, bool)
        mine[sent.value] = True
        for batch in batches:
            for first, last, raw, offsets in textbuf.groups(batch.column(2)):
                row, term = _counted(*_terms(raw, offsets))
                row, term = row[mine[term]], term[mine[term]]
                order = np.lexsort((term, row))
                cut = np.searchsorted(row[order], np.arange(last - first + 1))
                found = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(term[order].astype(np.int32)))
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found], ["label", "weight", "terms"])

    got = rows.mapInArrow(textbuf.frugal(lists), TERM_SCHEMA).toArrow().combine_chunks()
    terms = got.column("terms").combine_chunks()
    texts = [np.asarray(x.values, np.int64) for x in terms]
    order = sorted(range(len(texts)), key=lambda k: (texts[k].tobytes(), got.column("label")[k].as_py()))  # rows arrive in any order
    label, weight = (np.asarray(got.column(c).to_numpy())[order] for c in ("label", "weight"))
    return FactorizationMachine.fit([texts[k] for k in order], label, weight, words)


def score(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fm = sent.value
        for batch in batches:
            for first, last, raw, offsets in textbuf.groups(batch.column(1)):
                terms, doc = _terms(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(fm.score(terms, doc, last - first))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textbuf.frugal(run), SCORE_SCHEMA)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(_fold(doc_id, folds) == fold, F.lit(False))
