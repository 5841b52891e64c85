"""Language of words and texts by a linear-chain conditional random field.

A word's emission is the sum of the weights of its features (the word itself, affixes of one to three characters, all
inner bigrams and trigrams, the languages whose lexicon holds it), hashed to 2**BITS rows; a lexicon is learned for each
language from the training texts.  Transitions between the labels of neighbouring words are learned too, on chains that
join pieces of two texts so that switches occur.  Forward-backward over the whole text gives every word's marginals; a
text's language is the label of greatest mean marginal, and words keep labels of their own in code-switched text.

The fit runs on the driver over a bounded sample, and its bounds are parameters: about ``sample`` texts at most of a
language, ``max_words`` words of each at most in runs spread evenly over the text, ``epochs`` rounds over all of their
pieces.

Rows: null texts and texts without a letter get ``und`` and score 0; repeated rows alike; rows without a doc_id or a
lang are never learned from; with nothing to learn from every text is ``und``; an empty table gives no row; only
doc_id and text are read for a prediction.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm import letters, textbuf

BITS = 17
#: Words of a text that are worked on step by step; longer texts are joined from blocks of so many, without a cut.
BLOCK = 256
#: A language's lexicon: words of at least so many of its sampled texts.
LEXICON_TEXTS = 3
UNKNOWN = "und"
SCHEMA = "doc_id long, lang string, score double, words array<struct<lang: string, n: long>>"


def features(words: list[str], lexicon: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hashed feature) of all features of lower-case words: the word, the languages (by number) whose
    lexicon holds it, its first and last one to three characters, the bigrams and trigrams of ``<word>``."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(lens + 2)])
    owner = np.repeat(np.arange(len(words)), lens + 2)
    place = np.arange(len(codes)) - first[owner]
    lists = [lexicon.get(w, ()) for w in words]

    def gram(kind: int, at: np.ndarray, size: np.ndarray | int, most: int) -> np.ndarray:
        """Hash of ``size`` characters, ``most`` at most, from each place on."""
        h = np.full(len(at), kind, np.uint64)
        for k in range(most):
            h = np.where(k < size, textbuf.mix(h * np.uint64(31) + codes[np.minimum(at + k, len(codes) - 1)]), h)
        return h

    inner = (place > 0) & (place <= lens[owner])
    whole = np.bincount(owner[inner], (textbuf.mix(codes[inner] + (place[inner].astype(np.uint64) << np.uint64(32))) >> np.uint64(12)).astype(np.float64), len(words))
    found = [(np.arange(len(words)), textbuf.mix(whole.astype(np.uint64) * np.uint64(31) + lens.astype(np.uint64)))]
    for most in (1, 2, 3):
        size = np.minimum(lens, most)
        found += [(np.arange(len(words)), gram(1, first[:-1] + 1, size, most)), (np.arange(len(words)), gram(2, first[1:] - 1 - size, size, most))]
    for size in (2, 3):
        at = np.flatnonzero(place <= lens[owner] + 2 - size)
        found.append((owner[at], gram(size + 1, at, size, size)))
    held = np.repeat(np.arange(len(words)), list(map(len, lists)))
    found.append((held, textbuf.mix(np.array([x for y in lists for x in y], np.uint64) + np.uint64(1 << 40))))
    return np.concatenate([o for o, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - BITS)).astype(np.int32)


class Crf:
    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, lexicon: dict[str, tuple[int, ...]] | None = None):
        self.labels, self.weights, self.transitions, self.lexicon = labels, weights, transitions, lexicon or {}
        self._memo: textbuf.WordMemo | None = None
        self._table, self._seen, self._generation = np.zeros((1 << 12, len(labels)), np.float32), 0, 0

    def __getstate__(self):
        return self.labels, self.weights, self.transitions, self.lexicon

    def __setstate__(self, state):
        self.__init__(*state)

    def _remember(self, words: list[bytes]) -> None:
        """The emission scores of words, behind those of the words before them."""
        if self._memo.generation != self._generation:
            self._generation, self._seen = self._memo.generation, 0
        owner, found = features([w.decode("utf-8", "replace") for w in words], self.lexicon)
        k = self._seen + len(words)
        while len(self._table) < k:
            self._table = np.resize(self._table, (2 * len(self._table), len(self.labels)))
        for c in range(len(self.labels)):
            self._table[self._seen : k, c] = np.bincount(owner, self.weights[found, c], len(words))
        self._seen = k

    def emissions(self, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Emission scores of slices of padded ``buf``; each distinct word is worked out once."""
        if self._memo is None:
            self._memo = textbuf.WordMemo(self._remember)
        self._memo.room()
        index = self._memo.index(buf, starts, lens)  # may grow the table
        return self._table[index]

    def marginals(self, emissions: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Marginals of all words, chains of whole texts (``doc`` ascends).

        A text of more than BLOCK words is joined from blocks: a block's words make one matrix that carries messages over
        it, messages walk over the matrices block by block, and then all blocks are worked out side by side."""
        n, k = emissions.shape
        if not n:
            return np.zeros((0, k))
        move = np.exp(self.transitions)
        e = np.exp(np.clip(emissions - emissions.max(1, keepdims=True), -30, 0)).astype(np.float64)
        place = np.arange(n) - np.searchsorted(doc, doc)
        head = np.flatnonzero(place % BLOCK == 0)
        size = np.diff(np.append(head, n))
        into, onto = self._messages(e, move, head, size, place[head] // BLOCK)
        order = np.argsort(-size, kind="stable")
        head, size, into, onto = head[order], size[order], into[order], onto[order]
        alpha, beta = np.empty((n, k)), np.empty((n, k))
        steps = int(size[0])
        alive = np.searchsorted(-size, -np.arange(steps), side="left")
        a = into
        for t in range(steps):
            m = alive[t]
            at = head[:m] + t
            a = (a if t == 0 else a[:m] @ move) * e[at]
            a /= a.sum(1, keepdims=True)
            alpha[at] = a
        b = np.ones((0, k))
        for t in range(steps - 1, -1, -1):
            m = alive[t]
            at = head[:m] + t
            now = onto[:m].copy()  # blocks that end here
            now[: len(b)] = b
            beta[at] = now
            b = (now * e[at]) @ move.T
            b /= b.sum(1, keepdims=True)
        out = alpha * beta
        return out / out.sum(1, keepdims=True)

    @staticmethod
    def _messages(e: np.ndarray, move: np.ndarray, head: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block, what comes to its first word from the words before it and to its last from those behind."""
        k = e.shape[1]
        into, onto = np.ones((len(head), k)), np.ones((len(head), k))
        first = np.flatnonzero(number == 0)
        count = np.diff(np.append(first, len(head)))
        if count.max() == 1:
            return into, onto
        several = np.flatnonzero(np.repeat(count, count) > 1)
        several = several[np.argsort(-size[several], kind="stable")]
        over = np.zeros((len(head), k, k))  # from the message at a block's first word to that after its last
        steps = size[several]
        alive = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")
        carried = np.broadcast_to(np.eye(k), (len(several), k, k))
        for t in range(int(steps[0])):
            m = alive[t]
            over[several[m : len(carried)]] = carried[m:]
            carried = (carried[:m] if t == 0 else carried[:m] @ move) * e[head[several[:m]] + t][:, None, :]
            carried = carried / carried.sum((1, 2), keepdims=True)
        over[several[: len(carried)]] = carried
        for t in range(1, int(count.max())):
            here = first[count > t] + t
            x = np.einsum("ni,nij->nj", into[here - 1], over[here - 1]) @ move
            into[here] = x / x.sum(1, keepdims=True)
            back = (first + count - 1)[count > t] - t + 1
            y = np.einsum("nij,nj->ni", over[back], onto[back]) @ move.T
            onto[back - 1] = y / y.sum(1, keepdims=True)
        return into, onto

    @classmethod
    def fit(cls, texts: list[list[str]], labels: list[str], names: list[str], epochs: int = 3, piece: int = 12, batch: int = 256, rate: float = 0.3, seed: int = 11) -> Crf:
        """texts: lower-case words; labels: the language of each text.  Adaptive gradient steps on chains of two pieces of
        ``piece`` words, one in five of them from two languages; an epoch takes as many pieces as there are."""
        k = len(names)
        seen: dict[str, Counter] = {x: Counter() for x in names}
        for words, lang in zip(texts, labels, strict=True):
            seen[lang].update(set(words))
        lexicon: dict[str, tuple[int, ...]] = {}
        for i, x in enumerate(names):
            for w, n in seen[x].items():
                if n >= LEXICON_TEXTS:
                    lexicon[w] = (*lexicon.get(w, ()), i)
        out = cls(names, np.zeros((1 << BITS, k), np.float32), np.zeros((k, k)), lexicon)
        vocabulary: dict[str, int] = {}
        pieces, of = [], []
        for words, lang in zip(texts, labels, strict=True):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            for i in range(0, len(ids), piece):  # a short last piece starts earlier, a short text repeats
                chunk = ids[max(0, min(i, len(ids) - piece)) :][:piece]
                pieces.append((chunk * piece)[:piece])
                of.append(names.index(lang))
        if not pieces or k < 1:
            return out
        owner, found = features(list(vocabulary), lexicon)
        order = np.argsort(owner, kind="stable")
        flat, cut = found[order], np.searchsorted(owner[order], np.arange(len(vocabulary) + 1))
        words_, of_ = np.array(pieces), np.array(of)
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(of_, minlength=k).clip(1)[of_]
        share /= share.sum()
        sum_w, sum_t = np.full(out.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6)
        for _ in range(epochs * -(-len(pieces) // batch)):
            left = rng.choice(len(pieces), batch, p=share)
            same = np.array([rng.random() >= 0.2 for _ in range(batch)])
            right = np.where(same, left, rng.choice(len(pieces), batch, p=share))
            ids = np.concatenate([words_[left], words_[right]], 1)
            gold = np.repeat(np.stack([of_[left], of_[right]], 1), piece, 1)
            used, back = np.unique(ids, return_inverse=True)
            back = back.reshape(ids.shape)
            count = cut[used + 1] - cut[used]
            take = np.repeat(cut[used] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            feats = flat[take]
            owner = np.repeat(np.arange(len(used)), count)
            score = np.add.reduceat(out.weights[feats], np.concatenate([[0], np.cumsum(count)[:-1]]), 0).astype(np.float64)
            em = score[back]
            steps = ids.shape[1]
            e, move = np.exp(em - em.max(2, keepdims=True)), np.exp(out.transitions)
            alpha, beta = np.empty_like(e), np.ones_like(e)
            for t in range(steps):
                x = e[:, t] if not t else (alpha[:, t - 1] @ move) * e[:, t]
                alpha[:, t] = x / x.sum(1, keepdims=True)
            for t in range(steps - 2, -1, -1):
                x = (beta[:, t + 1] * e[:, t + 1]) @ move.T
                beta[:, t] = x / x.sum(1, keepdims=True)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            pair = alpha[:, :-1, :, None] * move[None, None] * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
            expected = (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))
            observed = np.zeros((k, k))
            np.add.at(observed, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            g = p.copy()
            np.put_along_axis(g, gold[:, :, None], np.take_along_axis(g, gold[:, :, None], 2) - 1, 2)
            by_word = np.stack([np.bincount(back.ravel(), g[:, :, c].ravel(), len(used)) for c in range(k)], 1) / batch
            touched, where = np.unique(feats, return_inverse=True)
            grad = np.stack([np.bincount(where, by_word[owner, c], len(touched)) for c in range(k)], 1)
            sum_w[touched] += grad**2
            out.weights[touched] -= rate * grad / np.sqrt(sum_w[touched])
            gt = (expected - observed) / batch
            sum_t += gt**2
            out.transitions -= rate * gt / np.sqrt(sum_t)
        return out


def spread(n: int, most: int, run: int = 24) -> list[tuple[int, int]]:
    """Bounds of runs of ``run`` words, evenly spread over n words, ``most`` words in all; all words where there are no more."""
    if n <= most:
        return [(0, n)]
    count = max(1, most // run)
    run = min(run, most)
    return [(b, b + run) for b in (k * (n - run) // max(1, count - 1) for k in range(count))]


def train(docs: DataFrame, learn: Column | None = None, sample: int = 400, max_words: int = 600, epochs: int = 3) -> Crf:
    """Fit on about ``sample`` texts at most of each lang that pass ``learn``, ``max_words`` words of each at most."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    known = known.filter(learn) if learn is not None else known
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(size)
    if not names:
        return Crf([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)))
    rates = F.create_map(*[F.lit(y) for x in names for y in (x, min(1.0, sample / size[x]))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    chosen = known.filter(unit < F.element_at(rates, F.col("lang"))).select("doc_id", "lang", "text")

    def run(batches):
        for batch in batches:
            for first, last, raw, offsets in textbuf.groups(batch.column(2)):
                buf, starts, lens, doc = letters.words(raw, offsets)
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                for k in range(last - first):
                    lo, hi = int(cut[k]), int(cut[k + 1])
                    some = [lo + j for b, c in spread(hi - lo, max_words) for j in range(b, c)]
                    words = [buf[starts[j] : starts[j] + lens[j]].tobytes().decode("utf-8", "replace") for j in some]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([batch.column(0)[first + k].as_py()], pa.int64()), "lang": [batch.column(1)[first + k].as_py()], "words": pa.array([words], pa.list_(pa.string()))})

    got = sorted(chosen.mapInArrow(textbuf.frugal(run), "doc_id long, lang string, words array<string>").collect(), key=lambda r: (r["doc_id"], r["lang"], r["words"]))
    return Crf.fit([list(r["words"]) for r in got], [r["lang"] for r in got], names, epochs)


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, lang, score, words): the language of every text and how many of its words each language has."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        crf = sent.value
        k = len(crf.labels)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for first, last, raw, offsets in textbuf.groups(batch.column(1)):
                n = last - first
                buf, starts, lens, doc = letters.words(raw, offsets)
                lang, score, split = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
                if len(starts) and k:
                    p = crf.marginals(crf.emissions(buf, starts, lens), doc)
                    count = np.bincount(doc, minlength=n)
                    mean = np.stack([np.bincount(doc, p[:, c], n) for c in range(k)], 1) / np.maximum(count, 1)[:, None]
                    best, own = mean.argmax(1), np.bincount(doc * k + p.argmax(1), minlength=n * k).reshape(n, k)
                    ascii_ = (buf[starts] < 128) | False
                    sure = np.bincount(doc, ascii_, n) > 0
                    for x in np.flatnonzero(count).tolist():
                        if sure[x] or any(map(str.isalpha, raw[offsets[x] : offsets[x + 1]].tobytes().decode("utf-8", "replace"))):
                            lang[x] = crf.labels[best[x]]
                            score[x] = min(1.0, mean[x, best[x]])
                            split[x] = [{"lang": crf.labels[c], "n": int(own[x, c])} for c in range(k) if own[x, c]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(lang), pa.array(score), pa.array(split, kind)], ["doc_id", "lang", "score", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textbuf.frugal(run), SCHEMA)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
