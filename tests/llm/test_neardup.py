import random

import numpy as np
import pytest
from flowmill.llm import components, neardup, setsketch

import corpus_pipeline


def sets_of(text, words):
    w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "").split()
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, words, percent):
    sets = [sets_of(t, words) for _, t in rows]
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                head[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted((d is None, d or 0, len(s), ids.get(root(i), -1) if s else (d if d is not None else -1)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(rng, groups=12, spread=14):
    rows = [(None, "no id here at all"), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "two  words"), (8, "é É é É")]
    k = 10
    for _ in range(groups):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 4) + str(rng.randint(0, 60)) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.randint(1, spread)):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 999)}"
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows + rows[:5]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, words, percent):
    rows = corpus(random.Random(words))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    got = neardup.near_duplicates(df, words, percent).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute(rows, words, percent)
    kept = neardup.keep_one(df, words, percent)
    assert kept.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len([1 for _, t in left if sets_of(t, words)]) == len({x["group"] for x in got if x["group"] is not None})


def test_near_copies_without_an_id_are_linked(spark):
    rng = random.Random(6)
    rows = [(None if rng.random() < 0.4 else d, t) for d, t in corpus(rng, 8)]
    base = [f"w{i}" for i in range(90)]
    rows += [(None, " ".join([*base, f"end{i}"])) for i in (0, 1, 2, 2)]  # a group without any id
    rows += [(900, " ".join(base[::-1])), (None, " ".join([*base[::-1], "end"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, 3, 85).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got) == brute(rows, 3, 85)
    left = [(r["doc_id"], r["text"]) for r in neardup.keep_one(df, 3, 85).collect()]
    assert len([1 for _, t in left if (t or "").startswith("w0 ")]) == 1
    assert [d for d, t in left if (t or "").startswith("w89 ")] == [900]


def test_members_of_a_bucket_that_the_leader_misses_are_still_linked(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng, rows = random.Random(5), []
    base = [f"w{i}" for i in range(200)]
    for k in range(60):  # a chain: neighbours agree, ends do not
        base[rng.randrange(200)] = f"n{k}"
        base[rng.randrange(200)] = f"m{k}"
        rows.append((k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, 3, 85).collect()
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 3, 85)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(df).count() == 0 and neardup.keep_one(df).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    x, y = pool[:2000], pool[400:2400]
    s = setsketch.sketch(np.concatenate([x, y]), np.array([0, 2000]))
    union = setsketch.sketch(pool[:2400], np.array([0]))
    assert (setsketch.merge(s[0], s[1]) == union[0]).all()
    j = setsketch.similarity(s[:1], s[1:], np.array([2000]), np.array([2000]))[0]
    assert abs(j - 1600 / 2400) < 0.2


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice("bcdfgl") + rng.choice("aeiou") + rng.choice("nrst") + str(rng.randint(0, 99))
    good = " ".join(word() for _ in range(120))
    leaked = " ".join(word() for _ in range(60))
    item = " ".join(leaked.split()[20:35])
    secret = good[::-1] + ' token = "0123456789abcdef0123456789abcdef01234567" end'
    rows = [(1, good), (2, good), (3, leaked), (4, secret), (5, "short"), (6, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
        left.append(sorted(r["doc_id"] for r in docs.collect()))
    assert left == [[1, 2, 3, 4], [1, 3, 4], [1, 4], [1, 4]]
    clean = {r["doc_id"]: r for r in docs.collect()}
    assert clean[1]["text"] == good and "[SECRET]" in clean[4]["text"] and clean[4]["n_chars"] == len(clean[4]["text"])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {1, 4}


def test_stages_with_clashing_columns(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    names = "doc_id long, text string, lang string, source string, n_chars long, bits string, kept string, _id long, _key long, n_words string"
    docs = spark.createDataFrame([(1, text, "en", "s", 5, "b", "k", 7, 8, "w"), (2, text + " end", "en", "s", 5, "b", "k", 7, 8, "w"), (2, text + " end", "en", "s", 5, "b", "k", 7, 8, "w"), (None, text[::-1], None, None, None, None, None, None, None, None), (None, text[::-1], None, None, None, None, None, None, None, None)], names)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [x.split()[0] for x in names.split(", ")], name
    got = sorted(docs.collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["doc_id"], r["bits"], r["_id"], r["n_words"]) for r in got] == [(None, None, None, None), (1, "b", 7, "w")]


def test_pipeline_equals_brute_force(spark):
    """Every stage in plain Python over the smallest documents, by the same rules."""
    import re

    import public_tokenizers
    from flowmill.llm import secrets
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    left = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def good(text):
        w = split(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 5000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
        repeated = len({i + k for i, g in enumerate(grams) if g in often for k in range(3)})
        lines = [x for x in (text or "").split("\n") if split(x)]
        chars = sum(map(len, w))
        return not (len(w) < 50 or 100 * repeated > 50 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 10 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or 10 * chars < 25 * len(w) or chars > 12 * len(w))

    left = {d: t for d, t in left.items() if good(t)}
    found = brute(list(left.items()), corpus_pipeline.WORDS, corpus_pipeline.PERCENT)
    left = {d: left[d] for _, d, _, head in found if d == head}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    left = {d: t for d, t in left.items() if not any(tuple(w[i : i + n]) in windows for w in [words(t)] for n in sizes for i in range(len(w) - n + 1))}
    docs = spark.createDataFrame(list(left.items()), "doc_id long, text string")
    dictionary = secrets.train_primer(docs)
    left = {d: secrets.redacted(t, dictionary=dictionary) for d, t in left.items()}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    got = {}
    for r in corpus_pipeline.run(spark, sf).withColumn("n", F.col("doc_tokens")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["n"]))
    assert set(got) == set(left) and len(left) > 20
    for d, pieces in got.items():
        n = len(library.encode(left[d], add_special_tokens=False).ids) + 1
        assert sum(x[1] for x in pieces) == n == pieces[0][2] and sorted(x[0] for x in pieces)[0] == 0
