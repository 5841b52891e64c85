import random

import numpy as np
import public_tokenizers
import pytest
from flowmill.llm import editcount, encoder, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "word", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "22", "!", "#", "漢", " x", "\x85", " ", "<|endoftext|>", "<|endo", "ftext|>"]


@pytest.fixture(scope="module")
def recount():
    library = Tokenizer.from_file(VOCABULARY)
    return lambda text: len(library.encode(text, add_special_tokens=False).ids)


def trees(texts, e):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    chars, ids, bound = editcount.leaves(np.frombuffer(b"".join(raw), np.uint8), offsets, e)
    return [editcount.SegmentTree(t, chars[a:b].tolist(), ids[a:b].tolist()) for t, a, b in zip(texts, bound[:-1], bound[1:], strict=True)]


def test_tree_equals_a_full_recount_after_every_edit(recount):
    rng, e = random.Random(4), encoder.Encoder(VOCABULARY)
    plain = [x for x in PARTS if x.isascii()]
    texts = ["", "one two", "x" * 500] + ["".join(rng.choices(plain if k % 2 else PARTS, k=rng.randint(1, 2500))) for k in range(25)]
    for group in (texts, [t for k, t in enumerate(texts) if k % 2 or k < 3]):
        now, some = list(group), trees(group, e)
        for t, text in zip(some, now, strict=True):
            assert t.text() == text and t.n_ids == recount(text) and t.n_chars == len(text)
        for _ in range(8):
            edits = [(rng.randint(0, len(t) + 2), rng.randint(0, 60), "".join(rng.choices(PARTS, k=rng.randint(0, 5)))) if rng.random() < 0.9 else None for t in now]
            editcount.edit(some, edits, e)
            for k, x in enumerate(edits):
                if x:
                    p = min(x[0], len(now[k]))
                    now[k] = now[k][:p] + x[2] + now[k][p + x[1] :]
            for t, text in zip(some, now, strict=True):
                assert t.text() == text and t.n_ids == recount(text) and t.n_chars == len(text)
                again = editcount.SegmentTree(text, *t.stored())
                assert again.n_ids == t.n_ids and [again.piece(k) for k in range(again.size)] == [x for x in map(t.piece, range(t.size)) if x] + [""] * (again.size - len(t.stored()[0]))


def test_a_long_text_is_reencoded_only_near_its_edits():
    e = encoder.Encoder(VOCABULARY)
    (tree,) = trees(["some words here " * 20_000], e)
    assert editcount.edit([tree], [(160_000, 3, "new")], e)[0] < 2000 and tree.nodes <= 40


def test_many_edits_at_one_place_stay_cheap(recount):
    e = encoder.Encoder(VOCABULARY)
    text = "some words here " * 2000
    (tree,) = trees([text], e)
    spent = []
    for k in range(60):
        new = f" and {k} more words were put in at this very place, again and again, until it grows" * 3
        spent += editcount.edit([tree], [(16_000, 0, new)], e)
        text = text[:16_000] + new + text[16_000:]
    assert max(spent) <= editcount.MOST + 3 * len(new) and sum(spent[-20:]) <= 2 * sum(spent[:20])
    assert tree.text() == text and tree.n_ids == recount(text) and max(n for _, n, _ in tree.leaves) <= 2 * editcount.MOST


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (None, "q", "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, n_tokens string")
    got = editcount.count_edits(docs, editcount.sample_edits(F.col("doc_id"), F.col("text")), VOCABULARY).collect()
    assert len(got) == 5 and got[0] == got[1]
    assert editcount.count_edits(docs.limit(0), F.lit(None), VOCABULARY).count() == 0
    none = editcount.count_edits(docs, F.lit(None), VOCABULARY).collect()
    assert all(r["n_tokens"] == r["n_tokens_before"] and r["n_reencoded"] == 0 for r in none)


def test_kept_trees_take_edit_after_edit(spark, recount):
    rng = random.Random(5)
    texts = {k: "".join(rng.choices(PARTS, k=rng.randint(0, 1500))) for k in range(30)}
    stored = editcount.build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), VOCABULARY)
    for salt in range(3):
        edit = F.array(F.struct((F.col("doc_id") * 37 + salt * 11).alias("pos"), F.lit(5).alias("n_deleted"), F.lit(f" é {salt}").alias("inserted")))
        stored = spark.createDataFrame(editcount.apply_edits(stored, edit, VOCABULARY, keep=True).toPandas(), f"{editcount.COUNT_SCHEMA}, text string, leaf_chars array<int>, leaf_ids array<int>")
        for k, t in texts.items():
            p = min(k * 37 + salt * 11, len(t))
            texts[k] = t[:p] + f" é {salt}" + t[p + 5 :]
        for r in stored.collect():
            assert r["text"] == texts[r["doc_id"]] and r["n_tokens"] == recount(r["text"]) == sum(r["leaf_ids"]) and sum(r["leaf_chars"]) == len(r["text"])


def test_query_equals_a_recount_of_the_edited_texts(spark, recount):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wanted = docs.select("doc_id", "text", editcount.sample_edits(F.col("doc_id"), F.col("text")).alias("edits")).collect()
    got = {r["doc_id"]: r for r in queries.op10_edit_counts(spark, SF).collect()}
    assert len(got) == len(wanted)
    for r in wanted:
        text = r["text"] or ""
        assert got[r["doc_id"]]["n_tokens_before"] == recount(text)
        for e in r["edits"]:
            p = min(e["pos"], len(text))
            text = text[:p] + e["inserted"] + text[p + e["n_deleted"] :]
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_chars"]) == (recount(text), len(text))
