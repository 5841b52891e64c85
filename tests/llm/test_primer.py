"""The dictionary of the secret scan comes from all words of all texts."""

import random
import re
from collections import Counter

from flowmill.llm import secrets

NAME = "qzXvWjKpYgHtBnMcLdRfTsQw"  # like an identifier of machine-made code: foreseen only if it was met


def docs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n * 2))[:n]
    texts = [f"{prose(1200)} {NAME} {prose(4800)}" for _ in range(60)]  # between the places where a text was looked at before
    texts += ["same text with averyLongNameOfACopy and k3y0123456789abcdef"] * 3 + [None, "", "é", "averyLongNameOfACopy twice averyLongNameOfACopy"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), texts


def test_f5_words_of_whole_texts_are_counted(spark):
    df, texts = docs(spark)
    want = Counter()
    for t in [*texts]:
        want.update(w for w in set(re.split("[^A-Za-z0-9+/_=.-]+", t or "")) if 4 <= len(w) < 16)
    for t in {*texts}:
        want.update(w for w in set(re.split("[^A-Za-z0-9+/_=.-]+", t or "")) if len(w) >= 16 and not re.search("[0-9]", w))
    assert {r["word"]: r["n"] for r in secrets.word_counts(df).collect()} == want
    assert want[NAME] == 60 and want["averyLongNameOfACopy"] == 2 and want["same"] == 3


def test_f5_names_anywhere_in_the_texts_are_foreseen(spark):
    df, _ = docs(spark)
    dictionary = secrets.train_primer(df)
    assert dictionary == secrets.train_primer(df.repartition(7)) and b"k3y0123456789abcdef" not in dictionary
    assert secrets.spans(f"the bearer {NAME} is in use", dictionary) == []
    other = "HwTgQzYcXkVnJpWdMrBsLfKt"
    assert secrets.spans(f"the bearer {other} is in use", dictionary) == [("novel", 11, 11 + len(other))]


def test_f6_redaction_in_the_pipeline_foresees_the_same_names(spark):
    import corpus_pipeline

    df, _ = docs(spark)
    text = f"the bearer {NAME} is in use"
    more = spark.createDataFrame([(1000, text)], df.schema)
    rows = df.unionByName(more).selectExpr("*", "length(text) AS n_chars")
    assert corpus_pipeline.secrets_stage(spark, rows, "").filter("doc_id = 1000").collect()[0]["text"] == text


def test_f6_words_behind_the_first_fetched_fill_the_room_left(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=30)) for _ in range(secrets.WORDS + 500)] + ["qrst", "rstu", "stuv", "tuvw", "x" * secrets.WORD_BYTES]
    texts = [" ".join(words[k : k + 500]) + end for end in ("", "!") for k in range(0, len(words), 500)]
    kept, size = [], 0
    for word in sorted({*words}, key=lambda w: (-len(w), w)):  # all are in two texts
        if size + len(word) < secrets.WORD_BYTES:
            kept.append(word)
            size += len(word) + 1
    assert kept[-3:] == ["qrst", "rstu", "stuv"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert secrets.train_primer(df).endswith("".join(f" {w}" for w in reversed(kept)).encode())
