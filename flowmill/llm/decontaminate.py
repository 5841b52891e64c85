"""Distributed positional inverted index for benchmark passages.

Corpus counts of the test terms give the rarest terms of every window of an item.  One pass over the documents stores
the postings of those probe terms (document, position, the words around) and each document's length.  Postings are
shifted by the term's offset in the item, so all postings of one occurrence meet at one start; a window is a candidate
where the shifted lists of its two rarest terms intersect, and a match where the words around spell it.  Only built-in
expressions and joins; the probe table is broadcast while its counted size is small and joined by a shuffle beyond.

Rows: null or wordless texts have no words, no hits and no windows; a null doc_id is a document like any other; rows
of one doc_id are matched by their own text; repeated items each count; empty tables on either side give no hits;
other columns are ignored.  Contamination is by whole windows only, never by single words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmill.llm import storage

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of terms with at most so many rows is broadcast.
SMALL_ROWS = 200_000
LENGTH_TERM = ""
#: Tasks that a frequent term is dealt over where words are shuffled.
SALTS = 16


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; other letters as they are."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.filter(F.split(low, BETWEEN_WORDS), lambda x: x != "")


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences of each of ``terms`` (term) in all of docs."""
    each = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    counted = each.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    if terms.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        counted = each.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """(doc_id, text_key, term, pos, first, near): every occurrence of ``terms``, and under LENGTH_TERM one row a document
    with its number of words as pos.  near: the words from position ``first`` to ``around`` words past pos.

    Beyond SMALL_ROWS terms the words meet them by a shuffle of (document, position, term), dealt by term and position so
    that a frequent term has many tasks; only what is found goes back to its document, where the words around are taken."""
    probe = terms.select("term").distinct()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), words_of(F.col("text")).alias("words"))
    first = F.greatest(F.col("pos") - around, F.lit(0))
    near = F.when(F.col("term") != LENGTH_TERM, F.slice("words", F.col("first") + 1, F.col("pos") - F.col("first") + 1 + around))
    if probe.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        probe = F.broadcast(probe.unionByName(terms.sparkSession.range(1).select(F.lit(LENGTH_TERM).alias("term"))))
        found = d.select("*", F.posexplode(F.concat("words", F.array(F.lit(LENGTH_TERM)))).alias("pos", "term")).join(probe, "term")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        each = d.select("doc_id", "text_key", F.posexplode("words").alias("pos", "term")).withColumn("salt", F.col("pos") % SALTS)
        hits = each.join(probe.select("term", salt), ["term", "salt"]).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "term")).alias("hits"))
        hits = hits.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
        back = d.join(hits, d["doc_id"].eqNullSafe(hits["_id"]) & (d["text_key"] == hits["_key"]), "left")
        end = F.array(F.struct(F.size("words").alias("pos"), F.lit(LENGTH_TERM).alias("term")))
        found = back.select("doc_id", "text_key", "words", F.explode(F.concat(F.coalesce("hits", F.array().cast("array<struct<pos: int, term: string>>")), end)).alias("h"))
        found = found.select("doc_id", "text_key", "words", "h.term", "h.pos")
    return found.withColumn("first", first).withColumn("near", near).select("doc_id", "text_key", "term", "pos", "first", "near")


def passages(benchmark: DataFrame, window: int) -> DataFrame:
    """(passage, items, words): distinct word sequences of the items, named by 128 bits of the words themselves (a word
    holds no space)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    return rows.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("passage", F.unhex(F.md5(F.array_join("words", " "))))


def _windows(p: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """p with windows: array of (o, size, p1, p2), offsets of the window and of its two rarest words; windows with a
    word that the corpus lacks are left out."""
    each = p.select("passage", F.posexplode("words").alias("offset", "term")).join(counts, "term")
    ranks = each.groupBy("passage").agg(F.array_sort(F.collect_list(F.struct("offset", "n"))).alias("ranks"))
    size = F.least(F.lit(window), F.size("ranks"))

    def of(o: Column) -> Column:
        rare = F.array_sort(F.transform(F.slice("ranks", o + 1, size), lambda x: F.struct(x["n"].alias("n"), x["offset"].alias("offset"))))
        second = F.coalesce(F.get(rare, F.lit(1)), F.get(rare, F.lit(0)))
        return F.struct(o.alias("o"), size.alias("size"), F.get(rare, F.lit(0))["offset"].alias("p1"), second["offset"].alias("p2"), F.get(rare, F.lit(0))["n"].alias("least"))

    windows = F.filter(F.transform(F.sequence(F.lit(0), F.size("ranks") - size), of), lambda w: w["least"] > 0)
    return p.join(ranks.select("passage", windows.alias("windows")), "passage").filter(F.size("windows") > 0)


def passage_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row a document: doc_id, text_key, n_words, hits (positions of hit words), items (ids of items hit)."""
    p = passages(benchmark, window)
    terms = p.select(F.explode("words").alias("term")).distinct()
    with storage.scratch(docs.sparkSession) as tables:
        listed = storage.materialize(_windows(p, storage.materialize(term_counts(docs, terms), "terms"), window), "passages")
        tables.keep(listed)
    offsets = F.array_distinct(F.flatten(F.transform("windows", lambda w: F.array(w["p1"], w["p2"]))))
    places = listed.select("passage", F.explode(offsets).alias("offset"), "words").select("passage", "offset", F.get("words", F.col("offset")).alias("term"))
    index = storage.materialize(postings(docs, places.select("term").distinct(), window - 1), "postings")

    shifted = (
        index.join(_sized(places), "term")
        .withColumn("start", F.col("pos") - F.col("offset"))
        .groupBy("doc_id", "text_key", "passage", "start")
        .agg(F.collect_set("offset").alias("offsets"), F.collect_list(F.struct("offset", "first", "near")).alias("near"))
    )

    def matched(w: Column) -> Column:
        view = F.get(F.filter("near", lambda x: x["offset"] == w["p1"]), F.lit(0))
        here = F.slice(view["near"], F.greatest(F.col("start") + w["o"] - view["first"] + 1, F.lit(1)), w["size"])
        return F.array_contains("offsets", w["p1"]) & F.array_contains("offsets", w["p2"]) & (F.col("start") + w["o"] >= view["first"]) & (here == F.slice("words", w["o"] + 1, w["size"]))

    hit = (
        shifted.join(_sized(listed), "passage")
        .withColumn("found", F.filter("windows", matched))
        .filter(F.size("found") > 0)
        .withColumn("hits", F.array_distinct(F.flatten(F.transform("found", lambda w: F.sequence(F.col("start") + w["o"], F.col("start") + w["o"] + w["size"] - 1)))))
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    )
    every = index.filter(F.col("term") == LENGTH_TERM).select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))
    hit = hit.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    both = every.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    return both.select("doc_id", "text_key", "n_words", F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, that no window of an item occurs in."""
    hit = passage_hits(docs, benchmark, window).filter(F.size("hits") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    key = F.xxhash64(docs["text"].cast("string"))
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["_id"]) & (key == hit["_key"]), "left_anti")


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """(doc_id, text_key, pos): positions of the rarest of ``terms`` that have all the others at most ``within`` words away.

    index: as of ``postings``, with those terms.  A document's lists meet in one row; nothing else is grouped."""
    terms = list(dict.fromkeys(terms))
    lists = index.filter(F.col("term").isin(terms)).groupBy("doc_id", "text_key", "term").agg(F.array_sort(F.collect_list("pos")).alias("list"))
    docs = lists.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct(F.size("list").alias("n"), "term", "list"))).alias("lists")).filter(F.size("lists") == len(terms))
    rest = F.slice("lists", 2, max(1, len(terms)))
    near = F.filter(F.get("lists", F.lit(0))["list"], lambda p: F.forall(rest, lambda other: F.exists(other["list"], lambda q: F.abs(q - p) <= within)))
    return docs.select("doc_id", "text_key", F.explode(near).alias("pos"))
