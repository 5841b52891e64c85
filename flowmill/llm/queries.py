"""The registered queries of the training-data operators: thin digests over each operator's real output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import decontaminate, editcount, langid, neardup, oracles, packing, quality, secrets, tokenfile, toxicity, warczip

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path(BYTE_VOCABULARY)
    entries = tokenfile.token_ids(spark, table(spark, sf_dir, "documents"), path)
    return entries.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"), "shard")


def op5_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path(WORD_VOCABULARY)
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.passage_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return hits.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warczip.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _of_kind(kind: str) -> Column:
    return F.filter("spans", lambda x: x["kind"] == kind)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select("doc_id", *(F.size(_of_kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    found = langid.predict(docs, langid.train(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op10_edit_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path(BYTE_VOCABULARY)
    docs = table(spark, sf_dir, "documents")
    return editcount.count_edits(docs, editcount.sample_edits(F.col("doc_id"), F.col("text")), path)


QUERIES = {
    "op1_token_ids": op1_token_ids,
    "op2_decontamination": op2_decontamination,
    "op3_warc_zip": op3_warc_zip,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_secrets": op8_secrets,
    "op9_language": op9_language,
    "op10_edit_counts": op10_edit_counts,
}
ORACLES: dict[str, str] = {"op2_decontamination": oracles.OP2, "op3_warc_zip": oracles.OP3, "op4_quality_rules": oracles.OP4, "op7_near_duplicates": oracles.OP7}
