"""The corpus pipeline: quality rules, near-duplicates, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet to the shared folder and
rereads as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.llm import decontaminate, neardup, packing, quality, secrets, storage

VOCABULARY = "word_bpe_49k.json"
#: Near-duplicates in the pipeline: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")  # columns named like a measurement stay whole
    return quality.apply_policy(quality.ledger(rows)).filter("kept").select("row.*")


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest doc_id, the first row of equal ids."""
    return neardup.keep_one(docs, WORDS, PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    pieces = packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with storage.scratch(spark) as tables:  # a stage's own tables end with it
            docs = storage.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.keep(docs)
        if before is not None:
            storage.release(before)
        before = docs
    return docs


ORACLE_SQL = None
