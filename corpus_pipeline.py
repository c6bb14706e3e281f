"""The corpus pipeline: quality, toxicity, near duplicates, personal data, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, packing, pii, quality, toxicity
from tessera.llm.common import discard, shared_folder, table

QUALITY_THRESHOLD = 0.5
TOXICITY_THRESHOLD = 0.3


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model, threshold=QUALITY_THRESHOLD)


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_mild(docs, model, threshold=TOXICITY_THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, words=5, similarity=(4, 5)).select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, tokenizer = (public_tokenizers.path(f"byte_bpe_50k.{end}") for end in ("tiktoken", "json"))
    return packing.pack_documents(docs, ranks_path=ranks, pattern=public_tokenizers.PATTERN, tokenizer_path=tokenizer)


STAGES = [
    ("quality", filter_quality),
    ("toxicity", filter_toxicity),
    ("near duplicates", drop_near_duplicates),
    ("personal data", redact_personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again, and goes once the next is written."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
