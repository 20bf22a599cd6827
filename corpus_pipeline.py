"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from neumata.llm import common, ngram_join, packing, pii, quality_rules, toxicity
from neumata.llm.queries import table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the one with the smallest id) of each group of near duplicates: 80 % of their shingles of five words in common."""
    return ngram_join.keep_one(docs, width=5, threshold=80)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", good), ("toxicity", harmless), ("n-gram Jaccard join", single), ("PII", redacted), ("packing", packed)]
#: The fitted stages have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What is between them goes to the folder that all executors share.

    Each run has a folder of its own, so one that is started again reads nothing of an earlier one; a stage's folder goes
    when the next one is written, the last one stays for the result.
    """
    docs, at = table(spark, sf_dir, "documents"), f"{common.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}")
            docs = spark.read.parquet(f"{at}/{k}")
            if k:
                common.delete(spark, f"{at}/{k - 1}")
    return docs
