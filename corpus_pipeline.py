"""The training-data pipeline: quality rules, near-duplicate removal, decontamination, secret redaction, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again as the
next stage's docs. All stages but the last return the columns of documents.

A null or empty text fails the quality rules and goes. Repeated rows are copies, of which one stays; null ids are ids like
any other, and rows with one id are judged by their texts. Very long texts are read whole in every stage. Further columns,
whatever their names, stay as they are up to the last stage, which drops them. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, jaccard, quality, secret_scan
from tessera.llm.common import save, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (80 % of 5-word shingles in common) the document with the smallest id."""
    return jaccard.keep_one(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secret_scan.redact_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, text): ids of each document, and the text decoded from them."""
    return bpe.encode(docs).withColumnRenamed("decoded", "text")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding", bpe_encoding),
]

#: Networks, components and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES one after the other over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = save(stage(spark, docs, sf_dir), name)
    return docs
