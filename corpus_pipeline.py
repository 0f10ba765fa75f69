"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

1. quality: learned decision list and base rules; documents that they reject go.
2. near_duplicates: groups of texts at least 0.8 alike in 5-word shingles; the document with the smallest id of each group stays.
3. decontaminate: documents that leak a benchmark item go.
4. pii: personal data in the texts gives way to [EMAIL] and so on; n_chars follows.
5. packing: the texts become token pieces in packed sequences.

All stages but the last return the columns of documents. Each handles nulls, empty and repeated rows, empty tables and
clashing columns as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinlink.llm import decontaminate, packing, pii, quality, simhash
from kinlink.llm.common import scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, size=5, similarity=0.8)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs, length="n_chars" if "n_chars" in docs.columns else None)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.with_digests(packing.pack_documents(docs, keep=1 << 17))  # workers have served the stages before, so less memory for known words


STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontaminate", keep_clean), ("pii", mask_personal), ("packing", pack)]

# Fingerprints, tokens and the learned rules are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark, name)}/t"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
