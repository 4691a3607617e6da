"""A training corpus from the documents table: quality rules, near-dedup, decontamination, redaction, tokens.

Each stage is a function of ``(spark, docs, sf_dir)``. A stage's result is written as Parquet to the shared folder and
read again as the next one's documents, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgelens.llm import bpe, decontam, pii, quality, simhash
from pledgelens.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the tokeniser bands reject go."""
    return quality.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of three words, fingerprints within three bits."""
    return simhash.deduplicated(docs)


def _measured(docs: DataFrame) -> DataFrame:
    """Documents whose texts were cut have the length of what is left."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are half or more of such passages go."""
    return _measured(decontam.decontaminated(docs, table(spark, sf_dir, "benchmark")))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return _measured(pii.redacted(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole texts, and the text that they decode to."""
    return bpe.decode(bpe.encode(docs.drop("n_chars"), outputs=("n_tokens", "ids")), into="text")


STAGES = [
    ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("tokens", tokens),
]

#: SQL can express neither the fingerprints nor the tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
