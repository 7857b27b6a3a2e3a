"""A corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, decontaminate, minhash, quality, secrets
from lattica.llm.common import shared_dir
from lattica.llm.queries import pattern, tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.filter_docs(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates."""
    return minhash.keep_one(docs, 85)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern(), ["doc_id", "lang", "source"])


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("decontamination", decontamination), ("secrets", secret_scan), ("tokens", tokens)]

#: The stages' methods (registers, models, encodings) can't be said in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
