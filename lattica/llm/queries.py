"""The queries of these operators over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, countjoin, decontaminate, divergence, minhash, prefixtrie, quality, secrets, sharding, tokencount, tokenfile, toxicity, warc


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; TOKENIZER_DIR overrides the installed one."""
    if own := os.environ.get("TOKENIZER_DIR"):
        return f"{own}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), pattern())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "bad_chunks")
    return quality.score(_table(spark, sf_dir, "documents")).select(*names)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(_table(spark, sf_dir, "documents"), ["doc_id"]))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 85)


def edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document that its id decides: a replacement, an insertion and a deletion."""
    place = lambda k: F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(k)), F.coalesce(F.length("text"), F.lit(0)) + 1)
    word = F.concat(F.lit(" edit"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(997)).cast("string"))
    one = lambda at, gone, new: F.struct(at.cast("long").alias("at"), F.lit(gone).cast("long").alias("deleted"), new.cast("string").alias("inserted"))
    return docs.withColumn("edits", F.array(one(place(1), 5, word), one(place(2), 0, F.lit("x")), one(place(3), 40, F.lit(""))))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edits(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = tokencount.count_edited(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern())
    return out.select("doc_id", "n_tokens", "n_tokens_edited", "n_bytes_edited", "n_bytes_encoded", F.element_at("tree", 1).alias("root_tokens"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countjoin.joined(_table(spark, sf_dir, "documents"), 85)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.build(_table(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_shards, op3_bpe, op4_warc, op5_toxicity, op6_quality, op7_token_file, op8_secrets, op9_near_duplicates, op10_token_counts, op11_ngram_join, op12_prefix_trie, op13_divergence, pipeline)}
