"""Registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlens.llm import chat, decontaminate, gam, licenses, lm, minhash, mixing, nearest, secrets, spelling, tokens, trees, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near-duplicates over sets of 3-word shingles, similarity 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, share=(85, 100), bands=25, rows=5)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix with source weights 3, 1, 2 takes of each document."""
    docs = table(spark, sf_dir, "documents")
    new = mixing.names(docs)
    return mixing.drawn(docs).select(
        "doc_id", F.col(new["size"]).alias("size"), F.col(new["source_size"]).alias("source_size"), F.col(new["target"]).alias("target"),
        (F.col(new["size"]) * F.size(new["draws"])).alias("taken"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations without snapshots of longer ones, rendered with chat markers."""
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the best window of each."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "start", "similarity")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: fixed patterns and strings of few characters per token."""
    return secrets.scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a generalised additive model."""
    docs = table(spark, sf_dir, "documents")
    return gam.scores(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a unigram and by a maximum-entropy model."""
    return lm.scores(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules: base counts and the verdict of boosted trees."""
    docs = table(spark, sf_dir, "documents")
    return trees.verdicts(docs, trees.train(docs, table(spark, sf_dir, "labels")))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as Re-Pair blocks and read back."""
    return tokens.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in all documents: a row per match."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the first 32 components of their covariance, scaled to variance one."""
    return whiten.whitened(table(spark, sf_dir, "embeddings"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50."""
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent word that each is a spelling of."""
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_dedup, op2_mix_sources, op3_chat_format, op4_decontaminate, op5_secrets, op6_quality_gam, op7_lm_score, op8_quality_rules, op9_token_ids,
    op10_licenses, op11_whiten, op12_nearest, op13_spelling)}
