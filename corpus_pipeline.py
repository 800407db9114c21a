"""The corpus pipeline: five operators, each working on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lithic.llm import language_ppm, pii_feistel, piece_encoding, registry, simhash_vptree, source_mixing
from lithic.llm.scratch import discard, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; texts without a letter, and those no language explains, go."""
    return language_ppm.accepted(docs, language_ppm.train_language_model(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group."""
    return simhash_vptree.keep_representatives(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by format-preserving pseudonyms."""
    return pii_feistel.pseudonymize(docs, registry.PII_KEY)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, and shuffled."""
    return source_mixing.mix_sources(docs).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    # workers still hold what the stages before left behind, so they remember fewer words
    return piece_encoding.encode_digests(docs, registry.piece_model_path(), memory=400_000)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_pseudonyms", pii_pseudonyms),
    ("source_weights", source_weights),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express language models, SimHash groups, Feistel networks and piece encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:  # written and read no more
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
