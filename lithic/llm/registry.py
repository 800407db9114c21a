"""The ``opN_*`` queries: each operator with production settings on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint_iblt, language_ppm, license_minhash, pii_feistel, piece_encoding, simhash_vptree, source_mixing, suffix_dedup, topk_bitsliced, toxicity_kneser_ney


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Key of the registered queries; a real run takes its own from a secret store.
PII_KEY = "demonstration key"


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity_kneser_ney.train_toxicity(docs, labels)
    return toxicity_kneser_ney.score_toxicity(docs, model).select(
        "doc_id",
        language_ppm.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity_kneser_ney.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.simhash_groups(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_ppm.train_language_model(docs)
    return language_ppm.identify(docs, model).select("doc_id", language_ppm.held_out().alias("held_out"), "lang_pred", "score")


def op6_topk_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_minhash.scan_licenses(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_iblt.fingerprint_versions(table(spark, sf_dir, "documents"), fine=True)


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_digests(table(spark, sf_dir, "documents"), piece_model_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_source_mixing": op1_source_mixing,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_language_id": op5_language_id,
        "op6_topk_bitsliced": op6_topk_bitsliced,
        "op7_pii_pseudonyms": op7_pii_pseudonyms,
        "op8_license_scans": op8_license_scans,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": source_mixing.MIX_SQL,
        "op6_topk_bitsliced": topk_bitsliced.TOP_K_SQL,
    }
