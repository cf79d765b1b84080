"""The numbered corpus queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairn.llm import clustering, edit_embedding, exact_dedup, langid, merkle, mixing, ngram_join, packing, quality, secrets, substring_dedup, tokencount, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.train_profiles(docs.where(~langid.is_held_out()).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), profiles).select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_zip.archive_round_trip(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_positions(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.edit_fingerprints(_table(spark, sf_dir, "documents"))


def edit_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The banding and verification of operator 9: near copies by edit distance."""
    return edit_embedding.edit_groups(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(_table(spark, sf_dir, "documents"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.kmeans(_table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_pack_documents, op2_language_id, op3_token_counts, op4_quality, op5_warc_zip, op6_ngram_jaccard, op7_mix_sources, op8_exact_dedup, op9_edit_fingerprints, op10_secret_scan, op11_merkle_manifest, op12_centroid_clusters, op13_substring_dedup, edit_groups)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_ngram_jaccard": ngram_join.ORACLE_SQL,
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op12_centroid_clusters": clustering.oracle_sql(),
        "op13_substring_dedup": substring_dedup.ORACLE_SQL,
    }
