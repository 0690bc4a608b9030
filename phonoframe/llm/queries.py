"""The corpus operators applied to the driver's tables, each to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_level, exact_dedup, language, licenses, manifest, negatives, packing, quality, repeats, simhash, urls
from .common import documents

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(vectors.withColumn("label", moved))


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = byte_level.round_trip(documents(spark, sf_dir), public_tokenizers.path(RANKS), pattern=public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.lowered(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_pack, op3_url_filter, op4_simhash, op5_license_scan, op6_token_counts, op7_suffix_dedup, op8_language_id, op9_quality_rules, op10_bpe_round_trip, op11_hard_negatives, op12_byte_level_bpe, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
              count(*) over (partition by coalesce(text, '')) as group_size,
              doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
              sha256(coalesce(text, '')) as text_sha256
            from documents""",
        "op3_url_filter": urls.oracle(),
        "op13_merkle_manifest": manifest.oracle(),
        "op11_hard_negatives": negatives.oracle(),
    }
