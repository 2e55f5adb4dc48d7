"""The queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import codebooks, decontaminate, fingerprint, licenses, linededup, mixing, neardup, packing, pii, resampling, sharding, tokens, toxicity
from .common import scratch_root, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    map_path = f"{scratch_root(spark)}/loomgraph/slot_maps/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    return sharding.shard_documents(table(spark, sf_dir, "documents"), map_path=map_path)


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op12_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_tokens": op2_tokens,
    "op3_pii": op3_pii,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_licenses": op9_licenses,
    "op10_toxicity": op10_toxicity,
    "op11_mixing": op11_mixing,
    "op12_codebooks": op12_codebooks,
    "op13_resampling": op13_resampling,
}
