"""Registered queries of the corpus operators: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import scratch
from . import chat, decontaminate, exact_dedup, license_scan, line_dedup, mixing, quality, secret_scan, sharding, simhash
from .tables import table

SMALL_SHARDS = sharding.ShardConfig(limit=64 << 10)
Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def sharding_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory itself, for shards so small that every table has many."""
    return sharding.directory(table(spark, sf_dir, "documents"), SMALL_SHARDS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_in_parts(table(spark, sf_dir, "documents"), scratch(spark, "lines"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).drop("content", "content2")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample_list(table(spark, sf_dir, "documents"), mixing.ROOT)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_license_scan,
            op2_extendible_sharding,
            op3_line_dedup,
            op4_chat_formatting,
            op5_simhash_near_dedup,
            op6_mixing,
            op7_quality_classifier,
            op8_decontamination,
            op9_secret_scan,
            op10_exact_dedup,
            sharding_directory,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_extendible_sharding": sharding.shard_sql(),
        "sharding_directory": sharding.directory_sql(config=SMALL_SHARDS),
        "op3_line_dedup": line_dedup.line_sql(),
        "op4_chat_formatting": chat.chat_sql(),
        "op6_mixing": mixing.mix_sql(weights=mixing.ROOT),
        "op9_secret_scan": secret_scan.secret_sql(),
        "op10_exact_dedup": exact_dedup.exact_sql(),
    }
