"""The operators' registered queries, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from carecohort.llm import (
    cover_codes, decontaminate, fingerprint, language, licenses, line_dedup, mixing, near_dup, secrets, sharding, tokens,
    warc, whitening,
)
from carecohort.llm.common import table
from carecohort.storage import shared_folder

SHARDS = 40


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(tokens.TOKENIZER)
    return tokens.token_documents(table(spark, sf_dir, "documents"), _new_folder(spark, "tokens"), path)


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op6_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def op7_hamming_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, share=85)


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_widespread_lines(table(spark, sf_dir, "documents"))


def op9_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_positions(table(spark, sf_dir, "documents"))


def op10_one_permutation_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op11_cover_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_codes.coded_vectors(table(spark, sf_dir, "embeddings"))


def op12_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"), _new_folder(spark, "warc"))


def op13_cholesky_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (
        op1_token_files, op2_license_rules, op3_secret_forest, op4_wu_manber, op5_rendezvous_shards,
        op6_string_kernel_language, op7_hamming_near_dup, op8_line_spread, op9_pfair_mix,
        op10_one_permutation_fingerprint, op11_cover_tree_codes, op12_warc_transactions,
        op13_cholesky_jacobi_whitening,
    )
}
STATEMENTS = {
    "op2_license_rules": licenses.SQL,
    "op4_wu_manber": decontaminate.SQL,
    "op7_hamming_near_dup": near_dup.SQL,
    "op8_line_spread": line_dedup.SQL,
    "op11_cover_tree_codes": cover_codes.SQL,
    "op12_warc_transactions": warc.SQL,
}
