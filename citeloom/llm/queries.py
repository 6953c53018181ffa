"""Registered queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import bpe, classifier, exact, license, lm, minhash, packing, rules, toxicity, warc
from citeloom.llm.common import lean
from citeloom.llm.common import table as _table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return _table(spark, sf_dir, name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op5_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_index(table(spark, sf_dir, "pages"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_round_trip(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents"), closest=True)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_bpe_encoding, op3_toxicity, op4_lm_scoring, op5_warc_normaliser, op6_minhash_near_dedup, op7_license_scan, op8_best_fit_packing, op9_quality_classifier, op10_quality_rules, warc_round_trip)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS first_id,
               CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies
        FROM documents
    """,
    "warc_round_trip": "SELECT page_id, url, sha256(html) AS payload_sha256 FROM pages",
}
