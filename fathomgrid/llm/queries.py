"""The queries of this subpackage: each operator over its whole table, with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomgrid.deploy import bounded, ship
from fathomgrid.llm.common import table
from fathomgrid.llm.decontaminate import leaks
from fathomgrid.llm.exact_dedup import exact_duplicates
from fathomgrid.llm.html_extraction import main_text
from fathomgrid.llm.licenses import licenses
from fathomgrid.llm.near_dedup import near_duplicates
from fathomgrid.llm.packing import packed
from fathomgrid.llm.pii import personal_data
from fathomgrid.llm.quality import scored
from fathomgrid.llm.substring_dedup import repeated_spans
from fathomgrid.llm.token_counts import token_counts


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens) of each document, out of flat token files."""
    ship(spark)
    return token_counts(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id) of each copy."""
    ship(spark)
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packed(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return main_text(table(spark, sf_dir, "pages"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return personal_data(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    bounded(spark)
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, keep_id, hamming) of each near copy."""
    ship(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "evidence", "site", "posterior", "keep")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repeated_spans(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_exact_dedup, op3_best_fit_packing, op4_html_extraction, op5_pii, op6_benchmark_decontamination, op7_simhash_near_dedup, op8_license_scans, op9_quality_classifier, op10_substring_dedup)
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, keep_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE text IS NOT NULL)
        WHERE doc_id <> keep_id""",
}
