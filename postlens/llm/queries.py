"""Queries of this package, one for each operator, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination, fingerprints, hard_negatives, language, main_text, mixing, near_duplicates, phrases, quality,
    secret_scan, simhash, toxicity, warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = _table
    return {
        "op1_near_duplicates": lambda s, d: near_duplicates.near_duplicates(t(s, d, "documents")),
        "op2_mixing": lambda s, d: mixing.mix(t(s, d, "documents")),
        "op3_main_text": lambda s, d: main_text.extract_pages(t(s, d, "pages")),
        "op4_quality": lambda s, d: quality.score_documents(t(s, d, "documents"), t(s, d, "labels")),
        "op5_warc": lambda s, d: warc.archive_pages(s, t(s, d, "pages")),
        "op6_fingerprints": lambda s, d: fingerprints.fingerprint_documents(t(s, d, "documents")),
        "op7_language": lambda s, d: language.predict_documents(t(s, d, "documents")),
        "op8_secrets": lambda s, d: secret_scan.scan(t(s, d, "documents")),
        "op9_toxicity": lambda s, d: toxicity.score_documents(t(s, d, "documents"), t(s, d, "labels")),
        "op10_decontamination": lambda s, d: decontamination.contamination(
            t(s, d, "documents"), t(s, d, "benchmark")
        ),
        "op11_simhash": lambda s, d: simhash.near_duplicates(t(s, d, "documents")),
        "op12_hard_negatives": lambda s, d: hard_negatives.mine(t(s, d, "embeddings")),
        "op13_collocations": lambda s, d: phrases.collocations(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": near_duplicates.ORACLE_SQL,
        "op2_mixing": mixing.ORACLE_SQL,
        "op5_warc": warc.ORACLE_SQL,
        "op10_decontamination": decontamination.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
        "op13_collocations": phrases.ORACLE_SQL,
    }
