"""From raw documents to a training mix: five stages, each over all that is left.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its rows are
written as Parquet and read again before the next one.  All but the last return the
columns of ``documents``, further columns of the input included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlens.llm import decontamination, mixing, near_duplicates, quality, secret_scan
from postlens.llm.common import fold, quoted
from postlens.sources.scratch import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1 (score 0.3 or more).

    NULL and empty texts score 0.5 and stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold(quoted("doc_id"), quality.FOLDS) != quality.HELD)
    score = quality.score_column(spark, model)
    return docs.where(score(quoted("text")) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Documents without words are in no group and stay."""
    return near_duplicates.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often, as ``copies``."""
    return mixing.apply_mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: The classifier has no SQL form; tests hold the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
