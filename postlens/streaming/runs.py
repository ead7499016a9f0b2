"""Names of streaming runs."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run that ``checkpoint`` belongs to, kept beside it.

    Batch numbers begin anew with each checkpoint; folders are named by run and batch,
    so a second checkpoint adds to a table and a retry repeats its own folder."""
    path = checkpoint.rstrip("/") + "_run"
    spark.createDataFrame([(uuid.uuid4().hex,)], "run string").write.mode("ignore").parquet(path)
    return spark.read.schema("run string").parquet(path).first()["run"]
