"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(
    name: str = "postlens",
    master: str | None = None,
    driver_memory: str | None = None,
    shuffle_partitions: int | None = None,
) -> SparkSession:
    """UTC, adaptive execution with skew handling; the rest is left to the cluster.

    ``shuffle_partitions`` is for local runs.  On a cluster set the number to a few
    times the cores and let adaptive execution join small partitions.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
