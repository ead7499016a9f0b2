"""Readers and writers for posts, listings, groups and training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import array_to_json, flag_to_int, json_to_array
from . import schemas


def spread(rows: DataFrame, key: str, tasks: int | None = None) -> DataFrame:
    """Deal a small input out to so many tasks, if the caller asks for it.

    A file of a few megabytes arrives as one task, yet reading text with dozens of
    patterns is worth many.  Without ``tasks`` the file's splits decide.
    """
    return rows if tasks is None or rows.isStreaming else rows.repartition(tasks, key)


def read_json_array(spark: SparkSession, path: str, schema=schemas.LISTINGS) -> DataFrame:
    """One JSON array per file, each file in one task; ``json_arrays`` reads large files in ranges."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(listings: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, absent values written out as null."""
    listings.write.option("ignoreNullFields", False).json(path)


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Stored listings; a projection on top of it prunes the Parquet columns."""
    return spark.read.schema(schemas.LISTINGS).parquet(path)


def write_listings(listings: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, one folder per month of collection.

    Rows are dealt by month, so that not every task writes a file for every month; a
    month with very many rows is split over several tasks."""
    (
        listings.withColumn("run_month", F.to_date(F.trunc("scraped_at", "month")))
        .hint("rebalance", "run_month")
        .write.mode(mode)
        .partitionBy("run_month")
        .parquet(path)
    )


def backfill_columns(listings: DataFrame) -> DataFrame:
    """The six columns the backfill reads."""
    return listings.select("id", "raw_text", "furnished", "parking", "rent", "bhk")


def to_boundary(listings: DataFrame) -> DataFrame:
    """Row-store form: arrays as JSON text, flags as 0/1."""
    return listings.withColumns(
        {
            "amenities": array_to_json(F.col("amenities")),
            "images": array_to_json(F.col("images")),
            "gated_community": flag_to_int(F.col("gated_community")),
            "no_brokerage": flag_to_int(F.col("no_brokerage")),
        }
    )


def from_boundary(rows: DataFrame) -> DataFrame:
    """Inverse of :func:`to_boundary`; absent arrays come back empty."""
    return rows.withColumns(
        {
            "amenities": json_to_array(F.col("amenities")),
            "images": json_to_array(F.col("images")),
            "gated_community": F.col("gated_community") == 1,
            "no_brokerage": F.col("no_brokerage") == 1,
        }
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Group list from YAML (``groups:`` with ``- url:`` and optional ``name:``) or JSON lines.

    The YAML form is a short hand-kept list, so it is read line by line in Spark
    and put together per entry; ``group_id`` is the position in the file.
    """
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(schemas.GROUPS).json(path)
    entries = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.slice(F.split("value", r"(?m)^\s*-\s+"), 2, 2**31 - 1)).alias("group_id", "entry")
    )

    def entry(key: str) -> Column:
        value = F.regexp_extract("entry", rf"(?m)^\s*{key}:[ \t]*[\"']?(.*?)[\"']?[ \t]*\r?$", 1)
        return F.nullif(value, F.lit(""))

    return entries.select(
        F.col("group_id").cast("int"), entry("url").alias("url"), entry("name").alias("name")
    ).where(F.col("url").isNotNull())


def attach_groups(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``group_name`` and ``group_url``.

    No broadcast hint: the group list is far below Spark's size limit and is
    broadcast by statistics, and a list that outgrows it falls back to a shuffle.
    """
    dim = groups.select(
        "group_id", F.col("name").alias("group_name"), F.col("url").alias("group_url")
    )
    return posts.join(dim, "group_id", "left")


def write_training_pairs(pairs: DataFrame, path: str) -> None:
    """One JSON object ``{prompt, completion}`` per line."""
    pairs.select("prompt", "completion").write.json(path)


def write_chat(chats: DataFrame, path: str) -> None:
    """One JSON object ``{messages: [...]}`` per line."""
    chats.select("messages").write.json(path)
