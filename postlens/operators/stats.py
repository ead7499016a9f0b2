"""Counts over listings and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import FIELDS


def count_listings(listings: DataFrame) -> DataFrame:
    return listings.agg(F.count(F.lit(1)).alias("cnt"))


def stats(listings: DataFrame) -> DataFrame:
    """The eight dashboard counts in one pass."""
    c = F.col
    return listings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("rent").alias("with_rent"),
        F.count("contact").alias("with_contact"),
        F.count("images").alias("with_images"),
        F.count_if(c("listing_type") == "full_flat").alias("full_flat"),
        F.count_if(c("listing_type") == "flatmate").alias("flatmate"),
        F.count_if(c("no_brokerage")).alias("no_brokerage"),
        F.count_if(c("food_preference") == "veg").alias("veg"),
    )


def sync_report(listings: DataFrame) -> DataFrame:
    """The three counts shown before a copy is handed on."""
    return stats(listings).select("total", "with_rent", "with_contact")


def run_counters(parsed: DataFrame, new: DataFrame, group: str = "group_id") -> DataFrame:
    """Parsed, new and failed posts per group, and in total (``is_total`` 1, ``group`` NULL).

    ``parsed`` carries ``parsed_ok``; ``new`` holds the rows that were really added.
    Groups are counted first, so the total is a sum over a few rows.
    """
    per_group = parsed.groupBy(group).agg(
        F.count_if("parsed_ok").alias("parsed"), F.count_if(~F.col("parsed_ok")).alias("failed")
    )
    added = new.groupBy(group).agg(F.count(F.lit(1)).alias("new"))
    return (
        per_group.join(added.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")), "left")
        .rollup(group)
        .agg(
            F.sum("parsed").alias("parsed"),
            F.coalesce(F.sum("new"), F.lit(0)).alias("new"),
            F.sum("failed").alias("failed"),
            F.grouping(group).alias("is_total"),
        )
    )


def fill_rates(rows: DataFrame, fields=FIELDS) -> DataFrame:
    """Share of rows with a value, per field: one pass, then turned into rows."""
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f).alias(f) for f in fields])
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return counts.selectExpr("_rows", f"stack({len(fields)}, {pairs}) AS (field, filled)").select(
        "field", "filled", F.try_divide("filled", "_rows").alias("rate")
    )
