"""Saved listings: adding, removing, toggling and showing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved_listings(listings: DataFrame, saved: DataFrame) -> DataFrame:
    """Listings on the list, with note and saved time, newest first."""
    marks = saved.select(
        F.col("listing_id").alias("id"),
        F.col("note").alias("saved_note"),
        F.col("created_at").alias("saved_at"),
    )
    return listings.join(marks, "id").orderBy(F.desc("saved_at"), F.desc("id"))


def with_saved_flag(listings: DataFrame, saved: DataFrame) -> DataFrame:
    """Mark the listings that are on the list."""
    ids = saved.select(F.col("listing_id").alias("id"), F.lit(True).alias("saved"))
    return listings.join(ids, "id", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


def saved_ids(saved: DataFrame) -> DataFrame:
    return saved.select("listing_id").distinct()


def add_saved(saved: DataFrame, additions: DataFrame, listings: DataFrame | None = None) -> DataFrame:
    """The list after ``additions(listing_id, note, created_at)``; the first entry stays.

    With ``listings``, additions of unknown listings are refused.
    """
    if listings is not None:
        known = listings.select(F.col("id").alias("listing_id"))
        additions = additions.join(known, "listing_id", "left_semi")
    first = additions.groupBy("listing_id").agg(F.min(F.struct("created_at", "note")).alias("entry"))
    new = first.join(saved, "listing_id", "left_anti").select(
        "listing_id", "entry.note", "entry.created_at"
    )
    return saved.select("listing_id", "note", "created_at").unionByName(new)


def remove_saved(saved: DataFrame, removals: DataFrame) -> DataFrame:
    return saved.join(removals.select("listing_id"), "listing_id", "left_anti")


def toggle_counts(log: DataFrame) -> DataFrame:
    """Toggles and last toggle time per listing; combines map-side and in streams."""
    return log.groupBy("listing_id").agg(F.count(F.lit(1)).alias("toggles"), F.max("ts").alias("last"))


def apply_toggles(counts: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """The list after the toggles.

    A toggle saves an absent listing (empty note) and removes a present one, so only
    the parity of the count matters.
    """
    if saved is None:
        return counts.where(F.col("toggles") % 2 == 1).select(
            "listing_id", F.lit("").alias("note"), F.col("last").alias("created_at")
        )
    both = saved.withColumn("_saved", F.lit(1)).join(counts, "listing_id", "full_outer")
    before = F.coalesce("_saved", F.lit(0))
    toggles = F.coalesce("toggles", F.lit(0))
    touched = toggles > 0
    return both.where((before + toggles) % 2 == 1).select(
        "listing_id",
        F.when(touched, F.lit("")).otherwise(F.col("note")).alias("note"),
        F.when(touched, F.col("last")).otherwise(F.col("created_at")).alias("created_at"),
    )


def fold_toggles(log: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    return apply_toggles(toggle_counts(log), saved)
