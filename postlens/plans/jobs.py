"""Whole jobs: from posts to stored listings, backfill, copy and re-extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import enrich
from ..functions.extract import extract_fields, extract_phone
from ..functions.predictions import NUMBER_FIELDS, TEXT_FIELDS, attach_answers, merge_answers, raw_answers
from ..operators.dedupe import admit_new, admit_new_two_keys, copy_new
from ..operators.near_copies import drop_near_copies
from ..operators.stats import run_counters
from ..sources.schemas import LISTINGS
from ..sources.scratch import cut_lineage
from ..sources.tables import attach_groups
from ..sources.versions import publish, read_published


def to_listings(
    posts: DataFrame, groups: DataFrame | None = None, predictions: DataFrame | None = None
) -> DataFrame:
    """Posts to the 28 listing columns: extract, merge predictions, enrich, name the group.

    ``created_at`` is the time of collection when the posts carry none.
    """
    if predictions is not None:
        # Joined before the fields are there, so that few columns are shuffled and no answer
        # is decoded in vain.
        posts = attach_answers(posts, predictions)
    fields = extract_fields(posts)
    if predictions is not None:
        fields = merge_answers(fields)
    rows = enrich(fields.withColumnRenamed("text", "raw_text"))
    if groups is not None:
        rows = attach_groups(rows, groups)
    rows = rows.withColumnRenamed("post_id", "id").withColumns(
        {
            "images": F.when(F.size("images") > 0, F.col("images")),
            "created_at": F.col("created_at" if "created_at" in posts.columns else "scraped_at"),
        }
    )
    missing = {f.name: F.lit(None).cast(f.dataType) for f in LISTINGS if f.name not in rows.columns}
    extra = ["group_id"] if "group_id" in rows.columns else []
    return rows.withColumns(missing).select(*LISTINGS.names, *extra)


def ingest(
    posts: DataFrame,
    stored: DataFrame | None = None,
    groups: DataFrame | None = None,
    predictions: DataFrame | None = None,
    near_copies_within: list[str] | None = None,
) -> DataFrame:
    """New listings of a run: near-copy filter, fields, and admission against ``stored``."""
    if near_copies_within:
        posts = drop_near_copies(posts, near_copies_within)
    rows = to_listings(posts, groups, predictions)
    if predictions is None:
        return admit_new(rows, stored)
    # Admission reads the rows more than once; extraction should run once.
    return admit_new_two_keys(cut_lineage(rows, "listings"), stored)


def run_report(posts: DataFrame, new: DataFrame) -> DataFrame:
    """Parsed, new and failed posts per group and in total."""
    return run_counters(posts.withColumn("parsed_ok", F.col("text").isNotNull()), new)


def backfill(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored listings with classes and normalised fields renewed, and the updated count.

    Write the result to a new path: the table is read while it is written.
    """
    return enrich(listings), listings.agg(F.count(F.lit(1)).alias("updated"))


def copy_table(source: DataFrame, target: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows to append to ``target``, and counts of attempted and written rows."""
    written = copy_new(source, target)
    marks = source.select(F.lit(1).alias("attempted"), F.lit(0).alias("written")).unionByName(
        written.select(F.lit(0).alias("attempted"), F.lit(1).alias("written"))
    )
    counts = marks.agg(F.sum("attempted").alias("attempted"), F.sum("written").alias("written"))
    return written, counts


def reextract(listings: DataFrame, predictions: DataFrame) -> DataFrame:
    """Fields taken anew from model output, for the listings where that succeeds.

    The widest JSON object of the output counts, its values as they are; the phone
    number comes from the text.  Columns the model does not fill stay as stored.
    """
    answers = raw_answers(predictions.select(F.col("post_id").alias("id"), "raw_output"))
    decoded = answers.where(~F.col("model_empty"))
    fields = (*TEXT_FIELDS, *NUMBER_FIELDS, "rent", "gated_community", "amenities", "preferred_tenant")
    renewed = {f: F.col(f"model_{f}") for f in fields} | {"contact": extract_phone(F.col("raw_text"))}
    return listings.join(decoded, "id").withColumns(renewed).select(*listings.columns)


def publish_reextracted(listings: DataFrame, predictions: DataFrame, path: str) -> bool:
    """Write re-extracted listings to a new ``path`` if there is at least one."""
    rows = reextract(listings, predictions)
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def publish_renewed(listings: DataFrame, predictions: DataFrame, path: str) -> bool:
    """Publish re-extracted listings as the table at ``path`` as a whole, if there is one.

    Like :func:`publish_reextracted`, but rows are computed once, and readers
    (:func:`read_published`) see the old table until the new one is complete."""
    return publish(reextract(listings, predictions), path)


def backfill_published(spark: SparkSession, path: str) -> bool:
    """Renew classes and normalised fields of a published table, in its own place."""
    return publish(enrich(read_published(spark, path)), path)
