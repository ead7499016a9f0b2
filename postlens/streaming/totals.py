"""Running totals and saved-item state over streams, kept as a base and deltas.

Each batch writes what it adds per key into a folder of its own; folders are merged as
they grow many, so reading costs the keys and not the history.  Batches are named by run
and number: one that runs again replaces its own folder, and a second checkpoint adds to
the table.  No stream state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.saved import apply_toggles, toggle_counts
from ..sources.versions import BatchTable
from .runs import run_id

TOTALS = ("group_id int, parsed long, failed long", "group_id", {"parsed": F.sum, "failed": F.sum})
TOGGLES = ("listing_id long, toggles long, last timestamp", "listing_id", {"toggles": F.sum, "last": F.max})


def _added_up(table: BatchTable, kind: tuple, entries: list[dict]) -> DataFrame:
    schema, key, adds = kind
    paths = [table.at(e["folder"]) for e in entries]
    rows = table.spark.read.schema(schema).parquet(*paths) if paths else table.spark.createDataFrame([], schema)
    return rows.groupBy(key).agg(*[add(c).alias(c) for c, add in adds.items()])


def _start(rows: DataFrame, count, kind: tuple, path: str, checkpoint: str) -> StreamingQuery:
    run = run_id(rows.sparkSession, checkpoint)

    def write(table: BatchTable, added: DataFrame) -> dict:
        folder = table.new_folder()
        added.write.parquet(table.at(folder))
        return {"folder": folder}

    def batch_run(batch: DataFrame, batch_id: int) -> None:
        table = BatchTable(batch.sparkSession, path)
        table.add(run, batch_id, write(table, count(batch)))
        table.merge(lambda entries: write(table, _added_up(table, kind, entries)))

    return (
        rows.writeStream.foreachBatch(batch_run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _totals(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.col("group_id").cast("int").alias("group_id")).agg(
        F.count_if(F.col("text").isNotNull()).alias("parsed"),
        F.count_if(F.col("text").isNull()).alias("failed"),
    )


def start_group_totals(posts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Parsed and failed posts per group so far."""
    return _start(posts, _totals, TOTALS, table, checkpoint)


def group_totals(spark: SparkSession, table: str) -> DataFrame:
    found = BatchTable(spark, table)
    return _added_up(found, TOTALS, found.read()[1])


def start_toggles(log: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Toggle count and last toggle time per listing so far."""
    return _start(log, toggle_counts, TOGGLES, table, checkpoint)


def saved_after_toggles(spark: SparkSession, table: str, saved: DataFrame | None = None) -> DataFrame:
    """The saved list after all toggles the streams have seen.

    A toggle removes what is there and adds what is not, so the parity of the count and
    the last time decide, in whatever batches the toggles came."""
    found = BatchTable(spark, table)
    return apply_toggles(_added_up(found, TOGGLES, found.read()[1]), saved)
