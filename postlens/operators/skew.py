"""Join against a table that is unique per key, safe when few keys own most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def lookup_join(big: DataFrame, lookup: DataFrame, on: list[str], hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Inner join of ``big`` with ``lookup`` (one row per key), hot keys spread out.

    A key with more than ``hot_rows`` rows in ``big`` is split into slices of about that
    size, and its single lookup row is repeated once per slice.  Whether the table of
    such keys is broadcast is left to Spark, which knows its size.  With ``hot_rows`` None
    the caller knows that there are none.
    """
    if hot_rows is None:
        return big.join(lookup, on)
    hot = (
        big.groupBy(*on)
        .count()
        .where(F.col("count") > hot_rows)
        .select(*on, F.ceil(F.col("count") / hot_rows).cast("int").alias("_slices"))
    )
    slices = F.coalesce("_slices", F.lit(1))
    # The slice follows from the row's content, so a task that runs again agrees.
    content = F.xxhash64(*big.columns)
    spread = big.join(hot, on, "left").withColumn(
        "_slice", F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(content, slices).cast("int"))
    )
    repeated = lookup.join(hot, on, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return spread.drop("_slices").join(repeated.drop("_slices"), [*on, "_slice"]).drop("_slice")
