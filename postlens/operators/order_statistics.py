"""Exact k-th smallest and largest values of a column without sorting the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 65_536


def kth_smallest(rows: DataFrame, column: str, k: int, buckets: int = BUCKETS) -> int | None:
    """The k-th smallest (from 1) value of ``column``, or None when there are fewer rows.

    Each pass reads the one column, counts it in equal-width buckets and narrows the
    range to the bucket that holds rank k.  Only bucket counts (a fixed number of
    rows) meet in one task; a 64-bit range needs at most five passes.
    """
    bounds = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    low, high, total = bounds
    if k < 1 or total < k:
        return None
    while low < high:
        width = (high - low) // buckets + 1
        inside = rows.where(F.col(column).between(low, high))
        # Decimal arithmetic, as the distance may exceed 64 bits.
        bucket = F.expr(f"(CAST(`{column}` AS DECIMAL(20, 0)) - ({low}BD)) div {width}BD")
        counts = inside.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("bucket"))
        hit = (
            counts.withColumn("upto", upto)
            .where(F.col("upto") >= k)
            .orderBy("bucket")
            .first()
        )
        k -= hit["upto"] - hit["n"]
        low, high = low + hit["bucket"] * width, min(high, low + (hit["bucket"] + 1) * width - 1)
    return low


#: Bytes of a text that one round of :func:`kth_largest` looks at.
PIECE = 6


def kth_largest(rows: DataFrame, column: str, k: int) -> object | None:
    """The k-th largest (from 1) value of an integer, date, timestamp or text column.

    NULLs do not count; None when there are fewer values.  Texts compare by their
    UTF-8 bytes, as in Spark, and are read six bytes a round, so that texts which agree
    in their first bytes cost further rounds.
    """
    kind = rows.schema[column].dataType.simpleString()
    value = F.col(column)
    if kind == "string":
        return _kth_largest_text(rows.where(value.isNotNull()), value, k)
    since = f"CAST(`{column}` - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND)"
    as_number = {
        "timestamp": F.unix_micros(value),
        "timestamp_ntz": F.expr(f"CAST(CAST({since} AS DECIMAL(18, 6)) * 1000000 AS LONG)"),
        "date": F.unix_date(value),
    }
    if kind not in as_number and kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"no ranks for a column of type {kind}")
    number = as_number.get(kind, value).cast("long")
    found = _kth_largest_number(rows.select(number.alias("n")), k)
    if found is None or kind not in as_number:
        return found
    return rows.where(number == found).select(column).first()[0]


def _kth_largest_number(numbers: DataFrame, k: int) -> int | None:
    total = numbers.agg(F.count("n")).first()[0]
    return kth_smallest(numbers, "n", total - k + 1) if 1 <= k <= total else None


def _kth_largest_text(rows: DataFrame, value: Column, k: int) -> str | None:
    prefix = b""
    while True:
        rest = F.substring(F.hex(F.encode(value, "UTF-8")), 2 * len(prefix) + 1, 2 * PIECE)
        starts = F.lit(True) if not prefix else F.hex(F.encode(value, "UTF-8")).startswith(prefix.hex().upper())
        # The bytes as a number, then how many there are: "a" comes before "a\0".
        number = F.conv(F.rpad(rest, 2 * PIECE, "0"), 16, 10).cast("long") * 8 + F.shiftright(F.length(rest), 1)
        numbers = rows.where(starts).select(number.alias("n"))
        found = _kth_largest_number(numbers, k)
        if found is None:
            return None
        k -= numbers.where(F.col("n") > found).count()
        size = found % 8
        prefix += (found // 8).to_bytes(PIECE)[:size]
        if size < PIECE:
            return prefix.decode()
