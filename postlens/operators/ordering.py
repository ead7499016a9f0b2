"""Sorting, limits, paging and result numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..sources.scratch import cut_lineage
from .order_statistics import kth_largest

SORTS = ("rent", "created_at", "bhk")
#: Rows that a top-k may hold in one task; what lies deeper is found by its rank.
SHALLOW = 10_000


def sort_order(sort_by: str = "created_at", row_id: str = "id") -> list[Column]:
    """Descending, NULLs last, ties by id; an unknown key means newest first."""
    return [F.desc_nulls_last(_sorted_by(sort_by)), F.desc(row_id)]


def top_listings(
    listings: DataFrame, sort_by: str = "created_at", limit: int = fv.DEFAULT_LIMIT,
    offset: int = 0, row_id: str = "id", shallow: int = SHALLOW,
) -> DataFrame:
    """Best ``limit`` rows after ``offset``: a per-partition top-k, no full sort.

    That holds ``offset + limit`` rows in one task, so beyond ``shallow`` rows the border
    is found by its rank first (see :func:`key_at`), and the top-k holds ``limit`` rows.
    """
    if offset + limit > shallow and offset > 0:
        keys = cut_lineage(_keys(listings, sort_by, row_id), "page-keys")
        border = key_at(keys, offset, sort_by, row_id)
        if border is None:
            return listings.limit(0)
        return top_after(listings, *border, sort_by, limit, row_id)
    ordered = listings.orderBy(*sort_order(sort_by, row_id))
    if offset > 0:
        ordered = ordered.offset(offset)
    return ordered.limit(limit)


def _sorted_by(sort_by: str) -> str:
    return sort_by if sort_by in SORTS else "created_at"


def _keys(listings: DataFrame, sort_by: str, row_id: str) -> DataFrame:
    return listings.select(_sorted_by(sort_by), row_id)


def key_at(listings: DataFrame, position: int, sort_by: str = "created_at", row_id: str = "id") -> tuple | None:
    """(sort value, id) of the row at ``position`` from 1, or None beyond the last row.

    Nothing is sorted: values and then ids among equal values are counted in buckets,
    each in a few passes over the two columns, so give it a stored table.  NULLs are
    last, as in :func:`sort_order`.  Ids are integers and not NULL.
    """
    column = F.col(_sorted_by(sort_by))
    keys = listings.select(column.alias("value"), F.col(row_id).cast("long").alias("id"))
    filled = keys.where(F.col("value").isNotNull())
    with_value = filled.count()
    if position <= with_value:
        value = kth_largest(filled, "value", position)
        above = filled.where(F.col("value") > F.lit(value)).count()
        equal, rank = filled.where(F.col("value") == F.lit(value)), position - above
    else:
        value, equal, rank = None, keys.where(F.col("value").isNull()), position - with_value
    row = kth_largest(equal, "id", rank)
    return None if row is None else (value, row)


def top_after(
    listings: DataFrame, value, last_id: int, sort_by: str = "created_at",
    limit: int = fv.PAGE_SIZE, row_id: str = "id",
) -> DataFrame:
    """Best ``limit`` rows after the row with this sort value (None: NULL) and id.

    The page after a page, at the same cost however deep: hand over its last row.
    """
    column, ids = F.col(_sorted_by(sort_by)), F.col(row_id)
    if value is None:
        later = column.isNull() & (ids < last_id)
    else:
        later = (column < F.lit(value)) | column.isNull() | ((column == F.lit(value)) & (ids < last_id))
    return listings.where(later).orderBy(*sort_order(sort_by, row_id)).limit(limit)


def numbered(results: DataFrame, sort_by: str = "created_at", row_id: str = "id") -> DataFrame:
    """Add ``number`` from 1.  For limited results only: they are numbered in one task."""
    in_order = Window.orderBy(*sort_order(sort_by, row_id))
    return results.withColumn("number", F.row_number().over(in_order))


def page_count(total: int, size: int = fv.PAGE_SIZE) -> int:
    return max(1, math.ceil(total / size))


def page(
    listings: DataFrame, number: int, sort_by: str = "created_at", size: int = fv.PAGE_SIZE,
    total: int | None = None, row_id: str = "id", shallow: int = SHALLOW,
) -> tuple[DataFrame, int, int]:
    """One result page with the total count and the page number actually shown.

    The number is clamped to the pages that exist.
    """
    total = listings.count() if total is None else total
    number = max(1, min(number, page_count(total, size)))
    return top_listings(listings, sort_by, size, (number - 1) * size, row_id, shallow), total, number
