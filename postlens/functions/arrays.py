"""Arrays as JSON text at the boundary, and flags as 0/1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_to_array(text: Column) -> Column:
    """JSON text to ``array<string>``; NULL or malformed text gives an empty array."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def array_to_json(values: Column) -> Column:
    """Array to JSON text; NULL and empty arrays give NULL."""
    return F.when(F.size(values) > 0, F.to_json(values))


def flag_to_int(flag: Column) -> Column:
    """1 for true, 0 for false and NULL."""
    return F.coalesce(flag, F.lit(False)).cast("int")
