"""Column types of the stored and landed data."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "flag": T.BooleanType(), "time": T.TimestampType(), "strings": T.ArrayType(T.StringType()),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


POSTS = _schema(
    post_id="bigint", group_id="int", scraped_at="time", text="string", images="strings",
    post_url="string",
)
LISTINGS = _schema(
    id="bigint", bhk="string", rent="int", deposit="int", sqft="int", location="string",
    gated_community="flag", furnished="string", available_from="string",
    preferred_tenant="string", amenities="strings", floor="string", maintenance="int",
    parking="string", facing="string", lease_duration="int", contact="string",
    listing_type="string", food_preference="string", gender_preference="string",
    no_brokerage="flag", raw_text="string", images="strings", post_url="string",
    group_name="string", group_url="string", scraped_at="time", created_at="time",
)
GROUPS = _schema(group_id="int", url="string", name="string")
SAVED = _schema(listing_id="bigint", note="string", created_at="time")
PREDICTIONS = _schema(post_id="bigint", raw_output="string")
