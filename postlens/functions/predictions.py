"""Model predictions: decoding the raw output and merging it with extracted fields.

Model output is free JSON, so a field may hold any type.  It is read as VARIANT,
which keeps the difference between ``12000`` and ``"12000"`` that the rent
normaliser and the truth tests depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .classify import normal_rent, normal_rent_text
from .text import contains_any

TEXT_FIELDS = ("bhk", "location", "furnished", "available_from", "floor", "parking", "facing")
NUMBER_FIELDS = ("deposit", "sqft", "maintenance", "lease_duration")


def prediction_object(raw: Column, widest: bool = False) -> Column:
    """The JSON object inside model output as VARIANT; NULL when missing or malformed.

    The first closing brace ends the object, or the last one with ``widest``.
    """
    pattern = fv.MODEL_JSON_WIDEST if widest else fv.MODEL_JSON_FIRST
    found = F.regexp_extract(raw, "(?s)" + pattern, 0)
    # The parser stops after a complete value.  Inside brackets it has to go on to
    # the end, and more than one element means that there was more than one value.
    whole = F.concat(F.lit("["), found, F.lit("]"))
    listed = F.try_parse_json(whole)
    more = F.try_variant_get(listed, "$[1]", "variant").isNotNull()
    one = F.when(~more, F.try_variant_get(listed, "$[0]", "variant"))
    return F.coalesce(one, F.when(listed.isNull(), _last_of_repeated_keys(whole)))


def _last_of_repeated_keys(whole: Column) -> Column:
    """The one object in a JSON array as VARIANT, the last value of each key counting.

    VARIANT has no repeated keys, so such objects are read as lists of members first.
    Members are compared with each other, which is for the few keys of an answer.
    Keys repeated inside a value, below the object itself, are still malformed.
    """
    objects = F.from_json(whole, "array<map<string,variant>>", {"allowSingleQuotes": "false"})
    members = F.map_entries(F.get(objects, F.lit(0)))
    keys = F.transform(members, lambda m: m["key"])
    last = F.filter(members, lambda m, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), m["key"]))
    return F.when(F.size(objects) == 1, F.try_parse_json(F.to_json(F.map_from_entries(last))))


def _members(obj: Column) -> Column:
    """The fields of an object by name; NULL for other values."""
    return F.try_variant_get(obj, "$", "map<string,variant>")


def _field(members: Column, name: str, kind: str) -> Column:
    """A field of :func:`_members`.  A path to a field that is not there makes an exception
    inside, which costs more than all the rest, and most fields are in few answers."""
    value = F.try_element_at(members, F.lit(name))
    return value if kind == "variant" else F.try_variant_get(value, "$", kind)


def _kind(members: Column, name: str) -> Column:
    """JSON type of a field as Spark spells it: BOOLEAN, BIGINT, STRING, ARRAY<...>, ..."""
    return F.schema_of_variant(_field(members, name, "variant"))


def _text(members: Column, name: str) -> Column:
    """String or number as text.  False and 0 count as absent, other types do not fit."""
    kind = _kind(members, name)
    value = _field(members, name, "string")
    is_number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    return F.when(kind == "STRING", value).when(
        is_number & (_field(members, name, "double") != 0), value
    )


def _truthy(members: Column, name: str) -> Column:
    """Python's idea of truth for any JSON value; NULL counts as false."""
    kind = _kind(members, name)
    text = _field(members, name, "string")
    return F.coalesce(
        F.when(kind == "BOOLEAN", _field(members, name, "boolean"))
        .when(kind == "STRING", text != "")
        .when(kind.startswith("ARRAY"), F.size(_field(members, name, "array<variant>")) > 0)
        .when(kind.startswith("OBJECT"), text != "{}")
        .otherwise(_field(members, name, "double") != 0),
        F.lit(False),
    )


def known_amenities(amenities: Column) -> Column:
    """Amenities on the fixed list, compared without case; NULL when none is left."""
    labels = [label for label, _ in fv.AMENITIES]
    kept = F.filter(amenities, lambda a: F.lower(a).isin(*labels))
    return F.when(F.size(kept) > 0, kept)


def plausible_date(value: str) -> Column:
    """Keep dates that name a month or say immediate; full ISO dates are made up."""
    # In lower case once for all the words.
    named = f"exists(array(lower({value})), v -> {contains_any('v', (*fv.MONTH_ABBREVIATIONS, 'immedia'))})"
    iso = f"(char_length({value}) = 10 AND substring({value}, 5, 1) = '-')"
    return F.expr(f"CASE WHEN NOT {iso} AND {named} THEN {value} END")


def decode_predictions(predictions: DataFrame, widest: bool = False) -> DataFrame:
    """``predictions`` with one typed ``model_*`` column per field.

    ``model_empty`` tells whether nothing usable came back.
    """
    obj, members = F.col("_obj"), F.col("_members")
    columns = {f"model_{f}": _text(members, f) for f in TEXT_FIELDS}
    columns |= {f"model_{f}": _field(members, f, "int") for f in NUMBER_FIELDS}
    rent_text = _field(members, "rent", "string")
    columns |= {
        "model_rent": F.when(_kind(members, "rent") == "STRING", normal_rent_text(rent_text)).when(
            _kind(members, "rent") == "BIGINT", normal_rent(_field(members, "rent", "bigint"))
        ),
        "model_gated_community": F.when(
            _kind(members, "gated_community") != "VOID", _truthy(members, "gated_community")
        ),
        "model_furnished": F.when(
            _kind(members, "furnished") == "STRING", _field(members, "furnished", "string")
        ),
        "model_amenities": known_amenities(_field(members, "amenities", "array<string>")),
        "model_preferred_tenant": _text(members, "preferred_tenant"),
        "model_empty": obj.isNull() | (F.to_json(obj) == "{}"),
    }
    return (
        predictions.withColumn("_obj", prediction_object(F.col("raw_output"), widest))
        .withColumn("_members", _members(obj))
        .withColumns(columns)
        .drop("_obj", "_members")
    )


def raw_answers(predictions: DataFrame) -> DataFrame:
    """``predictions`` with what the model said, one ``model_*`` column per field.

    The widest JSON object counts.  Nothing is checked against lists or bounds; a value
    that does not fit its column's type is NULL, and a number given as text fits.
    """
    obj, members = F.col("_obj"), F.col("_members")
    columns = {f"model_{f}": _field(members, f, "string") for f in (*TEXT_FIELDS, "preferred_tenant")}
    columns |= {f"model_{f}": _field(members, f, "int") for f in (*NUMBER_FIELDS, "rent")}
    one = F.when(_kind(members, "amenities") == "STRING", F.array(_field(members, "amenities", "string")))
    columns |= {
        "model_gated_community": _field(members, "gated_community", "boolean"),
        "model_amenities": F.coalesce(_field(members, "amenities", "array<string>"), one),
        "model_empty": obj.isNull() | (F.to_json(obj) == "{}"),
    }
    return (
        predictions.withColumn("_obj", prediction_object(F.col("raw_output"), widest=True))
        .withColumn("_members", _members(obj))
        .withColumns(columns)
        .drop("_obj", "_members")
    )


def first_number(*values: Column) -> Column:
    """First value that is neither NULL nor 0."""
    return F.coalesce(*[F.when(v != 0, v) for v in values])


def merge_columns() -> dict[str, Column]:
    """Source priority per field; expects extracted columns next to ``model_*``."""
    c = F.col
    merged = {f: F.coalesce(c(f), c(f"model_{f}")) for f in ("bhk", "floor", "parking", "facing")}
    merged |= {f: first_number(c(f), c(f"model_{f}")) for f in NUMBER_FIELDS}
    return merged | {
        # The model's rent is normalised already.
        "rent": first_number(c("rent"), c("model_rent")),
        "amenities": F.coalesce(c("amenities"), c("model_amenities")),
        "available_from": F.coalesce(c("available_from"), plausible_date("model_available_from")),
        "location": F.coalesce(c("model_location"), c("location")),
        "gated_community": F.coalesce(c("gated_community"), F.lit(False))
        | F.coalesce(c("model_gated_community"), F.lit(False)),
        # Any non-empty answer wins here, also one the normaliser drops later.
        "furnished": F.coalesce(F.nullif(c("model_furnished"), F.lit("")), c("furnished")),
    }


def attach_answers(posts: DataFrame, predictions: DataFrame, on: str = "post_id") -> DataFrame:
    """``posts`` with what the model said about each, NULL where it said nothing."""
    return posts.join(predictions.select(on, "raw_output"), on, "left")


def merge_answers(extracted: DataFrame) -> DataFrame:
    """Extracted fields of posts with their answers (:func:`attach_answers`) completed by the model's."""
    kept = [c for c in extracted.columns if c != "raw_output"]
    return decode_predictions(extracted).withColumns(merge_columns()).select(*kept)


def merge_predictions(extracted: DataFrame, predictions: DataFrame, on: str = "post_id") -> DataFrame:
    """Extracted fields completed by the model's; posts without prediction stay as they are."""
    decoded = decode_predictions(predictions.select(on, "raw_output")).drop("raw_output")
    joined = extracted.join(decoded, on, "left").withColumns(merge_columns())
    return joined.select(*extracted.columns)
