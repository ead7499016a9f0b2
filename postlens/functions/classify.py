"""Keyword classes and value normalisers.

The classes look at the lower-cased original text; no Unicode folding here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import contains_any, evaluate_once, java_regex, strip


def _says(low: str, signals) -> Column:
    return F.expr(f"coalesce({contains_any(low, signals)}, false)")


def listing_type(low: str) -> Column:
    """``low``: the lower-cased text as a column name or SQL expression."""
    return F.expr(
        f"CASE WHEN {contains_any(low, fv.FLATMATE_SIGNALS)} THEN 'flatmate' "
        f"WHEN {contains_any(low, fv.ROOM_SIGNALS)} THEN 'room' ELSE 'full_flat' END"
    )


def says_veg(low: str) -> Column:
    return _says(low, fv.VEG_SIGNALS)


def says_non_veg(low: str) -> Column:
    return _says(low, fv.NON_VEG_SIGNALS)


def food_preference(veg: Column, non_veg: Column) -> Column:
    return (
        F.when(veg & non_veg, F.lit("any"))
        .when(veg, F.lit("veg"))
        .when(non_veg, F.lit("non_veg"))
    )


def gender_preference(low: str) -> Column:
    return F.expr(
        f"CASE WHEN {contains_any(low, fv.FEMALE_SIGNALS)} THEN 'female' "
        f"WHEN {contains_any(low, fv.MALE_SIGNALS)} THEN 'male' ELSE 'any' END"
    )


def no_brokerage(low: str) -> Column:
    return _says(low, fv.NO_BROKERAGE_SIGNALS)


def normal_furnished(value: Column) -> Column:
    v = strip(F.lower(value))
    return (
        F.when(v.contains("unfurnish"), F.lit("unfurnished"))
        .when(v.contains("semi"), F.lit("semi"))
        .when(v.contains("full") | (v == "furnished"), F.lit("fully"))
    )


def normal_parking(value: Column) -> Column:
    v = strip(F.lower(value))
    return (
        F.when(v.isin(*fv.PARKING_BOTH), F.lit("both"))
        .when(v.contains("car"), F.lit("car"))
        .when(v.isin(*fv.PARKING_BIKE), F.lit("bike"))
    )


def normal_rent(value: Column) -> Column:
    """Numeric rent: kept when in bounds."""
    return F.when(value.between(*fv.RENT_BOUNDS), value).cast("int")


def normal_rent_text(value: Column) -> Column:
    """Rent given as text: its first run of four to six digits, when in bounds."""
    found = F.regexp_extract(value, java_regex(fv.RENT_IN_TEXT), 1)
    # At most six digits; an empty text would make an exception inside the cast.
    digits = F.get(F.transform(F.array(found), lambda d: F.when(d != "", d.try_cast("int"))), F.lit(0))
    return F.when(digits.between(*fv.RENT_BOUNDS), digits)


def normal_bhk(value: Column) -> Column:
    v = F.upper(strip(value))
    size = F.regexp_extract(v, java_regex(fv.BHK_IN_TEXT), 1)
    return F.when(v == "RK", F.lit("RK")).when(size != "", size)


def enrich(listings: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add the four keyword classes and normalise four fields in place."""
    types = dict(listings.dtypes)
    rent = normal_rent_text if types["rent"] == "string" else normal_rent
    low = "_low"
    return (
        evaluate_once(listings, "_low", F.lower(text))
        .withColumns({"_veg": says_veg(low), "_non_veg": says_non_veg(low)})
        .withColumns(
            {
                "listing_type": listing_type(low),
                "food_preference": food_preference(F.col("_veg"), F.col("_non_veg")),
                "gender_preference": gender_preference(low),
                "no_brokerage": no_brokerage(low),
                "furnished": normal_furnished(F.col("furnished")),
                "parking": normal_parking(F.col("parking")),
                "rent": rent(F.col("rent")),
                "bhk": normal_bhk(F.col("bhk")),
            }
        )
        .drop("_low", "_veg", "_non_veg")
    )
