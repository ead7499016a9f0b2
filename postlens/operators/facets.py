"""Faceted filter over listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Choices the command-line entry accepts
COMMAND_CHOICES = {
    "furnished": ("fully", "semi", "unfurnished"),
    "listing_type": ("full_flat", "flatmate", "room"),
    "gender": ("female", "male", "any"),
    "parking": ("car", "bike", "both"),
}


def _gender(wanted: str) -> Column:
    if wanted.startswith("not_"):
        return ~F.col("gender_preference").eqNullSafe(wanted.replace("not_", ""))
    return F.col("gender_preference") == wanted


def _location(part: str, escape: bool = False) -> Column:
    """``%`` and ``_`` of the user act as wildcards unless ``escape`` is set."""
    part = part.lower()
    if escape:
        return F.lower("location").contains(part)
    # A backslash is an ordinary character here but escapes in LIKE.
    return F.lower("location").like("%" + part.replace("\\", "\\\\") + "%")


FACETS = {
    "min_rent": lambda v: F.col("rent") >= v,
    "max_rent": lambda v: F.col("rent") <= v,
    "bhk": lambda v: F.col("bhk") == str(v),
    "furnished": lambda v: F.col("furnished") == v,
    "gated_community": lambda v: F.col("gated_community"),
    "listing_type": lambda v: F.col("listing_type") == v,
    "food_preference": lambda v: F.col("food_preference") == v,
    "gender_preference": _gender,
    "no_brokerage": lambda v: F.col("no_brokerage"),
    "parking": lambda v: F.col("parking").isin("both", v),
    "location": _location,
    "has_contact": lambda v: F.col("contact").isNotNull(),
    "has_images": lambda v: F.col("images").isNotNull(),
    "has_rent": lambda v: F.col("rent").isNotNull(),
}


def filter_listings(listings: DataFrame, *, escape: bool = False, **filters) -> DataFrame:
    """Listings that meet every given facet.

    A falsy value means the facet is absent, so 0 and ``''`` never filter.
    """
    unknown = filters.keys() - FACETS.keys()
    if unknown:
        raise ValueError(f"unknown facets: {sorted(unknown)}")
    wanted = [
        _location(value, escape) if name == "location" else FACETS[name](value)
        for name, value in filters.items()
        if value
    ]
    return listings.where(reduce(lambda a, b: a & b, wanted)) if wanted else listings


def web_filters(args: dict[str, str]) -> dict:
    """Facets of the web search form: all values arrive as text."""
    filters = {}
    for name in ("min_rent", "max_rent", "bhk"):
        if args.get(name):
            filters[name] = int(args[name])
    for name in ("location", "furnished", "listing_type", "food_preference", "gender_preference", "parking"):
        if args.get(name):
            filters[name] = args[name]
    for name in ("gated_community", "no_brokerage", "has_contact", "has_images", "has_rent"):
        if args.get(name):
            filters[name] = True
    return filters


def command_filters(
    min_rent=None, max_rent=None, bhk=None, location=None, furnished=None, gated=False,
    listing_type=None, veg=False, no_broker=False, gender=None, parking=None,
    has_contact=False, has_images=False,
) -> dict:
    """Facets of the command-line search, with its closed choice lists."""
    chosen = {"furnished": furnished, "listing_type": listing_type, "gender": gender, "parking": parking}
    for name, value in chosen.items():
        if value is not None and value not in COMMAND_CHOICES[name]:
            raise ValueError(f"{name} must be one of {COMMAND_CHOICES[name]}")
    filters = {
        "min_rent": min_rent, "max_rent": max_rent, "bhk": bhk, "location": location,
        "furnished": furnished, "gated_community": gated, "listing_type": listing_type,
        "food_preference": "veg" if veg else None, "no_brokerage": no_broker,
        "gender_preference": gender, "parking": parking,
        "has_contact": has_contact, "has_images": has_images,
    }
    return {name: value for name, value in filters.items() if value}
