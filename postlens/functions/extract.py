"""Field extraction: free post text to fifteen typed columns.

One normalised text column, then two projections: captures, each regex once per
row, and typed values.  Fields with several rules in order (rent, deposit, dates,
lease) are a ``coalesce`` over the rules, so a rule is only evaluated where the
earlier ones gave nothing.  Everything stays lazy: a query on two fields evaluates
the patterns of those two only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import (
    bold_digits_to_ascii,
    by_common_part,
    evaluate_once,
    first_match,
    has_match,
    java_regex,
    literal,
    matching_form,
    whole_number,
)

FIELDS = (
    "bhk", "rent", "deposit", "sqft", "location", "gated_community", "furnished",
    "available_from", "floor", "maintenance", "parking", "facing", "lease_duration",
    "amenities", "contact",
)

# Literals of which every match of the rule holds at least one.
_RENT_NEEDS = (
    ("rent",), ("mo", "pm"), ("rent",), ("rent",), ("mo", "pm"), ("k",), ("rent",), ("budget",),
)
_AMENITY_NEEDS = (
    ("lift",), ("gym",), ("swimming",), ("security", "cctv"), ("power", "generator", "dg"),
    ("balcon",), ("parking",), ("wifi", "wi-fi"), ("ac", "air"), ("geyser",), ("washing",),
    ("fridge", "refrigerator"), ("ro", "water"), ("modular",),
)
_GATED_NEEDS = (
    "gated", "apartment", "prestige", "aparna", "home", "mantri", "smr", "salarpuria",
    "ramky", "pbel", "brigade",
)


# Expressions below are SQL text over the normalised text column.
_T = "_norm"


def _filled(value: str) -> str:
    return f"CASE WHEN {value} != '' THEN {value} END"


def _bounded(value: str, bounds: tuple[int, int]) -> str:
    return f"CASE WHEN {value} BETWEEN {bounds[0]} AND {bounds[1]} THEN {value} END"


def _with(value: str, use: str) -> str:
    """``use``, an expression in ``v``, with ``value`` evaluated once for all its mentions."""
    return f"transform(array({value}), v -> {use})[0]"


def _captures() -> dict[str, str]:
    # Spark evaluates the part that several areas share once for all of them.
    part = {area: part for part, group in by_common_part(fv.AREAS) for area in group}
    areas = ", ".join(
        f"CASE WHEN contains({_T}, {literal(part[area])}) AND contains({_T}, {literal(area)}) "
        f"THEN {literal(area.title())} END" for area in fv.AREAS
    )
    amenities = ", ".join(
        f"CASE WHEN {has_match(_T, pattern, needs)} THEN {literal(label)} END"
        for (label, pattern), needs in zip(fv.AMENITIES, _AMENITY_NEEDS, strict=True)
    )
    return {
        "_bhk": first_match(_T, fv.BHK, ["bhk"]),
        "_sqft": whole_number(first_match(_T, fv.SQFT, ["sq", "sft"])),
        "_areas": f"concat_ws(', ', {areas})",
        "_floor": first_match(_T, fv.FLOOR, ["floor"]),
        "_maintenance": whole_number(first_match(_T, fv.MAINTENANCE, ["maintenance"])),
        "_facing": first_match(_T, fv.FACING, ["facing"]),
        "_amenities": f"concat_ws('|', {amenities})",
        # No letter occurs in the pattern, so lower case makes no difference.
        "_contact": first_match(_T, fv.CONTACT),
        "_car": has_match(_T, fv.CAR_PARKING, ["car"]),
        "_bike": has_match(_T, fv.BIKE_PARKING, ["bike", "wheeler"]),
    }


def _rent() -> str:
    # Small values mean thousands and are taken as they come; others must be in bounds.
    low, high = fv.RENT_BOUNDS
    accept = (
        f"CASE WHEN v < {fv.RENT_IN_THOUSANDS_BELOW} THEN v * 1000 "
        f"WHEN v BETWEEN {low} AND {high} THEN v END"
    )
    rules = [
        _with(whole_number(first_match(_T, pattern, needs)), accept)
        for pattern, needs in zip(fv.RENT, _RENT_NEEDS, strict=True)
    ]
    span_low = whole_number(first_match(_T, fv.RENT_SPAN, ["k"])) + " * 1000"
    return f"coalesce({', '.join(rules)}, {_with(span_low, _bounded('v', fv.RENT_BOUNDS))})"


def _deposit() -> str:
    needs = (["deposit"], ["advance", "security"])
    rules = [
        _with(whole_number(first_match(_T, pattern, words)), _bounded("v", fv.DEPOSIT_BOUNDS))
        for pattern, words in zip(fv.DEPOSIT, needs, strict=True)
    ]
    return f"coalesce({', '.join(rules)})"


def _available_from() -> str:
    """The matched span is read first and taken apart afterwards."""

    def dated(pattern: str, needs, *layout) -> str:
        parts = [
            f"initcap({first_match('v', pattern, group=x)})" if isinstance(x, int) else literal(x)
            for x in layout
        ]
        span = first_match(_T, pattern, needs, group=0)
        return _with(span, f"CASE WHEN v != '' THEN concat_ws(' ', {', '.join(parts)}) END")

    return f"""CASE WHEN {has_match(_T, fv.AVAILABLE_NOW, ["immedia", "move"])} THEN 'immediate'
        ELSE coalesce(
            {dated(fv.DAY_MONTH, fv.MONTH_ABBREVIATIONS, 1, 2)},
            {dated(fv.MONTH_DAY, fv.MONTH_ABBREVIATIONS, 2, 1)},
            {dated(fv.WEEK_OF_MONTH, ["week"], "Week", 1, "of", 2)}) END"""


def _furnished() -> str:
    rules = " ".join(f"WHEN {has_match(_T, p)} THEN {literal(label)}" for p, label in fv.FURNISHED)
    return f"CASE WHEN contains({_T}, 'furnish') THEN CASE {rules} END END"


def _values() -> dict[str, str]:
    lease = [whole_number(first_match(_T, pattern, ["month"])) for pattern in fv.LEASE]
    return {
        "bhk": f"CASE WHEN {has_match(_T, fv.RK, ['rk'])} THEN 'RK' ELSE {_filled('_bhk')} END",
        "rent": f"CAST({_rent()} AS INT)",
        "deposit": f"CAST({_deposit()} AS INT)",
        "sqft": f"CAST({_bounded('_sqft', fv.SQFT_BOUNDS)} AS INT)",
        "location": f"CASE WHEN _areas != '' THEN substring_index(_areas, ', ', {fv.AREAS_REPORTED}) END",
        "gated_community": f"coalesce({has_match(_T, '|'.join(fv.GATED), _GATED_NEEDS)}, false)",
        "furnished": _furnished(),
        "available_from": _available_from(),
        "floor": _filled("_floor"),
        "maintenance": f"CAST({_bounded('_maintenance', fv.MAINTENANCE_BOUNDS)} AS INT)",
        "parking": f"""CASE WHEN _car AND _bike THEN 'both' WHEN _car THEN 'car' WHEN _bike THEN 'bike'
            WHEN contains({_T}, 'parking') THEN 'car' END""",
        "facing": _filled("_facing"),
        "lease_duration": f"CAST(coalesce({', '.join(lease)}) AS INT)",
        "amenities": f"split({_filled('_amenities')}, {literal('[|]')})",
        "contact": _filled("_contact"),
    }


def extract_fields(posts: DataFrame, text: str = "text") -> DataFrame:
    """Add the fifteen extracted columns to ``posts``; the input columns stay."""
    kept = [f"`{c}`" for c in posts.columns if c not in FIELDS]
    texts = posts.withColumn("_plain", matching_form(F.col(text)))
    texts = evaluate_once(texts, _T, F.lower("_plain"))
    captured = texts.selectExpr("*", *[f"{sql} AS {name}" for name, sql in _captures().items()])
    return captured.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in _values().items()])


def extract_phone(col: Column) -> Column:
    """Phone number of the model path: bold digits folded, no further normalisation."""
    found = F.regexp_extract(bold_digits_to_ascii(col), java_regex(fv.CONTACT), 1)
    return F.when(found != "", found)
