"""Result cards: listing columns laid out for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv


def _or(col: Column, default: str) -> Column:
    return F.coalesce(F.when(col != "", col), F.lit(default))


def _rupees(amount: Column) -> Column:
    return F.when(amount != 0, F.concat(F.lit("Rs."), F.format_number(amount, 0)))


def _tag(value: Column, before: str = "[", after: str = "]", when: Column | None = None) -> Column:
    shown = (value != "") if when is None else when
    return F.when(shown, F.concat(F.lit(before), value, F.lit(after)))


def cards(listings: DataFrame) -> DataFrame:
    """One display row per listing, keyed by ``id``."""
    c = F.col
    details = F.concat_ws(
        " | ",
        F.when(c("gated_community"), F.lit("[Gated]")),
        F.when(c("no_brokerage"), F.lit("[No Broker]")),
        _tag(c("food_preference")),
        _tag(c("parking"), "[Parking: "),
        _tag(c("floor"), "[Floor "),
        F.concat(F.lit("[Maint: "), _rupees(c("maintenance")), F.lit("]")),
        _tag(c("available_from"), "[Avail: "),
        _tag(c("listing_type")),
        _tag(c("gender_preference"), after=" only]",
             when=(c("gender_preference") != "") & (c("gender_preference") != "any")),
    )
    preview = F.substring(F.coalesce(c("raw_text"), F.lit("")), 1, fv.PREVIEW_CHARS)
    return listings.select(
        "id",
        F.concat_ws(
            " | ",
            F.concat(_or(c("bhk"), "?"), F.lit(" BHK")),
            _or(c("furnished"), "-"),
            _or(c("location"), "Unknown"),
        ).alias("headline"),
        F.concat(
            F.lit("Rent: "), F.coalesce(_rupees(c("rent")), F.lit("Not mentioned")),
            F.lit(" | Deposit: "), F.coalesce(_rupees(c("deposit")), F.lit("-")),
        ).alias("price"),
        F.when(details != "", details).alias("details"),
        F.when(F.size("amenities") > 0, F.array_join("amenities", ", ")).alias("amenities"),
        F.when(c("contact") != "", c("contact")).alias("contact"),
        F.when(c("post_url") != "", c("post_url")).alias("link"),
        F.when(F.size("images") > 0, F.size("images")).alias("photos"),
        F.concat(F.translate(preview, "\n", " "), F.lit("...")).alias("preview"),
    )
