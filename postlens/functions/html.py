"""Links, images and titles of stored HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import strip

# The inside of a tag: quoted values may hold ``>``.  All repetitions are possessive, which
# Java runs as loops; a plain repeated group would recurse once for each attribute.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
# One attribute with its value in any quoting.
_ATTRIBUTE = r"""(?<![^\s/"'])[^\s=/>"']++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++)"""
# Text that only looks like tags.
_NOT_TAGS = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
_HEADING = rf"(?is)<h1(?=[\s/>]){_INSIDE}>(.*?)</h1>"


def _unescape(texts: Column) -> Column:
    """Character references of HTML decoded, in a text or an array of texts.

    Only values with a reference reach Python."""
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from html import unescape

        for batch in batches:
            yield pa.array([None if t is None else unescape(t) for t in batch.to_pylist()], pa.string())

    coded = F.when(texts.contains("&"), texts)
    return F.coalesce(F.arrow_udf(decode, "string")(coded), texts)


def _attribute_values(html: Column, tag: str, name: str) -> Column:
    """Raw values of the attribute in page order, one for each tag that has it."""
    page = F.when(html.contains("<!--") | html.rlike("(?i)<s(?:cript|tyle)"), F.regexp_replace(html, _NOT_TAGS, "")).otherwise(html)
    tags = F.regexp_extract_all(page, F.lit(rf"(?is)<{tag}(?=[\s/])({_INSIDE})>"), 1)

    def value(inside: Column) -> Column:
        pairs = F.regexp_extract_all(inside, F.lit(_ATTRIBUTE), 0)
        own = F.filter(pairs, lambda p: F.lower(F.trim(F.regexp_replace(F.substring_index(p, "=", 1), r"\s", ""))) == name)
        raw = F.regexp_replace(F.get(own, F.lit(0)), r"^[^=]*+=\s*+", "")
        quoted = raw.startswith('"') | raw.startswith("'")
        return F.when(quoted, F.substring(raw, F.lit(2), F.char_length(raw) - 2)).otherwise(raw)

    return F.filter(F.transform(tags, value), F.isnotnull)


def _decoded_values(html: Column, tag: str, name: str) -> Column:
    # One text for all values of a page, as values hold no control character.
    joined = _unescape(F.array_join(_attribute_values(html, tag, name), "\x01"))
    return F.when(joined != "", F.split(joined, "\x01")).otherwise(F.array().cast("array<string>"))


def _any_of(value: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [value.contains(n) for n in needles], F.lit(False))


def page_links(pages: DataFrame, needles=fv.PERMALINK_NEEDLES) -> DataFrame:
    """All matching links as rows ``(page_id, position, link)``, cut at the first ``?``."""
    hrefs = _decoded_values(F.col("html"), "a", "href")
    return (
        pages.select("page_id", F.posexplode(hrefs).alias("position", "href"))
        .where(_any_of(F.col("href"), needles))
        .select("page_id", "position", F.substring_index("href", "?", 1).alias("link"))
    )


def post_link(html: Column, needles=fv.PERMALINK_NEEDLES) -> Column:
    """First link that holds one of the needles, cut at its first ``?``."""
    hrefs = _decoded_values(html, "a", "href")
    first = F.try_element_at(F.filter(hrefs, lambda h: _any_of(h, needles)), F.lit(1))
    return F.substring_index(first, "?", 1)


def image_sources(html: Column, needles=fv.IMAGE_NEEDLES, excluded=fv.IMAGE_EXCLUDED) -> Column:
    """Image addresses that hold a needle and no excluded part, in page order."""
    sources = _decoded_values(html, "img", "src")
    return F.filter(sources, lambda s: _any_of(s, needles) & ~_any_of(s, excluded))


def _inner(html: Column, tag: str) -> Column:
    pattern = rf"(?is)<{tag}(?=[\s/>]){_INSIDE}>(.*?)</{tag}>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def _plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, rf"(?s)<!--.*?-->|</?[a-zA-Z]{_INSIDE}>", "")
    return strip(F.translate(_unescape(text), "\xa0", " "))


def page_title(html: Column) -> Column:
    """Heading text: a link in a heading, else a span in one, else the first heading."""
    headings = F.array_join(F.regexp_extract_all(html, F.lit(_HEADING), 0), "")
    text = _plain_text(F.coalesce(_inner(headings, "a"), _inner(headings, "span"), _inner(headings, "h1")))
    return F.when(
        (F.char_length(text) >= fv.TITLE_MIN_CHARS) & (text != fv.TITLE_EXCLUDED), text
    )


def with_titles(groups: DataFrame, pages: DataFrame, on: str = "url") -> DataFrame:
    """Groups named after their page; the configured name stays where a page gives none.

    Of several pages with one address the smallest title counts, so a group stays one row."""
    titles = pages.groupBy(on).agg(F.min(page_title(F.col("html"))).alias("_title"))
    return (
        groups.join(titles, on, "left")
        .withColumn("name", F.coalesce("_title", "name"))
        .drop("_title")
    )
