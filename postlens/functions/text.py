"""Text normalisation and the regex dialect shared by all extractors."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv

# White space in the sense of the patterns and of strip(): Unicode white space
# plus the four information separators.
ASCII_SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
OTHER_SPACES = (
    "\u0085             "
    "    　"
)

# Matching text holds ASCII spaces and digits only (see matching_form), which
# keeps both classes down to one table look-up per character.
_SPACE_CLASS = r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f"
_WORD_CLASS = r"a-z0-9_\p{L}\p{N}"


def java_regex(pattern: str) -> str:
    """Spell the shorthands of ``pattern`` out for ``java.util.regex``.

    Java's own Unicode mode counts combining marks as word characters, which
    matters here: decomposed text is full of them, and a mark must end a word.
    ``\\b`` stands next to literal letters in all patterns, so one look-around
    is enough; at the start of a word it is put behind the letters, because Java
    finds a leading literal much faster than a leading look-around.  ``(?d)``
    makes ``.`` stop at ``\\n`` only.
    """
    pattern = re.sub(
        r"\\b([a-z]+)", lambda m: rf"{m[1]}(?<![{_WORD_CLASS}]{m[1]})", pattern
    )
    out, inside, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if token == "\\s":
            out.append(_SPACE_CLASS if inside else f"[{_SPACE_CLASS}]")
        elif token == "\\d":
            out.append("0-9" if inside else "[0-9]")
        elif token == "\\w":
            out.append(_WORD_CLASS if inside else f"[{_WORD_CLASS}]")
        elif token == "\\b":
            out.append(f"(?![{_WORD_CLASS}])")
        else:
            inside = token == "[" or (inside and token != "]")
            out.append(token)
        i += len(token)
    return "(?d)" + "".join(out)


def literal(text: str) -> str:
    """``text`` as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# The next functions return SQL expressions.  The rules are long lists, and one
# parsed expression is much quicker to build than hundreds of Column objects.


def by_common_part(needles) -> list[tuple[str, list[str]]]:
    """``needles`` in groups, each with a literal that all of the group hold.

    A text without that literal holds none of the group, so one look-up stands for all."""
    left, groups = list(dict.fromkeys(needles)), []
    while left:
        parts = {n[i:j] for n in left for i in range(len(n)) for j in range(i + 3, len(n) + 1)}
        shared = {p: [n for n in left if p in n] for p in parts}
        best = max(shared, key=lambda p: (len(shared[p]), len(p), p), default=left[0])
        group = shared.get(best, left[:1])
        groups.append((best, group) if len(group) > 1 else (left[0], left[:1]))
        left = [n for n in left if n not in groups[-1][1]]
    return groups


def contains_any(value: str, needles) -> str:
    """True when ``value`` holds at least one of the literal ``needles``."""

    def contains(n: str) -> str:
        return f"contains({value}, {literal(n)})"

    # Whatever holds a needle that holds another one holds that one, too.
    needles = [n for n in needles if not any(m != n and m in n for m in needles)]
    groups = [
        contains(part) if part in group else f"({contains(part)} AND ({' OR '.join(map(contains, group))}))"
        for part, group in by_common_part(needles)
    ]
    return "(" + " OR ".join(groups) + ")"


def first_match(value: str, pattern: str, needs=(), group: int = 1) -> str:
    """Group of the leftmost match; ``''`` or NULL when there is none.

    ``needs`` lists literals of which every match must contain one.  Looking for
    them first is a plain byte scan, so most rows never reach the regex.
    """
    match = f"regexp_extract({value}, {literal(java_regex(pattern))}, {group})"
    return f"CASE WHEN {contains_any(value, needs)} THEN {match} END" if needs else match


def has_match(value: str, pattern: str, needs=()) -> str:
    """Whether ``pattern`` occurs, with the same literal pre-check."""
    match = f"({value} RLIKE {literal(java_regex(pattern))})"
    return f"({contains_any(value, needs)} AND {match})" if needs else match


def whole_number(captured: str) -> str:
    """Digits with thousands commas as BIGINT; NULL for anything that is no number.

    ``captured`` is named once only, since it may be a regex.  No match is an empty text, and
    a cast that fails makes an exception inside, which costs more than the regex."""
    digits = f"translate({captured}, ',', '')"
    return f"transform(array({digits}), d -> CASE WHEN d != '' THEN try_cast(d AS BIGINT) END)[0]"


def evaluate_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``value`` as a column that later filters refer to instead of repeating it.

    Spark pushes a filter through projections by copying their expressions into it.
    It does not push it through ``explode``, here of a one-element array, unless it
    is on other columns, and those still reach the scan.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def strip(col: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.trim(col, F.lit(ASCII_SPACES + OTHER_SPACES))


def bold_digits_to_ascii(col: Column) -> Column:
    """Only the mathematical bold sans digits, as the model path does."""
    return F.translate(col, fv.BOLD_DIGITS, "0123456789")


def _foreign_text_udf():
    # Nested, so that it is shipped to the workers by value: executors need
    # pyarrow but not this package.
    other_spaces = OTHER_SPACES

    def fold(texts: pa.Array) -> pa.Array:
        import unicodedata

        import pyarrow.compute as pc

        plain = pc.utf8_normalize(texts, form="NFKD")
        # Digits of other scripts become ASCII digits.  Spaces that NFKD leaves
        # become tabs: white space to a pattern, yet different from a blank.
        without_ascii_digits = pc.replace_substring_regex(plain, "[0-9]+", "")
        marked = pc.match_substring_regex(without_ascii_digits, rf"[{other_spaces}]|\p{{Nd}}")
        if not pc.any(marked).as_py():
            return plain

        def ascii_char(c: str) -> str:
            if c in other_spaces:
                return "\t"
            return c if c.isascii() or not c.isdecimal() else str(unicodedata.decimal(c))

        import pyarrow

        return pyarrow.array(
            [
                "".join(map(ascii_char, text)) if mark else text
                for text, mark in zip(plain.to_pylist(), marked.to_pylist())
            ],
            pyarrow.string(),
        )

    return F.arrow_udf(fold, "string")


def matching_form(col: Column) -> Column:
    """Unicode NFKD with ASCII digits and ASCII white space only.

    Pure ASCII text already has this form, so those rows are handed to the Arrow
    function as NULL and take the original value afterwards.
    """
    foreign = F.when(F.octet_length(col) != F.char_length(col), col)
    return F.coalesce(_foreign_text_udf()(foreign), col)
