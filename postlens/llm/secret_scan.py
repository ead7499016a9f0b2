"""Secret scans: known shapes, and random-looking strings by entropy.

Three patterns find assignments to secret names, access keys and hex runs.  Besides
them, every run of 20 or more characters of the base64 alphabet is a candidate: a window
of 20 characters slides over it, counts of its characters follow by one more and one
less, and with them the window's Shannon entropy.  A candidate is a secret if a window
reaches the limit of its character class (hex or base64), unless an allow-list knows its
form.  Candidates that touch a span of the patterns are not reported again.

Everything is DataFrame functions.  Matches of a pattern are located by splitting the
text at them: lengths of pieces and matches add up to places in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted

WINDOW = 20
LIMITS = {"entropy_hex": 3.0, "entropy_base64": 3.7}
#: Kinds in the order of their numbers.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

# The patterns of the three base kinds and the lengths they need.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18

CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
#: Forms that are no secrets: words joined by signs, numbers, UUIDs, stand-ins.
ALLOWED = (
    r"^[A-Za-z+/_=-]*$|^[0-9+/_=-]*$"
    r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|(?i:example|sample|placeholder|xxxx|0123456789|123456789|abcdefgh)"
)
#: Words or short numbers joined by single signs: there is a sign, and none of these.
SIGN, NOT_JOINED = r"[-_/+=]", r"^[-_/+=]|[-_/+=]$|[-_/+=]{2}|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}"
MASK = "[SECRET]"

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _located(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches in order as (start, kind, end, value of the group)."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), value.alias("value"))
    parts = F.transform(parts, lambda x: F.struct(
        F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), x["value"].alias("value")
    ))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        found = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"),
                         x["value"].alias("value"))
        return F.when(x["size"].isNull(), acc).otherwise(
            F.struct((start + x["size"]).alias("at"), F.concat(acc["spans"], F.array(found)).alias("spans"))
        )

    empty = F.array().cast(_SPANS)
    first = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def together(blocks: Column) -> Column:
        """Places count from the beginning of a block; the blocks before it are added."""
        shift = lambda b, base: F.transform(b["spans"], lambda x: F.struct(
            (x["start"] + base).alias("start"), x["kind"].alias("kind"), (x["end"] + base).alias("end"), x["value"].alias("value")
        ))
        base = lambda k: F.aggregate(F.slice(blocks, 1, k), F.lit(0), lambda a, b: a + b["at"])
        return F.flatten(F.transform(blocks, lambda b, k: _with(base(k), lambda sum_: shift(b, sum_))))

    located = _with(F.transform(_blocks(parts), lambda b: F.aggregate(b, first, add)), together)
    return F.coalesce(F.when(text.rlike(pattern), located), empty)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array cut into about as many blocks as each has items, at least one block.

    What copies or passes over a block for each of its items then costs n * sqrt(n), not
    the square, for the very many matches of a long text."""

    def cut(all_: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(all_))).cast("int"))
        last = F.greatest(F.ceil(F.size(all_) / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * size + 1, size))

    return _with(items, cut)


def _apart(candidates: Column, base: Column) -> Column:
    """Candidates that share no character with a span of ``base``, which is sorted."""

    def free(blocks: Column) -> Column:
        touches = lambda x, c: (x["start"] < c["end"]) & (c["start"] < x["end"])
        near = lambda b, c: touches(b, c) & F.exists(b["spans"], lambda x: touches(x, c))
        return F.filter(candidates, lambda c: ~F.exists(blocks, lambda b: near(b, c)))

    reach = F.transform(F.filter(_blocks(base), lambda b: F.size(b) > 0), lambda b: F.struct(
        F.get(b, F.lit(0))["start"].alias("start"), F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("spans"),
    ))
    return F.when(F.size(candidates) == 0, candidates).otherwise(_with(reach, free))


def _window_entropy(value: Column) -> Column:
    """The largest entropy, in bits a character, of ``WINDOW`` characters in a row."""
    n = float(WINDOW)
    letters = F.filter(F.split(value, "", -1), lambda c: c != "")
    # Each step: the character that enters the window, and the one that leaves it.
    before = F.concat(F.array_repeat(F.lit(None).cast("string"), WINDOW), letters)
    steps = F.arrays_zip(letters.alias("enter"), before.alias("leave"))
    steps = F.filter(steps, lambda x: x["enter"].isNotNull())
    steps = F.transform(steps, lambda x: F.struct(
        F.instr(F.lit(ALPHABET), x["enter"]).alias("enter"),
        F.coalesce(F.instr(F.lit(ALPHABET), x["leave"]), F.lit(0)).alias("leave"),
    ))
    weight = lambda k: F.when(k > 1, k * F.log2(k.cast("double"))).otherwise(F.lit(0.0))

    def slide(acc: Column, x: Column) -> Column:
        counts, enter, leave = acc["counts"], x["enter"], x["leave"]
        changed = F.transform(counts, lambda k, i: k + (i + 1 == enter).cast("int") - (i + 1 == leave).cast("int"))
        before = lambda at: F.element_at(counts, at)
        gone = F.when(leave == 0, F.lit(0.0)).otherwise(
            weight(before(F.greatest(leave, F.lit(1)))) - weight(before(F.greatest(leave, F.lit(1))) - 1)
        )
        # A character that leaves as it enters changes nothing.
        came = weight(before(enter) + 1) - weight(before(enter))
        total = acc["total"] + F.when(enter == leave, F.lit(0.0)).otherwise(came - gone)
        seen = acc["seen"] + 1
        entropy = F.lit(log2(n)) - total / n
        return F.struct(
            changed.alias("counts"), total.alias("total"), seen.alias("seen"),
            F.when(seen >= WINDOW, F.greatest(acc["best"], entropy)).otherwise(acc["best"]).alias("best"),
        )

    first = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("total"),
                     F.lit(0).alias("seen"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, first, slide, lambda a: a["best"])


def _allowed(value: Column) -> Column:
    return value.rlike(ALLOWED) | (value.rlike(SIGN) & ~value.rlike(NOT_JOINED))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def with_spans(documents: DataFrame, name: str) -> DataFrame:
    """``documents`` with a column ``name``: struct of ``base`` and ``all``, each an array
    of (start, kind, end) in order, kinds by their number in ``KINDS``."""
    assign, access, run, maybe, base, more = fresh(documents, "assign__", "access__", "hex__", "maybe__", "base__", "more__")
    text = F.coalesce(quoted("text"), F.lit(""))
    found = (
        documents
        .withColumn(assign, F.filter(_located(text, ASSIGN, 0, 1), lambda x: F.char_length(x["value"]) >= ASSIGN_LENGTH))
        .withColumn(access, F.filter(_located(text, ACCESS, 1), lambda x: F.char_length(x["value"]) >= ACCESS_LENGTH))
        .withColumn(run, _located(text, HEX, 2))
        .withColumn(maybe, F.filter(_located(text, CANDIDATE, 3), lambda x: ~_allowed(x["value"])))
        .withColumn(base, F.array_sort(_bare(F.concat(quoted(assign), quoted(access), quoted(run)))))
    )
    apart = _apart(quoted(maybe), quoted(base))
    is_hex = lambda c: c["value"].rlike("^[0-9a-fA-F]+$")
    random = F.filter(apart, lambda c: _window_entropy(c["value"]) >= F.when(is_hex(c), LIMITS["entropy_hex"]).otherwise(LIMITS["entropy_base64"]))
    named = F.transform(random, lambda c: F.struct(
        c["start"], F.when(is_hex(c), F.lit(3)).otherwise(F.lit(4)).alias("kind"), c["end"]
    ))
    found = found.withColumn(more, named)
    every = F.array_sort(F.concat(quoted(base), quoted(more)))
    return found.select(
        *(quoted(c) for c in documents.columns), F.struct(quoted(base).alias("base"), every.alias("all")).alias(name)
    )


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(
            ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def scan(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    NULL and empty texts have no spans.  Repeated rows are scanned one by one.  A text of n
    matches costs n * sqrt(n) besides its length.  Other columns are not looked at."""
    found = with_spans(documents.select("doc_id", "text"), "found").select("doc_id", "found")
    count = lambda n: F.size(F.filter(F.col("found.base"), lambda x: x["kind"] == n)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("found.base")), 256).alias("base_sha256"), _listed(F.col("found.all")).alias("spans"),
    )


def mask_secrets(documents: DataFrame) -> DataFrame:
    """``documents`` with every span of a text replaced by ``MASK``; ``n_chars``, if there,
    follows.  Spans that touch become one mask.  Documents without spans are unchanged."""
    name, clean = fresh(documents, "found__", "clean__")
    found = with_spans(documents, name)
    text, spans = quoted("text"), quoted(name)["all"]

    def whole(blocks: Column) -> Column:
        end = lambda bs: F.greatest(F.lit(0), F.array_max(F.flatten(F.transform(bs, lambda b: F.transform(b, lambda x: x["end"])))))
        done = F.transform(blocks, lambda b, k: _with(
            F.struct(F.coalesce(end(F.slice(blocks, 1, k)), F.lit(0)).alias("at"), b.alias("spans")), block
        ))
        return F.concat(F.array_join(done, ""), F.substring(text, F.coalesce(end(blocks), F.lit(0)) + 1, F.char_length(text)))

    def block(b: Column) -> Column:
        """The text from the end of all earlier blocks to the end of this one, masked."""
        begin, last = b["at"], F.array_max(F.transform(b["spans"], lambda x: x["end"]))
        return _with(F.substring(text, begin + 1, F.greatest(last - begin, F.lit(0))), lambda part: F.aggregate(
            b["spans"], F.struct(begin.alias("at"), F.array().cast("array<string>").alias("parts")),
            lambda acc, x: F.struct(
                F.greatest(acc["at"], x["end"]).alias("at"),
                F.when(x["start"] >= acc["at"], F.concat(acc["parts"], F.array(
                    F.substring(part, acc["at"] - begin + 1, x["start"] - acc["at"]), F.lit(MASK)
                ))).otherwise(acc["parts"]).alias("parts"),
            ),
            lambda acc: F.array_join(acc["parts"], ""),
        ))

    masked = _with(_blocks(spans), whole)
    # A column of its own: its length is taken from the text that is returned.
    found = found.withColumn(clean, F.when(F.size(spans) > 0, masked).otherwise(text))
    out = []
    for c in documents.columns:
        if c.lower() == "text":
            out.append(quoted(clean).alias(c))
        elif c.lower() == "n_chars":
            kind = documents.schema[c].dataType
            out.append(F.when(F.size(spans) > 0, F.char_length(quoted(clean)).cast(kind)).otherwise(quoted(c)).alias(c))
        else:
            out.append(quoted(c))
    return found.select(*out)
