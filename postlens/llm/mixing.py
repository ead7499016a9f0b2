"""Mixing sources to target weights without sorting documents.

Each document has a fixed hash.  A source's documents are taken in the order of their
hash until its budget is used; where that is, histograms tell: words are summed by
source and hash range, the range that the budget ends in is split again, and so on
down to one hash.  Only that range is read again, so no document is ever sorted.
Budgets nest: what a source repeats is a smaller prefix of the same order.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import cut_lineage
from .common import fresh, quoted

WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, in hundredths; and the repeats at most.
SHARE, REPEATS = 150, 2
KEY_BITS, LEVEL_BITS = 60, 12
_WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash of id and text.  Equal rows have equal keys and fare alike."""
    digest = F.md5(F.concat_ws("/", doc_id.cast("string"), text))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)``, one row per source, with ``target``.

    Sources by code point, NULL last, have the weights in turn.  Those whose share would
    exceed ``REPEATS`` times their size get just that, the rest is shared again.  This is
    one level for all others: sorted by size per weight, the full ones come first, and
    running sums find where they end.  There is one row per source here, not per document.
    """
    unit = lcm(*WEIGHTS)
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in WEIGHTS)), (place + 1).cast("int"))
    full = Window.orderBy("level", F.col("source").asc_nulls_last())
    rows = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * REPEATS)
        .withColumn("level", F.expr(f"cap * ({unit} div weight)"))
        .withColumn("before", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.col("total") * SHARE - F.col("before") * 100)
        .withColumn("is_full", F.expr("left * weight >= 100 * cap * weights"))
    )
    # The first source that is not full sets the level of all that follow.
    later = full.rowsBetween(Window.unboundedPreceding, 0)
    first = lambda c: F.first(F.when(~F.col("is_full"), F.col(c)), ignorenulls=True).over(later)
    share = (F.col("weight") * first("left")).cast("double") / (first("weights") * 100).cast("double")
    return rows.select(
        "source", "source_size", F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(share).alias("target")
    )


def _same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def thresholds(rows: DataFrame) -> DataFrame:
    """For ``rows(source, key, size)``: source, source_size, target and up to which key
    documents are taken once (``once``) and twice (``twice``), the key included."""
    sizes = cut_lineage(
        targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets"
    )
    budgets = F.array(
        F.struct(F.lit(1).alias("pass"), F.least("target", F.col("source_size").cast("double")).alias("budget")),
        F.struct(F.lit(2).alias("pass"), F.greatest(F.col("target") - F.col("source_size"), F.lit(0.0)).alias("budget")),
    )
    open_ranges = sizes.select("source", F.inline(budgets)).select(
        "source", "pass", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base")
    )
    found = None
    for shift in range(KEY_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        level = cut_lineage(_refine(rows, open_ranges, shift), "mix-level")
        closed = level.where("low = high")
        found = closed if found is None else found.unionByName(closed)
        open_ranges = level.where("low < high").select("source", "pass", "budget", "prefix", "base")
        if open_ranges.isEmpty():
            break
    # The document at the end of the budget is taken if that comes nearer to it.
    nearer = F.col("base") + F.col("end") <= 2 * F.col("budget")
    ends = found.select("source", "pass", F.when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("key"))
    everything = F.lit((1 << KEY_BITS) - 1).cast("long")
    pick = lambda n: F.coalesce(F.min(F.when(F.col("pass") == n, F.col("key"))), everything)
    return (
        sizes.alias("s")
        .join(ends.alias("e"), _same_source("s", "e"), "left")
        .groupBy("s.source", "s.source_size", "s.target")
        .agg(pick(1).alias("once"), pick(2).alias("twice"))
    )


def _refine(rows: DataFrame, open_ranges: DataFrame, shift: int) -> DataFrame:
    """Of each open range the part that its budget ends in; none if the budget is not used up.

    ``base`` and ``end`` are the words before the part and up to its end, ``low`` and
    ``high`` the keys with words in it."""
    part = F.shiftright("key", shift)
    inside = _same_source("r", "o") & (F.shiftright("r.key", shift + LEVEL_BITS) == F.col("o.prefix"))
    keys = ["source", "pass", "budget", "base"]
    sums = (
        rows.where("size > 0").alias("r")
        .join(open_ranges.alias("o"), inside)
        .select("o.source", "o.pass", "o.budget", "o.base", "r.key", "r.size")
        .groupBy(*keys, part.alias("prefix"))
        .agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"))
    )
    # At most 2^LEVEL_BITS rows for each range.
    up_to = Window.partitionBy("source", "pass").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("end", F.col("base") + F.sum("size").over(up_to))
    first = Window.partitionBy("source", "pass").orderBy("prefix")
    return (
        ends.where("end > budget")
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
        .select("source", "pass", "budget", "prefix", (F.col("end") - F.col("size")).alias("base"), "end", "low", "high")
    )


def _copies(key: Column) -> Column:
    return (key <= F.col("t.once")).cast("int") + (key <= F.col("t.twice")).cast("int")


def mix(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken.

    NULL and empty texts have size 0 and take nothing.  NULL is a source like others.
    Equal rows are taken alike."""
    rows = cut_lineage(
        documents.select(
            "doc_id", F.col("source").cast("string").alias("source"),
            key_of(F.col("doc_id"), F.col("text")).alias("key"), size_of(F.col("text")).alias("size"),
        ),
        "mix-rows",
    )
    return (
        rows.alias("r")
        .join(thresholds(rows).alias("t"), _same_source("r", "t"))
        .select("r.doc_id", "r.size", "t.source_size", "t.target", (F.col("r.size") * _copies(F.col("r.key"))).alias("taken"))
    )


def apply_mix(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, all their columns, and how often as ``copies``
    (renamed if there is such a column)."""
    source, key, copies = fresh(documents, "source__", "key__", "copies")
    rows = documents.withColumn(source, quoted("source").cast("string")).withColumn(
        key, key_of(quoted("doc_id"), quoted("text"))
    )
    narrow = cut_lineage(
        rows.select(
            quoted(source).alias("source"), quoted(key).alias("key"), size_of(quoted("text")).alias("size")
        ),
        "mix-rows",
    )
    limits = thresholds(narrow).alias("t")
    return (
        rows.alias("r")
        .join(limits, F.col(f"r.{source}").eqNullSafe(F.col("t.source")))
        .select(*(F.col("r.`" + c.replace("`", "``") + "`") for c in documents.columns), _copies(F.col(f"r.{key}")).alias(copies))
        .where(quoted(copies) > 0)
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('/', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             sum(source_size) OVER ()::BIGINT AS total FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
      FROM w),
f AS (SELECT *, (150 * total - 100 * before) * weight >= 100 * cap * weights AS is_full FROM r),
l AS (SELECT 150 * total - 100 * before AS lefts, 100 * weights AS per FROM f WHERE NOT is_full
      ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE
             ELSE (weight * (SELECT lefts FROM l))::DOUBLE / (SELECT per FROM l)::DOUBLE END AS target FROM f),
c AS (SELECT d.*, source_size, target,
             sum(size) OVER (PARTITION BY d.source ORDER BY key) AS upto,
             sum(size) OVER (PARTITION BY d.source, key) AS own
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * ((2 * upto - own <= 2 * least(target, source_size))::BIGINT
               + (2 * upto - own <= 2 * greatest(target - source_size, 0))::BIGINT) AS taken
FROM c
"""
