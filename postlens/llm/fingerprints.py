"""Document fingerprints: closed syncmers.

Tokens are word pieces of at most six letters or digits, and single other characters.
Of all runs of K tokens those are chosen whose smallest inner run of S tokens, by hash,
lies at an edge.  The choice depends on the run alone, not on what surrounds it, so a
passage has the same anchors in every text, and an edit moves only those it touches.
The fingerprint lists the anchors' 32-bit hashes in text order; likeness is twice the
number of anchors in common over the number of both (distinct ones).

K - 1 marks before and after the text give every text with a token an anchor or more.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, quoted

K, S = 8, 2
TOKEN = r"[\p{L}\p{N}]{1,6}|[^\s\p{L}\p{N}]"
#: Ranges of ids for each shuffle partition.
RANGES = 4
_NULL_ID = -(1 << 63)


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with a column ``name``: the anchors of column ``text`` as array<int>."""
    marks, inner = fresh(df, "marks__", "inner__")
    pad = F.array_repeat(F.lit(0).cast("long"), K - 1)
    hashes = F.transform(F.regexp_extract_all(quoted(text), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))
    out = df.withColumn(marks, F.concat(pad, hashes, pad))
    runs = [F.slice(quoted(marks), k + 1, F.size(quoted(marks)) - (S - 1)) for k in range(S)]
    out = out.withColumn(inner, F.zip_with(*runs, lambda a, b: F.xxhash64(a, b)))
    n = K - S + 1
    count = F.size(quoted(inner)) - (n - 1)
    shifted = F.arrays_zip(*(F.slice(quoted(inner), k + 1, count).alias(f"r{k}") for k in range(n)))
    at = lambda x, k: x[f"r{k}"]
    closed = F.filter(shifted, lambda x: F.least(at(x, 0), at(x, n - 1)) <= F.least(*(at(x, k) for k in range(n))))
    anchors = F.transform(closed, lambda x: F.hash(*(at(x, k) for k in range(0, n, S))))
    empty = F.array().cast("array<int>")
    # Without a token there are marks only.
    has_token = F.size(quoted(marks)) > 2 * (K - 1)
    return out.withColumn(name, F.when(has_token, anchors).otherwise(empty)).drop(marks, inner)


def fingerprint(anchors: Column) -> Column:
    """Eight hex digits for each anchor."""
    return F.array_join(F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for two empty fingerprints, 0 for an empty and another one."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_neighbours(documents: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(doc_id, text, part, ghost, id)`` dealt by ranges of ids, for windows over ``order()``.

    Each range ends with a ghost: a copy of the first row of what follows, and after the
    last range of the very first row.  So a window inside a range sees the next document.
    The driver holds one id for each range.
    """
    spark = documents.sparkSession
    wanted = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"),
    )
    shares = [k / wanted for k in range(1, wanted)] or [0.5]
    cuts = rows.agg(F.percentile_approx("id", shares, 20 * wanted + 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bits = max(1, (len(cuts) + 1).bit_length())
    table = [_NULL_ID, *cuts] + [(1 << 63) - 1] * ((1 << bits) - len(cuts) - 1)
    # Binary search: the number of the last cut that is not above the id.
    lookup = F.aggregate(
        F.lit(list(range(bits - 1, -1, -1))), F.lit(0),
        lambda at, b: F.when(
            F.get(F.lit(table), at + F.pow(F.lit(2), b).cast("int")) <= F.col("id"),
            at + F.pow(F.lit(2), b).cast("int"),
        ).otherwise(at),
    )
    rows = rows.withColumn("part", lookup)
    heads = {r["part"]: r["id"] for r in rows.groupBy("part").agg(F.max("id").alias("id")).collect()}
    parts = sorted(heads, reverse=True)
    follow = [(part, heads[after]) for part, after in zip(parts, parts[1:] + parts[:1])]
    names = spark.createDataFrame(follow, "part int, id long")
    ghosts = (
        rows.select("text", "id").join(F.broadcast(names), "id")  # a row for each range
        .groupBy("part", "id").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast(documents.schema["doc_id"].dataType).alias("doc_id"), "text", "part", F.lit(1).alias("ghost"), "id")
    )
    return rows.select("doc_id", "text", "part", F.lit(0).alias("ghost"), "id").unionByName(ghosts)


def order():
    """Descending id (NULL last), equal ids by text, the ghost last."""
    return Window.partitionBy("part").orderBy("ghost", F.desc("id"), "text")


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    NULL texts are empty ones; an empty text has an empty fingerprint.  A NULL doc_id is
    the last in order.  Repeated rows follow one another.  The only document is its own
    next one."""
    rows = with_neighbours(documents).withColumn("next", F.coalesce(F.lead("text").over(order()), F.lit("")))
    third = F.floor(F.char_length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.char_length("text") - third), F.substring("next", F.lit(1), third)
    )).drop("next")
    rows = with_anchors(with_anchors(rows, "text", "anchors"), "edited", "edited_anchors")
    rows = rows.withColumn("next_anchors", F.lead("anchors").over(order())).where("ghost = 0")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )
