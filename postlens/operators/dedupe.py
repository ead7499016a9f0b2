"""Admission of listings: exact text and cross-group uniqueness, first arrival wins.

All first-arrival choices use ``row_number() = 1``.  Spark cuts every partition to
one row per key before the shuffle (WindowGroupLimit), so a key that holds a third
of all rows reaches its reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage
from .first_come import first_come


def _triple_given() -> Column:
    """Contact, size and area complete enough to recognise a listing elsewhere."""
    contact, bhk = F.col("contact"), F.col("bhk")
    return F.coalesce((contact != "") & (bhk != "") & F.col("location").isNotNull(), F.lit(False))


def _key(kind: str, *parts: Column) -> Column:
    padded = [*parts, *[F.lit("")] * (3 - len(parts))]
    return F.struct(
        F.lit(kind).alias("kind"), *[p.cast("string").alias(f"part_{i}") for i, p in enumerate(padded)]
    )


def text_key(text: str = "raw_text", row_id: str = "id") -> Column:
    """Key of exact text; a NULL text conflicts with nothing, so it gets the row's own key."""
    digest = F.sha2(F.col(text), 256)
    return F.when(F.col(text).isNotNull(), _key("text", digest)).otherwise(_key("row", F.col(row_id)))


def triple_key(row_id: str = "id") -> Column:
    """Key of (contact, bhk, location); incomplete triples conflict with nothing."""
    return F.when(
        _triple_given(), _key("triple", F.col("contact"), F.col("bhk"), F.col("location"))
    ).otherwise(_key("row", F.col(row_id)))


def _digest(key: Column) -> Column:
    """128 bits of a digest of a key; NULL for the key of a row by its id."""
    # Parts are quoted, so that different keys have different texts.
    whole = F.unhex(F.substring(F.sha2(F.to_json(key), 256), 1, 32))
    return F.when(key["kind"] != "row", whole)


def entry_key(text: str = "raw_text", row_id: str = "id") -> Column:
    """Both rules in one key, for fields that depend on the text alone.

    Equal texts then have equal triples, so a row with a complete triple can be
    known by the triple and any other row by its text.
    """
    return F.when(
        _triple_given(), _key("triple", F.col("contact"), F.col("bhk"), F.col("location"))
    ).otherwise(text_key(text, row_id))


def admit(
    rows: DataFrame, known_keys: DataFrame | None, key: Column, order: list[str]
) -> DataFrame:
    """The earliest row of each key that ``known_keys(key)`` does not hold, with its ``key``.

    The rows are shuffled by the key once, for the choice and the look-up together.
    """
    arrival = Window.partitionBy("key").orderBy(*order)
    first = (
        rows.withColumn("key", key)
        .withColumn("_rank", F.row_number().over(arrival))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )
    return first if known_keys is None else first.join(known_keys, "key", "left_anti")


def _admit_by(rows: DataFrame, stored: DataFrame | None, key: Column, order) -> DataFrame:
    # Only the columns the key is made of are read from the stored table.
    # A row known by its id only never conflicts with another one.
    known = None if stored is None else stored.select(key.alias("key")).where(F.col("key.kind") != "row")
    return admit(rows, known, key, list(order)).select(*rows.columns)


def unique_texts(
    rows: DataFrame, stored: DataFrame | None = None, order=("id",), text="raw_text", row_id="id"
) -> DataFrame:
    """Keep the first row per exact text, and none that is stored already."""
    return _admit_by(rows, stored, text_key(text, row_id), order)


def unique_across_groups(
    rows: DataFrame, stored: DataFrame | None = None, order=("id",), row_id="id"
) -> DataFrame:
    """Keep the first row per complete (contact, bhk, location)."""
    return _admit_by(rows, stored, triple_key(row_id), order)


def admit_new(
    rows: DataFrame, stored: DataFrame | None = None, order=("id",), text="raw_text", row_id="id"
) -> DataFrame:
    """Rows that enter the table; inside the batch, fields must depend on the text alone.

    ``stored`` need not be like that: its texts are looked up before the first row of a
    key is chosen, also for rows that the batch knows by their triple.
    """
    if stored is not None:
        digest = F.sha2(F.col(text), 256)
        known = stored.where(F.col(text).isNotNull()).select(digest.alias("_digest"))
        rows = rows.withColumn("_digest", digest).join(known, "_digest", "left_anti").drop("_digest")
    return _admit_by(rows, stored, entry_key(text, row_id), order)


def admit_new_two_keys(
    rows: DataFrame, stored: DataFrame | None = None, order: str = "id", text="raw_text"
) -> DataFrame:
    """Rows that enter the table when equal texts may carry different triples.

    That happens once model predictions are merged in.  A row enters unless an
    earlier row that entered shares its text or its triple.  ``order`` is a unique
    column.  Rows equal in both keys follow the first of them, so they are folded
    before the conflicts are resolved.
    """
    digests = {"_text": _digest(text_key(text, order)), "_triple": _digest(triple_key(order))}
    keyed = rows.select(order, *[d.alias(name) for name, d in digests.items()])
    if stored is not None:
        for name, digest in digests.items():
            keyed = keyed.join(stored.withColumn(order, F.lit(None)).select(digest.alias(name)), name, "left_anti")
    return rows.join(entering(keyed, order), order, "left_semi")


def entering(keyed: DataFrame, order: str = "id") -> DataFrame:
    """Rows of ``keyed(order, _text, _triple)``, digests or NULL, that enter by
    :func:`admit_new_two_keys`, as one column ``order``."""
    # Without one of the keys a row is not folded with others.
    own = F.when(F.col("_text").isNull() | F.col("_triple").isNull(), F.col(order)).alias("own")
    firsts = cut_lineage(keyed.groupBy("_text", "_triple", own).agg(F.min(order).alias("node")).drop("own"), "keys")
    # Keys of one row alone are no conflict; rows without any shared key enter at once.
    edges = firsts.select("node", F.explode(F.array("_text", "_triple")).alias("edge")).where(F.col("edge").isNotNull())
    several = edges.groupBy("edge").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last")
    shared = cut_lineage(edges.join(several.select("edge"), "edge", "left_semi"), "shared-keys")
    single = firsts.select("node").distinct().join(shared.select("node"), "node", "left_anti")
    incidence = shared.distinct().select(
        "node", F.col("node").alias("ord"), "edge", F.lit(True).alias("member")
    )
    return single.unionByName(first_come(incidence)).withColumnRenamed("node", order)


def copy_new(source: DataFrame, target: DataFrame | None, order=("id",)) -> DataFrame:
    """Rows of ``source`` to append to ``target`` when texts that exist are kept."""
    return unique_texts(source, target, order)
