"""Training data from listings: pairs, chats and train/validation splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..sources.scratch import cut_lineage
from .order_statistics import kth_smallest


def _json_text(value: Column) -> Column:
    """One string as JSON, or null."""
    listed = F.to_json(F.array(value))
    quoted = F.regexp_extract(listed, r"(?s)^\[(.*)\]$", 1)
    return F.coalesce(F.when(value.isNotNull(), quoted), F.lit("null"))


def _completion() -> Column:
    """The four target fields as JSON with a blank after each colon and comma.

    The spacing is part of the text a model learns to write, so it is fixed.
    """
    amenities = F.replace(F.to_json("amenities"), F.lit('","'), F.lit('", "'))
    return F.concat(
        F.lit('{"gated_community": '), F.coalesce(F.col("gated_community").cast("string"), F.lit("null")),
        F.lit(', "furnished": '), _json_text(F.col("furnished")),
        F.lit(', "available_from": '), _json_text(F.col("available_from")),
        F.lit(', "amenities": '), F.coalesce(amenities, F.lit("null")),
        F.lit("}"),
    )


def training_pairs(listings: DataFrame, row_id: str = "id") -> DataFrame:
    """``(id, prompt, completion)`` for texts long enough and with something to learn.

    The completion keeps absent fields as null.  A false flag counts as a value.
    """
    c = F.col
    known = (
        c("gated_community").isNotNull() | c("furnished").isNotNull()
        | c("available_from").isNotNull() | c("amenities").isNotNull()
    )
    return listings.where((F.char_length("raw_text") >= fv.MIN_TRAINING_CHARS) & known).select(
        F.col(row_id),
        F.concat(F.lit(fv.TRAINING_PROMPT), c("raw_text")).alias("prompt"),
        _completion().alias("completion"),
    )


def chat_turns(pairs: DataFrame, system: str = fv.TRAINING_SYSTEM) -> DataFrame:
    """Pairs as system, user and assistant messages."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    messages = F.array(
        turn("system", F.lit(system)), turn("user", F.col("prompt")), turn("assistant", F.col("completion"))
    )
    return pairs.withColumn("messages", messages).drop("prompt", "completion")


def split_ordered(rows: DataFrame, row_id: str = "id", share: float = fv.TRAIN_SHARE) -> DataFrame:
    """The first ``int(n * share)`` rows by ``row_id`` train, the rest validate.

    ``row_id`` is a unique integer.  The cut is found by counting, so the split
    itself is a projection without shuffle.
    """
    ids = cut_lineage(rows.select(row_id), "ids")
    cut = kth_smallest(ids, row_id, int(ids.count() * share))
    train = F.lit(False) if cut is None else F.col(row_id) <= cut
    return rows.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("valid")))


def _mixed(row_id: str, seed: int) -> Column:
    """60 well-mixed bits of the id that any SQL engine can reproduce."""
    text = F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def split_seeded(
    rows: DataFrame, row_id: str = "id", share: float = fv.TRAIN_SHARE, seed: int = 42
) -> DataFrame:
    """Random but repeatable split with exactly ``ceil(n * (1 - share))`` validation rows."""
    mixed = cut_lineage(rows.select(row_id, _mixed(row_id, seed).alias("_mixed")), "ids")
    wanted = math.ceil(round(mixed.count() * (1 - share), 9))
    cut = kth_smallest(mixed, "_mixed", wanted)
    if cut is None:
        return rows.withColumn("split", F.lit("train"))
    # Ids that share the cut value are told apart by the id itself.
    tied = mixed.where(F.col("_mixed") == cut)
    below = mixed.where(F.col("_mixed") < cut).count()
    last = kth_smallest(tied, row_id, wanted - below)
    value = _mixed(row_id, seed)
    valid = (value < cut) | ((value == cut) & (F.col(row_id) <= last))
    return rows.withColumn("split", F.when(valid, F.lit("valid")).otherwise(F.lit("train")))
