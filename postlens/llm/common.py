"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a task learns from between two means of the models.
TASK_ROWS = 8192
#: Labelled ids that are broadcast to the texts at most, some 40 MB of them.
BROADCAST_IDS = 1 << 20
#: Groups in which the means are taken.
BLOCKS = 256


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use, in any case."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def per_batch(make: Callable[[], Callable], kind: pa.DataType, sql_type: str) -> Callable[[Column], Column]:
    """An Arrow function over texts.  ``make()`` runs once per task and returns
    ``list of texts -> list or array of values``; NULL texts reach it as empty ones."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        values = make()
        for texts in batches:
            yield pa.array(values([t or "" for t in texts.to_pylist()]), type=kind)

    return F.arrow_udf(run, sql_type)


def bounded_sample(
    documents: DataFrame, chosen: DataFrame, rows: int, extra: list[str]
) -> DataFrame:
    """At most ``rows`` rows ``(text, lang, *extra)`` of the documents that ``chosen`` names.

    ``chosen`` holds ``doc_id`` and the extra columns and at most ``rows`` rows, which
    bounds the broadcast.  The result is one partition in a fixed order.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    order = F.xxhash64(F.col("doc_id"))
    return (
        texts.join(F.broadcast(chosen), "doc_id")
        .orderBy(order, "doc_id", "text", "lang", *extra)
        .limit(rows)
        .select("text", "lang", *extra)
    )


def labelled(documents: DataFrame, labels: DataFrame, label: str, learn: Column, task_rows: int) -> tuple[DataFrame, int]:
    """All whole texts with a label as ``(task, order, text, lang, y)``, dealt by their id to
    tasks of some ``task_rows`` ids, and the number of tasks.

    ``order`` is a hash of the id.  Rows with a NULL id, NULL label or another label than 0
    and 1 are not used; neither are ids with contradicting labels.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(learn & F.col("y").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("other"))
        .where("y = other")
        .select("doc_id", "y")
    )
    ids = known.count()
    tasks = ids // task_rows + 1
    # Up to a bound it is cheaper to send the ids to the texts; beyond, they are merged.
    side = F.broadcast(known) if ids <= BROADCAST_IDS else known
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").where(learn)
    order = F.xxhash64(F.col("doc_id"))
    return texts.join(side, "doc_id").select(
        F.pmod(order, F.lit(tasks)).alias("task"), order.alias("order"), "text", "lang", "y"
    ).repartition(4 * tasks, "task"), tasks


def in_order(rows: pa.Table) -> pa.Table:
    """The rows of a task of :func:`labelled` in an order that does not depend on storage."""
    return rows.sort_by([(c, "ascending") for c in ("order", "text", "lang", "y")])


def texts_of(rows: pa.Table, places: np.ndarray | None = None) -> Iterator[str]:
    """The texts at these places, or all, a few at a time, so that they are not held twice."""
    column = rows.column("text").combine_chunks()
    places = np.arange(len(rows)) if places is None else places
    for start in range(0, len(places), 64):
        yield from column.take(pa.array(places[start : start + 64])).to_pylist()


def train_in_rounds(rows: DataFrame, state: np.ndarray, rounds: int,
                    learn: Callable[[pa.Table, np.ndarray, int], np.ndarray | None]) -> np.ndarray | None:
    """``state`` after so many rounds over all rows, those of a ``task`` together; None if
    nothing was learned.

    In a round every task goes on from the same state with its own rows: ``learn(rows,
    state, round)`` returns what it makes of it, None if they tell nothing.  Then each
    number moves by the mean move of the tasks that moved it, so what few tasks know is not
    diluted.  The means are taken in ``BLOCKS`` groups; the driver holds one state, whose
    size is set by parameters, not by the data."""
    context = rows.sparkSession.sparkContext
    for number in range(rounds):
        shared = context.broadcast(state)
        moves = (
            rows.groupBy("task").applyInArrow(_moved(learn, shared, number), "task long, block int, move binary")
            .groupBy("block").applyInArrow(_mean(shared), "block int, after binary").collect()
        )
        if not moves:
            return None
        state = np.concatenate([np.frombuffer(r["after"], np.float32) for r in sorted(moves, key=lambda r: r["block"])])
        shared.destroy()
    return state


def _moved(learn: Callable[[pa.Table, np.ndarray, int], np.ndarray | None], shared, number: int) -> Callable:
    """The bits that a round changes in a task, block by block: none where nothing moves."""

    def run(own: pa.Table) -> pa.Table:
        after = learn(in_order(own), shared.value.copy(), number)
        moves = [] if after is None else np.array_split(after.view(np.uint32) ^ shared.value.view(np.uint32), BLOCKS)
        return pa.table({
            "task": pa.array([own.column("task")[0].as_py()] * len(moves), pa.int64()),
            "block": pa.array(range(len(moves)), pa.int32()),
            "move": pa.array([move.tobytes() for move in moves], pa.binary()),
        })

    return run


def _mean(shared) -> Callable:
    """A block after the mean move of the tasks, each number over those that moved it."""

    def run(moves: pa.Table) -> pa.Table:
        block = moves.column("block")[0].as_py()
        before = np.array_split(shared.value, BLOCKS)[block]
        total, count = np.zeros(len(before)), np.zeros(len(before), np.int64)
        for move in moves.sort_by("task").column("move"):
            bits = np.frombuffer(move.as_buffer(), np.uint32)
            total += (before.view(np.uint32) ^ bits).view(np.float32).astype(np.float64) - before
            count += bits != 0
        after = (before + total / np.maximum(count, 1)).astype(np.float32)
        return pa.table({"block": pa.array([block], pa.int32()), "after": pa.array([after.tobytes()], pa.binary())})

    return run
