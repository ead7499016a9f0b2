"""Hard negatives for contrastive training, by Kronecker-packed inner products.

Vectors are made of whole numbers first.  ``PACK`` candidates are packed together: for
each dimension their components, made non-negative by a bias, become separate fields of
one wide integer.  Multiplying each of these by the anchor's component and adding up
gives one wide integer whose fields are the inner products of all candidates with the
anchor, each raised by the bias times the sum of the anchor's components.  A field is
wide enough that none spills into the next, so scores are exact.

Anchors are dealt to blocks, rows too, and each pair of blocks is one group of rows.  In
a group the anchors of the block are held, candidates pass by pack after pack, and the
best of each anchor so far are kept, so memory does not depend on the number of rows.
Two passes are made: the first compares anchors with rows of their own label and finds
the positives, the second compares them with the others, between the bounds that the
positives set.  The best of each group meet in one shuffle of narrow rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's share of the positive's score, per cent.
LEAST, MOST = 50, 95
ANCHORS = "vec_id % 50 = 0"
RELABELLED = "vec_id % 7 = 0"
LABELS = 10
#: Candidates in one wide integer.
PACK = 256
#: Anchors of a block, and pairs of an anchor and a row that a group compares.
BLOCK = 16_384
GROUP_PAIRS = 1 << 23
#: Candidate scores that a task gathers before it keeps the best of them.
BUFFER = 1 << 19
#: Squared lengths up to here have scores of 64 bits.
LONGEST = 1 << 62
_HIT = "akey long, slot int, score long, vec_id long, vkey long"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, v, vkey)``: rows that take part, components as whole numbers.

    ``vkey`` tells apart rows that share a vec_id."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            out = []
            for vector in vectors.to_pylist():
                if vector is None or not all(x is not None and math.isfinite(x) for x in vector):
                    out.append(None)
                    continue
                # Beyond 2^53 every double is whole.
                row = [math.floor(SCALE * x) if abs(x) < 2.0**53 else SCALE * int(x) for x in map(float, vector)]
                out.append(row if sum(x * x for x in row) <= LONGEST else None)
            yield pa.array(out, pa.list_(pa.int64()))

    label = F.when(F.expr(RELABELLED), F.pmod(F.col("label").cast("long") + 1, F.lit(LABELS))).otherwise(
        F.col("label").cast("long")
    )
    rows = embeddings.where("label IS NOT NULL AND vec_id IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"),
        F.arrow_udf(run, "array<bigint>")(F.col("embedding").cast("array<double>")).alias("v"),
    )
    return rows.where("v IS NOT NULL").withColumn("vkey", F.xxhash64("vec_id", "label", "v")).distinct()


def pack(rows: list[list[int]], bias: int, width: int) -> list[int]:
    """One wide integer for each dimension, a field of ``width`` bytes for each row."""
    size = max(map(len, rows), default=0)
    table = np.zeros((len(rows), size), np.int64)
    for k, row in enumerate(rows):
        table[k, : len(row)] = row
    fields = np.zeros((size, len(rows), width // 4), "<u4")
    raised = (table + bias).T
    fields[:, :, 0] = raised & 0xFFFFFFFF
    if width > 4:
        fields[:, :, 1] = raised >> 32
    return [int.from_bytes(f.tobytes(), "little") for f in fields]


def scores(anchor: list[int], packed: list[int], rows: int, bias: int, width: int) -> bytes:
    """Fields of the anchor's products with a pack, still raised, as little-endian bytes."""
    # Half the range of a field is added to each, so that no field is negative.
    middle = int.from_bytes((bytes(width - 1) + b"\x80") * rows, "little")
    return (sum(map(mul, anchor, packed)) + middle).to_bytes(width * rows, "little")


def unpack(raw: list[bytes], anchors: list[list[int]], size: int, rows: int, bias: int, width: int) -> np.ndarray:
    """Exact scores, one line for each anchor.  Lower bits suffice, since a score has 64."""
    fields = np.frombuffer(b"".join(raw), f"<u{min(width, 8)}").reshape(len(raw), rows, -1)[:, :, 0].astype(np.uint64)
    raised = np.array([bias * sum(a[:size]) + (1 << (8 * width - 1)) & 0xFFFFFFFFFFFFFFFF for a in anchors], np.uint64)
    return (fields - raised[:, None]).view(np.int64)


def field_width(largest: int, dimensions: int) -> int:
    """Bytes of a field that holds any product of two vectors, one of them raised."""
    bound = dimensions * largest * 2 * largest
    return 4 if bound < 1 << 31 else 8 if bound < 1 << 63 else 16


class _Best:
    """The best ``keep`` of each slot, by score and then smaller id."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.parts, self.held = keep, [], 0
        self.least = np.full(slots, np.iinfo(np.int64).min)

    def add(self, slot: np.ndarray, score: np.ndarray, vec_id: np.ndarray, key: np.ndarray) -> None:
        self.parts.append((slot, score, vec_id, key))
        self.held += len(slot)
        if self.held > BUFFER:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        slot, score, vec_id, key = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((key, vec_id, ~score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, slot)
        place = np.arange(len(slot)) - first
        order, slot, last = order[place < self.keep], slot[place < self.keep], place[place < self.keep]
        kept = (slot, score[order], vec_id[order], key[order])
        full = last == self.keep - 1
        self.least[slot[full]] = kept[1][full]
        self.parts, self.held = [kept], len(slot)
        return kept


def _search(own_label: bool, keep: int, bias: int, width: int) -> Callable:
    """Task function over groups ``(ablock, rblock, role, label, ...)`` in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchors, best, waiting = None, [], None, []

        def compare() -> None:
            """All held anchors with the waiting pack."""
            if not waiting or not anchors:
                return
            labels, ids, keys, rows = (list(x) for x in zip(*waiting))
            label, ids, keys = np.array(labels), np.array(ids), np.array(keys)
            some = set(labels)
            chosen = [i for i, a in enumerate(anchors) if (a[1] in some if own_label else some != {a[1]})]
            if not chosen:
                return
            packed = pack(rows, bias, width)
            for start in range(0, len(chosen), 1024):
                part = chosen[start : start + 1024]
                vectors = [anchors[i][2] for i in part]
                raw = [scores(v, packed, len(rows), bias, width) for v in vectors]
                found = unpack(raw, vectors, len(packed), len(rows), bias, width)
                same = np.array([anchors[i][1] for i in part])[:, None] == label[None, :]
                if own_label:
                    same &= np.array([anchors[i][0] for i in part])[:, None] != keys[None, :]
                    take(np.array(part), found, same, ids, keys)
                    continue
                for s in range(max(len(anchors[i][3]) for i in part)):
                    bounds = [anchors[i][3][s] if s < len(anchors[i][3]) else (1, 0) for i in part]
                    low, high = (np.array(x)[:, None] for x in zip(*bounds))
                    take(np.array(part) * POSITIVES + s, found, ~same & (found >= low) & (found <= high), ids, keys)

        def take(slots: np.ndarray, found: np.ndarray, good: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
            at, j = np.nonzero(good & (found >= best.least[slots][:, None]))
            if len(at):
                best.add(slots[at], found[at, j], ids[j], keys[j])

        def result() -> Iterator[pa.RecordBatch]:
            compare()
            if best is None:
                return
            slot, score, vec_id, key = best.cut()
            per = 1 if own_label else POSITIVES
            akey = np.array([a[0] for a in anchors], np.int64)[slot // per] if len(slot) else slot
            columns = [akey, (slot % per).astype(np.int32), score, vec_id, key]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["akey", "slot", "score", "vec_id", "vkey"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                ablock, rblock, role, label, vec_id, key, v, bounds = row
                if (ablock, rblock) != group:
                    yield from result()
                    group, anchors, best, waiting = (ablock, rblock), [], None, []
                if role == 0:
                    anchors.append((key, label, v, [(b["low"], b["high"]) for b in bounds or []]))
                    continue
                best = best or _Best(len(anchors) * (1 if own_label else POSITIVES), keep)
                waiting.append((label, vec_id, key, v))
                if len(waiting) == PACK:
                    compare()
                    waiting = []
        yield from result()

    return run


def _best(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], own_label: bool, bias: int, width: int,
          keep: int) -> DataFrame:
    """``(akey, slot, score, vec_id, vkey, rank)``: the best rows of each anchor's slot."""
    ablocks, rblocks = blocks
    names = ["ablock", "rblock", "role", "label", "vec_id", "vkey", "v", "bounds"]
    own_a = F.pmod(F.xxhash64("vkey", F.lit(1)), F.lit(ablocks))
    own_r = F.pmod(F.xxhash64("vkey", F.lit(2)), F.lit(rblocks))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = anchors.withColumns({"ablock": own_a, "role": F.lit(0)}).withColumn("rblock", every(rblocks))
    passing = rows.withColumns(
        {"rblock": own_r, "role": F.lit(1), "bounds": F.lit(None).cast("array<struct<low: bigint, high: bigint>>")}
    ).withColumn("ablock", every(ablocks))
    dealt = (
        held.select(*names).unionByName(passing.select(*names))
        .repartition(ablocks * rblocks, "ablock", "rblock")
        .sortWithinPartitions("ablock", "rblock", "role", "label", "vkey")
    )
    found = dealt.mapInArrow(_search(own_label, keep, bias, width), _HIT)
    order = Window.partitionBy("akey", "slot").orderBy(F.desc("score"), "vec_id", "vkey")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(embeddings: DataFrame) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id and scores.

    Rows with a NULL vec_id, label, vector or component and rows with a component that is
    not finite take no part, nor do rows whose whole-number vector has a squared length
    above 2^62, as their scores may exceed 64 bits.  Empty vectors score 0; of vectors of
    different lengths the missing components count as 0.  Rows that repeat in all three
    columns count once.  Rows that share a vec_id only are rows of their own, ties between
    them are broken by a hash of their content.  Anchors without positives, and positives
    without negatives, have no rows.  Other columns are not read; an empty table has an
    empty result.
    """
    rows = cut_lineage(whole_vectors(embeddings), "vectors")
    anchors = rows.where(ANCHORS)
    sizes = rows.agg(
        F.count("*").alias("rows"), F.count_if(F.expr(ANCHORS)).alias("anchors"),
        F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dimensions"),
        F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0)).alias("largest"),
    ).first()
    bias = max(sizes["largest"], 1)
    width = field_width(bias, max(sizes["dimensions"], 1))
    ablocks = max(1, math.ceil(sizes["anchors"] / BLOCK))
    rblocks = max(1, math.ceil(sizes["rows"] * max(1, sizes["anchors"]) / ablocks / GROUP_PAIRS))
    blocks = (ablocks, rblocks)

    nothing = F.lit(None).cast("array<struct<low: bigint, high: bigint>>")
    positives = cut_lineage(
        _best(anchors.withColumn("bounds", nothing), rows, blocks, True, bias, width, POSITIVES)
        .select("akey", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"),
                F.col("vec_id").alias("positive_id")),
        "positives",
    )
    # Decimals, as a score may have 64 bits.
    part = lambda c, per_cent: F.col(c).cast("decimal(25,0)") * per_cent
    low, high = F.ceil(part("positive_score", LEAST) / 100), F.floor(part("positive_score", MOST) / 100)
    bounds = (
        positives.withColumns({"low": low.cast("long"), "high": high.cast("long")}).groupBy("akey")
        .agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("b"))
        .select(F.col("akey").alias("vkey"), F.transform("b", lambda x: F.struct(x["low"], x["high"])).alias("bounds"))
    )
    asking = anchors.join(bounds, "vkey")
    negatives = _best(asking, rows, blocks, False, bias, width, NEGATIVES).select(
        "akey", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = positives.join(anchors.select(F.col("vkey").alias("akey"), F.col("vec_id").alias("anchor_id")), "akey")
    return negatives.join(named, ["akey", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
        "positive_score", "negative_score",
    )


ORACLE_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
         list_inner_product(a.v, c.v)::BIGINT AS score
  FROM rows a JOIN rows c ON a.vec_id % 50 = 0 AND a.vec_id != c.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
  FROM positives JOIN (FROM scored WHERE NOT same) USING (anchor_id)
  WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""
