"""Near-copy filter inside one group's run.

In arrival order a post is dropped when it and an earlier kept post of the same
run and group are such that the first 80 characters of one occur in the other.

The heads are found without comparing posts pairwise.  Posts are at least 50
characters long, so a head contains a window of 35 overlapping 16-character grams.
Every text selects the smallest gram hash of each of its windows (winnowing:
Schleimer, Wilkerson and Aiken, SIGMOD 2003), about one gram in eighteen, and every
distinct head is known by the smallest gram of its first window.  A shared gram
says where a head could start; the characters at that place are then looked up
among the distinct heads.  The result has one row per (head, text) that contains
it, which is bounded by the length of the texts and not by the square of a group.

Most grams of a text are no head's.  A bitmap of the grams that heads are known by, of a
fixed size, is sent to the tasks that read the texts, so that only grams that may be one
of those become rows, each with the characters around it; texts are not shuffled.  A second
bitmap of that size knows how heads begin, by a hash of their first 50 characters, so that
a gram that texts share, or that is only the text's own head's, makes no row either.  The
bitmaps only leave out what has no match: where they are crowded, more rows pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.text import strip
from ..sources.scratch import cut_lineage
from .first_come import first_come
from .skew import HOT_ROWS, lookup_join

GRAM = 16
WINDOW = fv.MIN_POST_CHARS - GRAM + 1
#: The bitmap of grams: blocks, and bits of one (64 KB each, 16 MB together).
BLOCKS, BLOCK_BITS = 256, 1 << 19
#: Factor of the hashes, and what tells keys of short heads from those of all heads.
MULTIPLIER, SHORT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: A gram is 32 bits of a hash; its highest bits are its place in the bitmap.
SLOT_SHIFT = 32 - (BLOCKS * BLOCK_BITS - 1).bit_length()


def long_enough(posts: DataFrame, text: str = "text") -> DataFrame:
    """Posts with stripped text of at least the minimum length."""
    return posts.withColumn(text, strip(F.col(text))).where(F.char_length(text) >= fv.MIN_POST_CHARS)


def _passes(known: Broadcast):
    """Function that tells for each gram, or half of a key, whether its bit is set."""

    def passes(gram):
        import numpy as np

        slot = (gram >> np.uint32(SLOT_SHIFT)).astype(np.int64)
        return (known.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1

    return passes


def _hashes():
    """Functions that are shipped to the tasks by value: hashes of runs of characters, keys of
    the beginnings of heads, and both halves of such keys."""
    multiplier, other = MULTIPLIER, SHORT

    def rolled(codes, width):
        """A hash of every ``width`` characters, put together from runs of 1, 2, 4, ... of them."""
        import numpy as np

        value, factor, size = codes.astype(np.uint64) + np.uint64(1), np.uint64(multiplier), 1
        whole, taken = None, 0
        with np.errstate(over="ignore"):
            while True:
                if width & size:
                    more = value[taken:]
                    whole = more if whole is None else whole[: len(more)] * factor + more
                    taken += size
                if taken == width:
                    return whole
                value = value[:-size] * factor + value[size:]
                factor = factor * factor
                size *= 2

    def begun(value, seeds, short):
        """Keys of characters that a head may begin with.  Heads shorter than others have a
        second one, for the beginning of a text, which is that of its own head, too."""
        import numpy as np

        with np.errstate(over="ignore"):
            key = (value ^ seeds ^ np.where(short, np.uint64(other), np.uint64(0))) * np.uint64(multiplier)
            return (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def halves(keys):
        import numpy as np

        return (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32)

    return rolled, begun, halves


def _winnow(known: Broadcast | None, begins: Broadcast | None = None):
    """``mapInArrow`` function: texts to their selected grams (hash and position).

    With a bitmap of ``known`` grams, only those that may be among them, with the
    characters in which a head that has the gram in its first window would lie; with one of
    how heads begin, too, only those in which one may, and the places where."""
    gram, window, chunk_chars, reach, least = GRAM, WINDOW, 1 << 20, fv.HEAD_CHARS, fv.MIN_POST_CHARS
    multiplier, (rolled, begun, halves) = MULTIPLIER, _hashes()
    passes = None if known is None else _passes(known)
    may_begin = None if begins is None else _passes(begins)

    def places(codes, lengths, seeds, row, position):
        """Of selected grams, which may lie in a head that is not the text's own (as a flag
        for each), and where such heads may begin: (number of the gram, place)."""
        import numpy as np

        value, first = rolled(codes, least), np.cumsum(lengths) - lengths
        start = position[:, None] - np.arange(window)
        hit, back = np.nonzero((start >= 0) & (start + least <= lengths[row][:, None]))
        start = start[hit, back]
        high, low = halves(begun(value[first[row[hit]] + start], seeds[row[hit]], start == 0))
        found = may_begin(high) & may_begin(low)
        return np.bincount(hit[found], minlength=len(row)) > 0, hit[found], start[found]

    def marks(codes, lengths, seeds):
        """Selected (row, position, hash) of texts that lie one after another in ``codes``."""
        import numpy as np

        value = rolled(codes, gram)
        with np.errstate(over="ignore"):
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(32)
        # The leftmost minimum of each window: 33 bits of the hash, then the position.
        low = np.uint64((1 << 31) - 1)
        best, width = (value & ~low) | np.arange(len(value), dtype=np.uint64), 1
        while width < window:
            step = min(width, window - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        ends = np.cumsum(lengths)
        row = np.repeat(np.arange(len(lengths)), lengths)[: len(best)]
        inside = np.arange(len(best)) + (window + gram - 1) <= ends[row]
        chosen = (best[inside] & low).astype(np.int64)  # never decreases
        chosen = chosen[np.diff(chosen, prepend=-1) != 0]
        at = np.searchsorted(ends, chosen, side="right")
        with np.errstate(over="ignore"):
            hashes = (value[chosen] ^ seeds[at]) * np.uint64(multiplier)
        return at, chosen - (ends - lengths)[at], (hashes >> np.uint64(32)).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow

        for batch in batches:
            texts = batch.column("text").to_pylist()
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            carried = [n for n in batch.schema.names if n not in ("text", "seed")]
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= chunk_chars):
                    chars += len(texts[stop])
                    stop += 1
                part = texts[start:stop]
                codes = np.frombuffer("".join(part).encode("utf-32-le"), dtype=np.uint32)
                lengths, own = np.array([len(t) for t in part]), seeds[start:stop]
                row, position, value = marks(codes, lengths, own)
                if passes is None:
                    more = {"first": pyarrow.array(np.diff(row, prepend=-1) != 0)}
                else:
                    passed = passes(value)
                    row, position, value = row[passed], position[passed], value[passed]
                    more = {}
                    if may_begin is not None:
                        may, hit, place = places(codes, lengths, own, row, position)
                        row, position, value = row[may], position[may], value[may]
                        counts = np.bincount(hit, minlength=len(may))[may]
                        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                        more["starts"] = pyarrow.ListArray.from_arrays(ends, pyarrow.array(place.astype(np.int32)))
                    more |= {"around": pyarrow.array(
                        [part[r][max(0, p - window + 1) : p + reach] for r, p in zip(row.tolist(), position.tolist())],
                        pyarrow.string(),
                    )}
                index = pyarrow.array(row + start)
                yield pyarrow.RecordBatch.from_arrays(
                    [batch.column(n).take(index) for n in carried]
                    + [pyarrow.array(position.astype(np.int32)), pyarrow.array(value.view(np.int32)), *more.values()],
                    names=[*carried, "at", "gram", *more],
                )
                start = stop

    return run


def _marked(rows: DataFrame, known: Broadcast | None, begins: Broadcast | None = None) -> DataFrame:
    """``rows(..., part, text)`` winnowed; the hash of a gram depends on the part."""
    fields = rows.drop("text").schema.add("at", T.IntegerType()).add("gram", T.IntegerType())
    if begins is not None:
        fields = fields.add("starts", T.ArrayType(T.IntegerType()))
    fields = fields.add("first", T.BooleanType()) if known is None else fields.add("around", T.StringType())
    return rows.withColumn("seed", F.xxhash64("part")).mapInArrow(_winnow(known, begins), fields)


def marks(posts: DataFrame) -> DataFrame:
    """Selected grams of ``posts(part, node, text, head)`` as ``(node, at, gram, size)``:
    ``size`` is that of the post's head where the gram is in its first window, else 0."""
    rows = posts.select("part", "node", F.char_length("head").alias("size"), "text")
    return _marked(rows, None).select("node", "at", "gram", F.when(F.col("first"), F.col("size")).otherwise(0).alias("size"))


def head_marks(posts: DataFrame) -> DataFrame:
    """Those of :func:`marks` with a size, one for each post: the grams that heads are known by."""
    return marks(posts.withColumn("text", F.substring("text", 1, fv.MIN_POST_CHARS)))


def head_begins(posts: DataFrame) -> DataFrame:
    """``gram``: both halves of the keys that the beginnings of the heads of
    ``posts(part, head)`` are known by, for :func:`gram_bits`."""
    least, most, (rolled, begun, halves) = fv.MIN_POST_CHARS, fv.HEAD_CHARS, _hashes()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow

        for batch in batches:
            if not batch.num_rows:
                continue
            seeds = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            short = batch.column("size").to_numpy(zero_copy_only=False) < most
            codes = np.frombuffer("".join(batch.column("begin").to_pylist()).encode("utf-32-le"), dtype=np.uint32)
            value = rolled(codes, least)[::least]
            found = [begun(value, seeds, np.zeros(len(value), bool)), begun(value, seeds, short)[short]]
            grams = np.concatenate([half for key in found for half in halves(key)])
            yield pyarrow.record_batch({"gram": pyarrow.array(grams.view(np.int32))})

    begin, size = F.substring("head", 1, least).alias("begin"), F.char_length("head").alias("size")
    return posts.select(F.xxhash64("part").alias("seed"), begin, size).mapInArrow(keys, "gram int")


def gram_bits(grams: DataFrame) -> Broadcast:
    """A bitmap in which the bit of every ``gram`` is set, put together block by block."""

    def bits(own: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow

        flags = np.zeros(BLOCK_BITS, bool)
        flags[(own.column("gram").to_numpy().view(np.uint32) >> np.uint32(SLOT_SHIFT)) % BLOCK_BITS] = True
        block = own.column("block")[0].as_py()
        return pyarrow.table({"block": pyarrow.array([block], pyarrow.int32()),
                              "bits": pyarrow.array([np.packbits(flags, bitorder="little").tobytes()], pyarrow.binary())})

    block = F.shiftrightunsigned("gram", 32 - (BLOCKS - 1).bit_length()).alias("block")
    found = grams.select("gram", block).distinct().groupBy("block").applyInArrow(bits, "block int, bits binary")
    size = BLOCK_BITS // 8
    whole = np.zeros(BLOCKS * size, np.uint8)
    for row in found.collect():
        whole[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return grams.sparkSession.sparkContext.broadcast(whole)


def hits(posts: DataFrame, known: Broadcast, begins: Broadcast | None = None) -> DataFrame:
    """``(part, node, own_head, at, gram, around)``: grams of ``posts`` that may be among the
    known ones, and the characters around them.

    With a bitmap of :func:`head_begins`, only those in which a head that is not the post's
    own may lie, with the ``starts`` of such heads."""
    return _marked(posts.select("part", "node", F.col("head").alias("own_head"), "text"), known, begins)


def marks_among(marked: DataFrame, known: Broadcast) -> DataFrame:
    """Rows of ``marked`` whose gram may be among the known ones."""

    passes = _passes(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow

        for batch in batches:
            gram = batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint32)
            yield batch.filter(pyarrow.array(passes(gram)))

    return marked.mapInArrow(run, marked.schema)


def _at_spots(texts: DataFrame, heads: DataFrame, hot_rows: int) -> DataFrame:
    """``texts(at, gram, ...)`` with ``start`` and ``size``: where a head of ``heads`` that
    shares the gram may lie."""
    # Per gram: where it sits in the heads it stands for, and how long those are.
    # Offsets are below 35 and sizes between 50 and 80, so the sets are bounded.
    spots = heads.groupBy("gram").agg(F.collect_set(F.struct(F.col("at").alias("offset"), "size")).alias("spots"))
    columns = [c for c in texts.columns if c not in ("gram", "size")]
    return (
        lookup_join(texts, spots, ["gram"], hot_rows)
        .select(*columns, F.explode("spots").alias("spot"))
        .withColumn("start", F.col("at") - F.col("spot.offset")).withColumn("size", F.col("spot.size"))
        .where("start >= 0").drop("spot")
    )


def possible_heads(found: DataFrame, heads: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(part, head, node)``: texts of ``found`` (:func:`hits`) have these characters, not
    their own head, where a head of ``heads`` (:func:`head_marks`) may lie."""
    begin = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    spots = _at_spots(found, heads, hot_rows)
    if "starts" in found.columns:
        spots = spots.where(F.array_contains("starts", F.col("start")))
    # Whatever the size, the own head lies at the beginning.
    return (
        spots
        .where(~((F.col("start") == 0) & (F.col("size") == F.char_length("own_head"))))
        .withColumn("head", F.substring(F.col("around"), F.col("start") - begin + 1, F.col("size")))
        .where((F.char_length("head") == F.col("size")) & (F.col("head") != F.col("own_head")))
        .select("part", "head", "node").distinct()
    )


def contained_heads(posts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(part, head, node)``: another head of the same part occurs in the node's text.

    ``posts(part, node, text, head)``.
    """
    heads = cut_lineage(head_marks(posts), "head-grams")
    known, begins = gram_bits(heads), gram_bits(head_begins(posts))
    found = cut_lineage(hits(posts, known, begins), "grams")
    for bits in {known, begins}:
        bits.destroy()
    candidates = cut_lineage(possible_heads(found, heads, hot_rows), "candidates")
    return lookup_join(candidates, posts.select("part", "head").distinct(), ["part", "head"], hot_rows)


def heads_in_texts(marked: DataFrame, texts: DataFrame, heads: DataFrame) -> DataFrame:
    """``(part, head)``: characters of ``texts(part, node, text)`` where a head of ``heads``
    may lie, by ``marked``, the :func:`marks` of the texts."""
    places = _at_spots(marked, heads, HOT_ROWS).select("node", "start", "size").distinct()
    found = places.join(texts.select("part", "node", "text"), "node")
    head = F.substring(F.col("text"), F.col("start") + 1, F.col("size"))
    return found.where("start + size <= char_length(text)").select("part", head.alias("head")).distinct()


def as_posts(posts: DataFrame, part: list[str], order: str, text: str = "text") -> DataFrame:
    """``(part, node, text, head)`` of posts that are long enough already."""
    return posts.select(
        F.struct(*part).alias("part"), F.col(order).alias("node"), F.col(text).alias("text"),
        F.substring(text, 1, fv.HEAD_CHARS).alias("head"),
    )


def drop_near_copies(
    posts: DataFrame, part: list[str], order: str = "post_id", text: str = "text",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Posts that survive the near-copy filter of their ``part`` (run and group).

    ``order`` is a unique arrival order.  Short posts are left out, texts come back
    stripped.
    """
    usable = long_enough(posts, text)
    base = cut_lineage(as_posts(usable, part, order, text), "posts")
    inside = cut_lineage(contained_heads(base, hot_rows), "heads")
    kept = survivors(base.select("part", "head", "node"), inside, hot_rows)
    return usable.join(kept.withColumnRenamed("node", order), order, "left_semi")


def survivors(posts: DataFrame, inside: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Nodes of ``posts(part, head, node)`` that the filter keeps; ``inside`` is
    :func:`contained_heads` of the same posts."""
    # Posts with the same head conflict with each other.  Of those that contain no
    # other head only the earliest can be kept, so the rest is folded away here.
    holders = inside.select("node").distinct().withColumn("holds", F.lit(True))
    flagged = posts.join(holders, "node", "left").select("part", "head", "node", "holds")
    firsts = (
        flagged.where(F.col("holds").isNull())
        .groupBy("part", "head")
        .agg(F.min("node").alias("node"))
    )
    holding = flagged.where(F.col("holds")).select("part", "head", "node")
    disputed = inside.select("part", "head").unionByName(holding.select("part", "head")).distinct()
    settled = firsts.join(disputed, ["part", "head"], "left_anti").select("node")

    members = firsts.join(disputed, ["part", "head"], "left_semi").unionByName(holding)
    edge = F.struct("part", "head").alias("edge")
    incidence = members.select(
        edge, "node", F.col("node").alias("ord"), F.lit(True).alias("member")
    ).unionByName(
        inside.select(edge, "node", F.col("node").alias("ord"), F.lit(False).alias("member"))
    )
    return settled.unionByName(first_come(incidence, hot_rows))
