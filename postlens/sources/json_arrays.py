"""JSON arrays of objects read in byte ranges, so that one large file is many tasks.

Files are cut at every "{".  Whether such a place lies in a string, and how deep it lies,
depends on all that comes before it.  The pieces of a range are put together to chunks, and
quotes and braces are counted up to each chunk; the sums of the ranges are added up over the
file.  A range does not know whether it begins in a string, so both cases are counted.  Only
one row for each range goes through the sums.  Elements within a chunk are cut out where the
chunk lies; what begins or ends elsewhere is shuffled to be put together.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import cut_lineage

register_pickle_by_value(sys.modules[__name__])

_RANGE = ("file", "block")
#: Bytes of a chunk; one piece can be longer.  Arrow takes 10,000 of them at a time.
CHUNK = 1 << 14
_CHUNKS = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("text", pa.binary()),
    *[(n, pa.int64()) for n in ("quoted", "depth_0", "depth_1", "quotes", "delta_0", "delta_1")],
])


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the braces, +1 or -1 for each, and whether an odd number of quotes is before
    it; last, by one more place, whether the whole has an odd number."""
    # Backslashes occur in strings only, and never before a brace.
    codes = np.frombuffer(re.sub(rb"(?s)\\.", b"  ", text) if b"\\" in text else text, np.uint8)
    place = np.nonzero((codes == 34) | (codes == 123) | (codes == 125))[0]
    found = codes[place]
    odd = np.cumsum(found == 34) & 1
    brace = found != 34
    return place[brace], np.where(found == 123, 1, -1)[brace], np.append(odd[brace], odd[-1:] if len(odd) else 0)


def _chunks() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function: pieces in the order of their ranges to chunks, with what was
    counted in the range before (``quoted``, ``depth_*``) and within a chunk."""
    limit, schema, marks = CHUNK, _CHUNKS, _marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[bytes] = []
        size, begin, here = 0, 0, None
        before = np.zeros(3, np.int64)

        def put() -> None:
            nonlocal size
            text = b"".join(held)
            _, step, odd = marks(text)
            own = np.array([odd[-1], step[odd[:-1] == 0].sum(), step[odd[:-1] == 1].sum()])
            # An odd number of quotes before a chunk exchanges its two cases.
            if before[0] % 2:
                own[1], own[2] = own[2], own[1]
            rows.append((*here, begin, text, *before.tolist(), *own.tolist()))
            before[:] += own
            held.clear()
            size = 0

        def table() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("file", "block", "at", "value"))
            for file, block, at, value in zip(*columns):
                first = here != (file, block)
                if held and (first or size + len(value) > limit):
                    put()
                if first:
                    here = (file, block)
                    before[:] = 0
                if not held:
                    begin = at
                # All pieces follow a brace but the first of a file.
                held.append(value if first and block == 0 else b"{" + value)
                size += len(held[-1])
            if rows:
                yield table()
        if held:
            put()
        if rows:
            yield table()

    return run


def _cut(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function: the elements that begin and end in a chunk as ``text``; or for
    each chunk what is before its first element, and its last element as far as it goes."""
    marks = _marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            leads, tails = [], []
            for text, string, depth in zip(*(batch.column(n).to_pylist() for n in ("text", "string", "depth"))):
                place, step, odd = marks(text)
                outside = odd[:-1] == string
                step = step * outside
                level = depth + np.cumsum(step) - step
                starts = place[(step == 1) & (level == 0)].tolist()
                if whole:
                    found.extend(text[a:b] for a, b in zip(starts, starts[1:]))
                else:
                    leads.append(text[: starts[0]] if starts else text)
                    tails.append(text[starts[-1] :] if starts else None)
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["text"])
            else:
                names = ("file", "block", "at")
                columns = [batch.column(n) for n in names] + [pa.array(leads, pa.binary()), pa.array(tails, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "lead", "tail"])

    return run


def _before(value: str | Column, order: str, *part: str) -> Column:
    rows = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(rows), F.lit(0))


def read_json_arrays(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The objects of all JSON arrays in the files at ``path`` (UTF-8), in no order.

    A file holds one array, or several one after the other.  Objects may hold objects.
    Any cut of a file into byte ranges gives the same rows.  Members that are no objects
    are passed over, empty files and arrays have no rows, and the objects of a file with
    unbalanced quotes or braces are not defined from there on.
    """
    pieces = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        # Grows within a range, which one task reads from its beginning to its end.
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"),
    )
    counts = ", ".join(f"{f.name} long" for f in _CHUNKS if f.name not in ("file", "block", "at", "text"))
    # Whole ranges go together where they are many, so that few files are written.
    few = pieces.coalesce(4 * spark.sparkContext.defaultParallelism)
    chunks = cut_lineage(
        few.mapInArrow(_chunks(), f"file string, block long, at long, text binary, {counts}"), "json-chunks"
    )
    # One row for each range of the files.
    ranges = chunks.groupBy(*_RANGE).agg(*[F.sum(c).alias(c) for c in ("quotes", "delta_0", "delta_1")])
    ranges = ranges.withColumn("begin", _before("quotes", "block", "file") % 2)
    delta = F.when(F.col("begin") == 0, F.col("delta_0")).otherwise(F.col("delta_1"))
    ranges = ranges.withColumn("delta", delta).withColumn("base", _before("delta", "block", "file"))
    ranges = cut_lineage(ranges.select(*_RANGE, "begin", "base"), "json-ranges")

    depth = F.when(F.col("begin") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    placed = chunks.join(ranges, list(_RANGE)).select(
        *_RANGE, "at", "text", ((F.col("begin") + F.col("quoted")) % 2).alias("string"), (F.col("base") + depth).alias("depth")
    )
    ends = cut_lineage(
        placed.mapInArrow(_cut(False), "file string, block long, at long, lead binary, tail binary"), "json-ends"
    )
    # An element that goes on in a chunk belongs to the last start before it.
    start = F.when(F.col("tail").isNotNull(), F.col("at"))
    chunk = Window.partitionBy(*_RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.groupBy(*_RANGE).agg(F.max(start).alias("last")).select(
        *_RANGE, F.last("last", ignorenulls=True).over(earlier).alias("carried")
    )
    own = ends.select(*_RANGE, "at", "lead", F.last(start, ignorenulls=True).over(chunk).alias("own"))
    leads = own.join(carried, list(_RANGE)).select(F.coalesce("own", "carried").alias("element"), "block", "at", F.col("lead").alias("text"))
    tails = ends.select(F.col("at").alias("element"), "block", "at", F.col("tail").alias("text")).where(F.col("text").isNotNull())
    texts = leads.where(F.col("element").isNotNull()).unionByName(tails).groupBy("element").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", F.col("text").cast("string").alias("text")))).alias("parts")
    )
    # The parser stops behind the closing brace, whatever parts the elements.
    text = placed.select("text", "string", "depth").mapInArrow(_cut(True), "text binary").select(
        F.col("text").cast("string").alias("text")
    ).unionByName(texts.select(F.array_join(F.col("parts.text"), "").alias("text")))
    return text.select(F.from_json("text", schema).alias("row")).select("row.*")
