"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has bit i set where more than half of its shingles' hashes have it.
Fingerprints that differ in at most ``RADIUS`` bits are linked; a component of links is a
group.

Each bit position is given a non-zero vector of ``RADIUS + 1`` binary digits.  There is
one table for each non-zero vector v, and its mask holds the positions whose vector has
an odd product with v.  For any ``RADIUS`` positions some v is orthogonal to all of their
vectors, so that table's mask ignores every bit in which a pair differs: each pair within
the radius meets in a bucket of some table, none by luck (Pagh, SODA 2016).

Buckets of up to ``BLOCK`` fingerprints are compared pair by pair.  In larger ones each
fingerprint names all values within half the radius in the bits that the mask ignores.
Two fingerprints of a bucket are within the radius exactly if they name a common value,
and few can name the same one, so the work is linear however large the bucket is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage
from .components import components

WORDS = 3
SEED = 42
BITS = 64
RADIUS = 2
#: Fingerprints of a bucket that are compared pair by pair.
BLOCK = 64
#: Rows of one fingerprint that meet in one task.
HOT_ROWS = 500_000
#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Positions that each table compares, as one number per table."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if ((1 + i % vectors) & v).bit_count() & 1) for v in range(1, vectors + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of some ``PIECE`` bytes, cut at white space."""
    start = 0
    while len(text) - start > PIECE:
        cut = _BLANK.search(text, start + PIECE)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.end()
    yield text[start:]


def fingerprint(text: bytes, hash64) -> int:
    """Signed 64 bits for a UTF-8 text; 0 without words.  ``hash64(bytes, seed)`` is XXH64."""
    ones, n, words = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces(text):
        words += piece.lower().split()
        if len(words) >= WORDS:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(WORDS))))
            hashes = np.fromiter(map(hash64, shingles, repeat(SEED)), np.uint64, len(words) - WORDS + 1)
            ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            n += len(hashes)
            words = words[1 - WORDS :]
    if not n and words:
        return _signed(hash64(b" ".join(words), SEED))
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _fingerprint_column(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh64_intdigest

        for texts in batches:
            yield pa.array([fingerprint(t.as_buffer().to_pybytes(), xxh64_intdigest) if t.is_valid else 0
                            for t in texts], pa.int64())

    return F.arrow_udf(run, "bigint")(text.cast("binary"))


def _within(radius: int):
    """Links that join what is alike in one small bucket, at most one fewer than members."""

    def links(members: list[int]) -> list[dict[str, int]]:
        values = np.sort(np.array(members, np.int64))
        bits = values.view(np.uint64)
        near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
        waiting, found = set(range(len(values))), []
        while waiting:
            reached = [min(waiting)]
            waiting.discard(reached[0])
            for i in reached:
                new = [j for j in waiting if near[i, j]]
                waiting.difference_update(new)
                reached += new
                found += [{"a": int(values[i]), "b": int(values[j])} for j in new]
        return found

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for buckets in batches:
            yield pa.array([links(m) for m in buckets.to_pylist()], kind)

    return F.arrow_udf(run, "array<struct<a: bigint, b: bigint>>")


def covering_links(fingerprints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between the distinct values of ``fingerprints(fingerprint)``.

    Every link differs in at most ``radius`` bits (an even number), and the links have the
    same components as all such pairs have.  Links may repeat."""
    if radius < 2 or radius % 2:
        raise ValueError("the radius is an even number of bits")
    tables = masks(radius)
    value = F.col("fingerprint")
    placed = fingerprints.select(
        value, F.posexplode(F.array(*(value.bitwiseAND(F.lit(_signed(m))) for m in tables))).alias("table", "key")
    )
    met = cut_lineage(
        placed.groupBy("table", "key").agg(F.count("*").alias("m")).where("m > 1"), "met-buckets"
    )
    members = cut_lineage(placed.join(met, ["table", "key"]), "bucket-members")

    # At most ``block`` members reach one array.
    small = (
        members.where(F.col("m") <= block).groupBy("table", "key").agg(F.collect_list("fingerprint").alias("members"))
        .select(F.inline(_within(radius)(F.col("members"))))
    )
    changes = []
    for mask in tables:
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        changes.append([_signed(sum(c)) for k in range(radius // 2 + 1) for c in combinations(free, k)])
    change = F.explode(F.get(F.array(*(F.array(*map(F.lit, c)) for c in changes)), F.col("table")))
    # A value is named by no more members than there are changes.
    large = (
        members.where(F.col("m") > block).select("table", "fingerprint", change.alias("change"))
        .select("table", "fingerprint", value.bitwiseXOR(F.col("change")).alias("middle"))
        .groupBy("table", "middle").agg(F.collect_set("fingerprint").alias("near")).where(F.size("near") > 1)
        .select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a != b").distinct()
    )
    return small.unionByName(large)


def near_duplicates(documents: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Texts of fewer than three words have one shingle.  NULL, empty and blank texts have
    fingerprint zero and are linked like any other.  Very long texts are read in pieces.
    A NULL doc_id is never the smallest; a group without any id has component NULL.
    Repeated rows and equal ids stay rows of their own.  Only doc_id and text are read,
    so other columns may have any name; an empty table has an empty result.
    """
    marked = cut_lineage(
        documents.select("doc_id", _fingerprint_column(F.col("text")).alias("fingerprint")), "fingerprints"
    )
    classes = cut_lineage(
        marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")),
        "fingerprint-classes",
    )
    links = cut_lineage(covering_links(classes.select("fingerprint")), "links")
    joined = components(links).withColumnRenamed("node", "fingerprint")
    grouped = cut_lineage(joined.join(classes, "fingerprint"), "grouped")
    # Written before it is joined, so that a component of very many values can be split.
    smallest = cut_lineage(grouped.groupBy("component").agg(F.min("least").alias("id")), "component-ids")
    tied = grouped.join(smallest, "component").select("fingerprint", F.lit(True).alias("tied"), "id")
    named = cut_lineage(
        classes.join(tied, "fingerprint", "left").select(
            "fingerprint", "m", F.when(F.col("tied"), F.col("id")).otherwise(F.col("least")).alias("component_id")
        ),
        "named",
    )
    # A fingerprint of very many rows is cut into slices, its one row of names repeated.
    hot = cut_lineage(
        named.where(F.col("m") > hot_rows).select("fingerprint", F.ceil(F.col("m") / hot_rows).cast("int").alias("slices")), "hot"
    )
    slices = F.coalesce("slices", F.lit(1))
    rows = marked.join(hot, "fingerprint", "left").withColumn("slice", F.pmod(F.xxhash64("doc_id"), slices).cast("int"))
    names = named.join(hot, "fingerprint", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return rows.join(names.drop("slices", "m"), ["fingerprint", "slice"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
