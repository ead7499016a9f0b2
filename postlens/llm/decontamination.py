"""Benchmark decontamination: Wu-Manber search for many word sequences at once.

Patterns are the windows of all benchmark items.  The search looks at the last block
of words (two words; one for patterns of a single word) of the place where a pattern
could end.  The shift table says how far the place may move on without missing a
pattern, so most words are never compared; at shift 0 the bucket of the block names
the patterns that end so, and their words are compared one by one.

Patterns of one length are searched together, since the shortest pattern limits the
shifts.  Words are numbered by the benchmark's vocabulary; every other word is 0 and
equals no word of a pattern, so comparing numbers is comparing words.

The benchmark is the stated pattern set.  Tables are built from blocks of items with
at most ``BLOCK_WORDS`` words, which bounds what is broadcast; one pass over the
documents is made for each block, and passes add up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage
from .common import fresh, quoted

WINDOW = 10
#: Benchmark words in one block of patterns.
BLOCK_WORDS = 2_000_000

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
FOUND = "struct<n_words: bigint, hit: binary, n_hit: bigint, items: array<string>>"


def split_words(text: str) -> list[bytes]:
    """ASCII letters in lower case; ASCII other than letters and digits separates."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


class _Search:
    """Patterns of one length with their shift table and buckets."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.patterns = patterns
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for p in patterns:
            for end in range(self.block, length + 1):
                block = p[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(p[length - self.block :], []).append(p)

    def find(self, ids: list[int], mark: Callable[[int, int], None], items: set[int]) -> None:
        length, block, far = self.length, self.block, self.far
        shift, buckets, patterns = self.shift.get, self.buckets, self.patterns
        end, n = length, len(ids)
        while end <= n:
            last = tuple(ids[end - block : end])
            move = shift(last, far)
            if move:
                end += move
                continue
            here = tuple(ids[end - length : end])
            for p in buckets[last]:
                if p == here:
                    mark(end - length, end)
                    items.update(patterns[p])
            end += 1


def _compile(items: list[tuple[str | None, str]], window: int):
    """Vocabulary, item names, and one search for each length of pattern."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict[tuple[int, ...], list[int]]] = {}
    names: dict[str, int] = {}
    for name, text in items:
        ids = [vocabulary.setdefault(x, len(vocabulary) + 1) for x in split_words(text)]
        if not ids:
            continue
        owner = [] if name is None else [names.setdefault(name, len(names))]
        length = min(window, len(ids))
        for k in range(len(ids) - length + 1):
            known = by_length.setdefault(length, {}).setdefault(tuple(ids[k : k + length]), [])
            known += [x for x in owner if x not in known]
    return vocabulary, list(names), [_Search(n, p) for n, p in sorted(by_length.items())]


def _scan(compiled) -> Callable[[str, bytes | None, list[str] | None], dict]:
    vocabulary, names, searches = compiled
    number = vocabulary.get

    def scan(text: str, hit_before: bytes | None, items_before: list[str] | None) -> dict:
        ids = [number(x, 0) for x in split_words(text)]
        ends: dict[int, int] = {}

        def mark(start: int, end: int) -> None:
            ends[start] = max(end, ends.get(start, 0))

        items: set[int] = set()
        for search in searches:
            search.find(ids, mark, items)
        if not ends and hit_before is None:
            return {"n_words": len(ids), "hit": None, "n_hit": 0, "items": []}
        hit = np.zeros(len(ids), bool)
        if hit_before is not None:
            hit |= np.unpackbits(np.frombuffer(hit_before, np.uint8), count=len(ids)).astype(bool)
        for start, end in ends.items():
            hit[start:end] = True
        return {"n_words": len(ids), "hit": np.packbits(hit).tobytes(), "n_hit": int(hit.sum()),
                "items": sorted({*(items_before or ()), *(names[i] for i in items)})}

    return scan


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most ``block_words`` words; a longer item is a block of its own.

    The benchmark passes through the driver item by item, one block at a time."""
    block, room = [], block_words
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        n = len(split_words(row["text"]))
        if block and n > room:
            yield block
            block, room = [], block_words
        block.append((row["item_id"], row["text"]))
        room -= n
    yield block


def _search_function(shared, window: int) -> Callable[..., Column]:
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.binary()), ("n_hit", pa.int64()),
                      ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        scan = _scan(_compile(shared.value, window))
        for texts, hits, items in batches:
            rows = zip(texts.to_pylist(), hits.to_pylist(), items.to_pylist())
            yield pa.array([scan(t or "", h, i) for t, h, i in rows], kind)

    return F.arrow_udf(run, FOUND)


def with_hits(documents: DataFrame, benchmark: DataFrame, name: str, window: int = WINDOW,
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` with a column ``name``: n_words, n_hit, items (sorted) and the hit
    words as bits.

    NULL and empty texts have no words and no hits.  Items without words have no
    windows; items with a NULL id mark words but are not named.  Equal items are
    reported each.  Repeated documents are searched one by one.  All other columns are
    kept as they are.
    """
    spark, found, done = documents.sparkSession, documents, 0
    for block in _blocks(benchmark, block_words):
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_WORDS words, or one item

        search = _search_function(shared, window)
        if done:
            before = (quoted(name)["hit"], quoted(name)["items"])
            found = cut_lineage(found, "decontamination")
        else:
            before = (F.lit(None).cast("binary"), F.lit(None).cast("array<string>"))
        found = found.withColumn(name, search(F.col("text"), *before))
        done += 1
    return found


def contamination(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    (name,) = fresh(documents, "found")
    found = with_hits(documents.select("doc_id", "text"), benchmark, name, **parameters)
    return found.select(
        "doc_id",
        F.col(name)["n_words"].alias("n_words"),
        F.col(name)["n_hit"].alias("n_hit"),
        F.size(F.col(name)["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col(name)["items"]), 256).alias("items_sha256"),
        (F.col(name)["n_hit"] > 0).alias("contaminated"),
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``documents`` without those that hold a benchmark window."""
    (name,) = fresh(documents, "found")
    found = with_hits(documents, benchmark, name, **parameters)
    return found.where(quoted(name)["n_hit"] == 0).select(*(quoted(c) for c in documents.columns))


ORACLE_SQL = """
WITH lower_docs AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM (
    SELECT item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - k + 2)) AS u(i)),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM lower_docs, lengths, unnest(range(1, len(w) - k + 2)) AS u(i)),
found AS (SELECT rid, p.k, i, item_id FROM places p JOIN windows v ON p.k = v.k AND p.win = v.win),
hit AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT rid, k, i FROM found), unnest(range(0, k)) AS u(j)
        GROUP BY rid),
named AS (SELECT rid, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids,
                 count(DISTINCT item_id) AS n_items FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""
