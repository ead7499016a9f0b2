"""Collocations from a weighted de Bruijn graph of words.

A text is cut into pieces, a piece into words.  Nodes of the graph are runs of
``LONGEST - 1`` words, an edge is a run of ``LONGEST`` words between the two nodes that
overlap in it, and its weight is how often it occurs.

1. Edges are counted in every task first and then added up by the node that they leave,
   together with the short ends of pieces, which no edge leaves.  Nodes that hold a large
   part of a sample's edges are dealt to ``SLICES`` tasks; that changes no count.
2. Counts of shorter phrases are not read from the texts again: every occurrence of a
   phrase is followed by a word, or it ends its piece.  So a node's count is what flows
   out of it plus the pieces that end there, and the same holds one word shorter.  Rare
   edges and nodes are dropped as soon as their weight has flowed into what is shorter.
3. Only phrases that reach the least count go on.  Unary paths among their edges (no
   branch and no junction at the nodes between) are compacted: a path is one row with its
   words and weights.  Paths are also cut at one node in ``CUT``, chosen by hash, and are
   followed by doubling for at most ``ROUNDS`` rounds, so rows are of bounded size; what
   is longer stays in several rows.  Inside a path the longer phrases around a node are
   its neighbours in the row; only nodes at path ends meet in a shuffle.
4. Cuts of a candidate are scored with exact decimals, and the best per language are
   ranked in two steps, so that no task sees all candidates of a language.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage

LONGEST = 3
LEAST_COUNT = 10
TOP = 2000
#: A phrase goes if a longer one around it has this share of its count, per cent.
SHARE = 50
SCALE = 1_000_000
#: Distinct grams that a task holds before it hands on what it has counted.
HELD = 500_000
#: One text in so many tells which nodes are hot: those with that share of its edges.
SAMPLE, HOT_SHARE = 128, 1 / 1000
SLICES = 64
CUT = 32
ROUNDS = 9
#: Parts in which a language is ranked first.
PARTS = 32
_PIECE_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
#: What comes out of a task: a node with its kind and language, as lines of one key, so that
#: rows are short and sort by their words.  Kind is empty for nodes, ``s`` and a number
#: for slices of hot ones, ``e`` and the number of words for shorter ends of pieces.
_GRAMS = "key string, next string, n long"


def _count(longest: int, large_nodes: dict[str, list[bytes]] | None = None):
    """Task function: texts to counted edges, and to counted ends of pieces (``next`` NULL)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Counter]] = {}
        hot = large_nodes or {}
        shifts = range(longest)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, counters in held.items():
                for k, counter in enumerate(counters, 1):
                    grams, counts = pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())
                    for start in range(0, len(grams), 50_000):
                        part = grams.slice(start, 50_000)
                        n = len(part)
                        last = pa.nulls(n, pa.binary())
                        if k == longest:
                            halves = pc.split_pattern(part, b" ", max_splits=1, reverse=True).flatten()
                            part, last = halves.take(pa.array(np.arange(0, 2 * n, 2))), halves.take(pa.array(np.arange(1, 2 * n, 2)))
                        kind = b"\n%s\n" % (b"" if k >= longest - 1 else b"e%d" % k) + lang.encode()
                        keys = pc.binary_join_element_wise(part, pa.scalar(kind, pa.binary()), pa.scalar(b"", pa.binary()))
                        if hot.get(lang) and k >= longest - 1:
                            large = pc.is_in(part, value_set=pa.array(hot[lang], pa.binary()))
                            places = pc.indices_nonzero(large)
                            cut = [b"%s\ns%d\n%s" % (g, zlib.crc32(x or b"") % SLICES, lang.encode())
                                   for g, x in zip(part.take(places).to_pylist(), last.take(places).to_pylist())]
                            keys = pc.replace_with_mask(keys, large, pa.array(cut, pa.binary()))
                        yield pa.RecordBatch.from_arrays(
                            [keys.cast(pa.string()), last.cast(pa.string()), counts.slice(start, 50_000)], ["key", "next", "n"]
                        )
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang, text in zip(langs, batch.column("text")):
                counters = held.setdefault(lang, [Counter() for _ in range(longest)])
                start, body = 0, text.as_buffer().to_pybytes().lower()
                while start < len(body):
                    # A very long text is counted in parts, cut where a piece ends.
                    cut = _PIECE_ENDS.search(body, start + (1 << 20))
                    end = cut.end() if cut else len(body)
                    # One update for all pieces; most of them are short.
                    grams: list[list[bytes]] = [[] for _ in range(longest)]
                    edges = grams[-1]
                    for piece in _PIECE_ENDS.split(body[start:end]):
                        words = piece.split()
                        if len(words) >= longest:
                            edges += map(b" ".join, zip(*[words[k:] for k in shifts]))
                        for k in range(1, min(len(words) + 1, longest)):
                            grams[k - 1].append(b" ".join(words[-k:]))
                    for counter, found in zip(counters, grams):
                        counter.update(found)
                    start = end
                    if sum(map(len, chain.from_iterable(held.values()))) > HELD:
                        yield from rows()
                        counters = held.setdefault(lang, [Counter() for _ in range(longest)])
        yield from rows()

    return run


def _words(gram: Column) -> Column:
    return F.split(gram, " ")


def _fields(rows: DataFrame) -> DataFrame:
    """``rows`` with the node, kind and lang of their key."""
    rows = rows.withColumn("node", F.substring_index("key", "\n", 1))
    rows = rows.withColumn("after", F.expr("substring(key, char_length(node) + 2)"))
    rows = rows.withColumn("kind", F.substring_index("after", "\n", 1))
    return rows.withColumn("lang", F.expr("substring(after, char_length(kind) + 2)")).drop("after")


def _hot_nodes(texts: DataFrame, longest: int) -> dict[str, list[bytes]]:
    """Nodes with a large share of the edges of a sample, at most ``1 / HOT_SHARE``.

    They only decide where rows are added up."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    nodes = cut_lineage(
        _fields(sample.mapInArrow(_count(longest), _GRAMS).where("next IS NOT NULL")).groupBy("lang", "node").agg(F.sum("n").alias("n")),
        "sampled-nodes",
    )
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = nodes.where(F.col("n") > max(total * HOT_SHARE, SLICES)).collect()
    found: dict[str, list[bytes]] = {}
    for r in hot:
        found.setdefault(r["lang"], []).append(r["node"].encode())
    return found


def flow(documents: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT) -> DataFrame:
    """``(lang, edge, n, k, gram, f, whole)``: what the graph's edges and nodes hand down.

    ``edge`` and its count ``n`` are given for edges that occur ``least`` times.  ``gram``
    and ``f`` are nodes of that count, where several rows of one node add up (``whole``);
    all that is rarer or shorter counts for its first ``k`` words, where rows add up to
    phrases of ``k`` words."""
    texts = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    counted = texts.mapInArrow(_count(longest, _hot_nodes(texts, longest)), _GRAMS)
    # Tasks have added up already; all that leaves a node meets here, in one shuffle.
    edges = counted.repartition("key").groupBy("key", "next").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("key").orderBy(F.asc_nulls_first("next"))
    sums = edges.withColumns({
        "f": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "place": F.row_number().over(own),
    })
    frequent = F.col("next").isNotNull() & (F.col("n") >= least)
    first = F.col("place") == 1
    kind = F.col("kind")
    # A slice is a part of its node's count, so it goes on whatever its own sum is.
    whole = ~kind.startswith("e") & ((F.col("f") >= least) | kind.startswith("s"))
    shorter = F.when(kind.startswith("e"), F.substring(kind, 2, 9).try_cast("int")).otherwise(longest - 2)
    return _fields(sums.where(frequent | first)).select(
        "lang", F.when(frequent, F.concat_ws(" ", "node", "next")).alias("edge"), F.when(frequent, F.col("n")).alias("n"),
        F.when(first, F.when(whole, longest - 1).otherwise(shorter)).alias("k"),
        F.when(first, F.when(whole, F.col("node")).otherwise(F.substring_index("node", " ", longest - 2))).alias("gram"),
        F.when(first, F.col("f")).alias("f"), F.when(first, whole).alias("whole"),
    )


def phrase_counts(flows: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases that occur ``least`` times, ``(lang, k, gram, f)``, and the
    words of each language, ``(lang, n)``, both added up from :func:`flow`."""
    whole = flows.where("whole")
    edges = flows.where("edge IS NOT NULL")
    counts = edges.select("lang", F.lit(longest).alias("k"), F.col("edge").alias("gram"), F.col("n").alias("f"))
    level = whole.groupBy("lang", "gram").agg(F.sum("f").alias("f"))
    for k in range(longest - 1, 0, -1):
        if k < longest - 1:
            level = _handed_down(flows, level, k)
        level = cut_lineage(level, f"flow-{k}")
        counts = counts.unionByName(level.where(F.col("f") >= least).select("lang", F.lit(k).alias("k"), "gram", "f"))
    return counts, _handed_down(flows, level, 0).select("lang", F.col("f").alias("n"))


def _handed_down(flows: DataFrame, longer: DataFrame, k: int) -> DataFrame:
    """Counts of the phrases of ``k`` words: those one word longer, and what counts for them."""
    heads = longer.select("lang", F.substring_index("gram", " ", k).alias("gram"), "f")
    rest = flows.where(~F.col("whole") & (F.col("k") == k)).select("lang", "gram", "f")
    return heads.unionByName(rest).groupBy("lang", "gram").agg(F.sum("f").alias("f"))


def compact(edges: DataFrame, longest: int = LONGEST, cut: int = CUT, rounds: int = ROUNDS) -> DataFrame:
    """Unary paths of ``edges(lang, gram, f)``: ``(lang, words, weights)``, one weight for
    each run of ``longest`` words.  Every edge is in one path."""
    words = _words(F.col("gram"))
    rows = edges.select(
        "lang", "gram", "f", F.array_join(F.slice(words, 1, longest - 1), " ").alias("from"),
        F.array_join(F.slice(words, 2, longest - 1), " ").alias("to"),
    )
    touching = rows.select("lang", F.col("from").alias("node"), F.lit(1).alias("leaves"), F.lit(0).alias("enters"), "gram").unionByName(
        rows.select("lang", F.col("to").alias("node"), F.lit(0).alias("leaves"), F.lit(1).alias("enters"), "gram")
    )
    # The one edge into a unary node comes before the one edge out of it.
    steps = (
        touching.groupBy("lang", "node").agg(
            F.sum("leaves").alias("outward"), F.sum("enters").alias("inward"),
            F.min(F.when(F.col("enters") == 1, F.col("gram"))).alias("before"),
            F.min(F.when(F.col("leaves") == 1, F.col("gram"))).alias("after"),
        )
        .where("outward = 1 AND inward = 1 AND before != after")
        .where(F.pmod(F.xxhash64("lang", "node"), F.lit(cut)) != 0)
        .select("lang", F.col("after").alias("gram"), F.col("before").alias("at"))
    )
    # ``at`` is an earlier edge of the path, ``back`` edges before this one.
    linked = cut_lineage(rows.select("lang", "gram", "f").join(steps, ["lang", "gram"], "left"), "path-edges")
    first = linked.where("at IS NULL").select("lang", "gram", "f", F.col("gram").alias("at"), F.lit(0).alias("back"))
    state = linked.where("at IS NOT NULL").select("lang", "gram", "f", "at", F.lit(1).alias("back"), F.lit(True).alias("open"))
    for _ in range(rounds + 1):
        # Where the earlier edge is not in the table, it is the first of its path.
        there = state.select("lang", F.col("gram").alias("at"), F.col("at").alias("next"), F.col("back").alias("more"))
        state = cut_lineage(
            state.join(there, ["lang", "at"], "left").select(
                "lang", "gram", "f", F.coalesce("next", "at").alias("at"),
                (F.col("back") + F.coalesce("more", F.lit(0))).alias("back"), F.col("next").isNotNull().alias("open"),
            ),
            "path-steps",
        )
        if state.where("open").isEmpty():
            break
    placed = first.unionByName(
        state.select("lang", "gram", "f", F.when(F.col("open"), F.col("gram")).otherwise(F.col("at")).alias("at"),
                     F.when(F.col("open"), F.lit(0)).otherwise(F.col("back")).alias("back"))
    )
    # At most 2^rounds + 1 edges have one first edge.
    paths = placed.groupBy("lang", "at").agg(F.sort_array(F.collect_list(F.struct("back", "gram", "f"))).alias("e"))
    return paths.select(
        "lang",
        F.concat(_words(F.col("at")), F.transform(F.slice("e", 2, F.size("e")), lambda e: F.element_at(_words(e["gram"]), -1))).alias("words"),
        F.transform("e", lambda e: e["f"]).alias("weights"),
    )


def _longer(paths: DataFrame, longest: int) -> DataFrame:
    """``(lang, gram, longer)``: per node the greatest weight of an edge that holds it."""
    size = longest - 1
    spots = paths.select(
        "lang", "words", "weights", F.explode(F.sequence(F.lit(0), F.size("weights"))).alias("i")
    ).select(
        "lang", F.array_join(F.slice("words", F.col("i") + 1, size), " ").alias("gram"),
        F.greatest(F.get("weights", F.col("i") - 1), F.get("weights", F.col("i"))).alias("longer"),
        ((F.col("i") > 0) & (F.col("i") < F.size("weights"))).alias("inner"),
    )
    ends = spots.where("NOT inner").groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    return spots.where("inner").select("lang", "gram", "longer").unionByName(ends)


def collocations(
    documents: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT, top: int = TOP, share: int = SHARE
) -> DataFrame:
    """Per language its ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    NULL lang counts as ``und``.  NULL, empty and blank texts have no words.  Very long
    texts are counted in parts that end where a piece does.  Repeated rows count each
    time.  Ties in score and count go by the phrase's bytes, so ranks are unique.  Other
    columns than text and lang are not read; an empty table has an empty result.
    """
    flows = cut_lineage(flow(documents, longest, least), "flows")
    counts, totals = phrase_counts(flows, longest, least)
    counts = cut_lineage(counts, "phrase-counts")
    paths = cut_lineage(compact(counts.where(F.col("k") == longest), longest), "paths")

    # Longest phrases are read off the paths.  A shorter one goes if one word more has its
    # share: a longer phrase is no more frequent than the shorter ones in it.
    spans = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("weights") - 1).alias("i"), F.col("weights").alias("f")))
    kept = paths.select("lang", "words", spans.alias("e")).select(
        "lang", F.array_join(F.slice("words", F.col("e.i") + 1, longest), " ").alias("phrase"), F.col("e.f").alias("a")
    )
    for k in range(2, longest):
        if k == longest - 1:
            longer = _longer(paths, longest)
        else:
            word = _words(F.col("gram"))
            ends = F.array(F.slice(word, 1, k), F.slice(word, 2, k))
            longer = (
                counts.where(F.col("k") == k + 1).select("lang", F.explode(ends).alias("w"), "f")
                .groupBy("lang", F.array_join("w", " ").alias("gram")).agg(F.max("f").alias("longer"))
            )
        shorter = counts.where(F.col("k") == k).join(longer, ["lang", "gram"], "left")
        kept = kept.unionByName(
            shorter.where(F.coalesce(100 * F.col("longer") < share * F.col("f"), F.lit(True)))
            .select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"))
        )

    word = _words(F.col("phrase"))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(word) - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(word, 1, F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(word, F.col("cut") + 1, longest), " ").alias("right"),
    )
    known = counts.where(F.col("k") < longest)
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)"),
                            (whole("l") * whole("r")).cast("decimal(38,0)"))
    scored = (
        cuts.join(known.select("lang", F.col("gram").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(known.select("lang", F.col("gram").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .withColumn("score", score)
        .groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("c"))
        .select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near_top = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order)))
    # At most PARTS * top rows a language are left for one task.
    ranked = near_top.where(F.col("place") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    )
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


ORACLE_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, any_value(w[i:i + k - 1]) AS ws, count(*) AS f,
         lang || chr(10) || g AS key
  FROM w, (VALUES (1), (2), (3)) AS k(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, g, max(f) AS longer
  FROM (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS g, f FROM c WHERE k = 3)
  GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN longer l ON c.k = 2 AND c.lang = l.lang AND c.g = l.g WHERE coalesce(100 * longer < 50 * c.f, true)),
cut AS (
  SELECT kept.*, i, lang || chr(10) || array_to_string(ws[1:i], ' ') AS left_key,
         lang || chr(10) || array_to_string(ws[i + 1:], ' ') AS right_key
  FROM kept, unnest(range(1, kept.k)) AS u(i)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, l.f AS l, r.f AS r, i, (1000000::HUGEINT * c.f * c.f // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut c JOIN f l ON l.key = left_key JOIN f r ON r.key = right_key),
best AS (FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1)
SELECT lang, rank, g AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best) JOIN n USING (lang)
WHERE rank <= 2000
"""
