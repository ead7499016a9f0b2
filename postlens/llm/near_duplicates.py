"""MinHash near-dedup: signatures, bands, exact confirmation, connected components.

A document is the set of its distinct word shingles.  Two documents are linked when
their sets' similarity (shared / all) is at least 0.8; a component of links is a group.

1. Equal sets are one class; everything below is about classes.
2. ``HASHES`` minima of universal hash functions are a class's signature.  Classes that
   agree in all rows of a band meet in its bucket.  At 0.8 a pair misses all bands with
   probability (1 - 0.8^4)^24 = 3e-6.
3. For classes that meet anyone, the shingles found in no other such class are counted.
   They bound the similarity of any pair from above, so most pairs of a bucket that
   are not alike are never formed.
4. Each bucket's classes are compared with its member of the least such share.  Pairs
   pass if enough of their signatures agree (a pair at 0.8 fails that with probability
   1e-6) and are then confirmed on the full sets.
5. Links join classes to components.  In buckets that still hold several components, all
   pairs of classes of different components are tried too, so no link is lost to the
   choice in 4.  Where such classes fill several blocks of a bucket, they are first dealt
   to blocks at random and tried within them, again while that halves the pairs left: texts
   of one template grow together in a few such rounds of linear cost.  Then each block of
   classes outside a bucket's largest component meets all blocks of the bucket.  A task
   tries a pair in the first band that it shares, by signatures and then by full sets
   (as one product of matrices if many pairs are left), and returns confirmed links only.
6. Components come from alternating large-star and small-star steps.

Sets are compared by 64-bit hashes of shingles, classes are told apart by 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage
from . import words as w
from .common import fresh, quoted
from .components import components

WORDS = 4
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Agreeing minima that a pair needs to be compared in full: five standard deviations
#: below the mean at a similarity of 0.8.
AGREEING = 57
#: Members compared with one copy of a hub's text.
SLICE = 256
#: Members of a bucket in one block, and shingles in it; a longer text is a block of its own.
BLOCK = 1000
BLOCK_SHINGLES = 500_000
#: Pairs are counted one by one where a product of matrices takes more steps a pair than this.
STEPS = 100_000
_HAS_WORD = r"[^\x20\x09-\x0D]"


def shingle_sets(texts: list[str], length: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct shingles; ASCII letters in lower case."""
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for chunk in w.chunks(texts, overlap=length - 1):
        found = w.words(w.lower_ascii(chunk.points), chunk.blank, chunk.starts)
        hashes = found.hashes()
        cuts = np.searchsorted(found.piece, np.arange(len(chunk.starts) + 1))
        n = max(0, len(hashes) - length + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(length):
            rolled = w.mix(rolled + hashes[k : k + n])
        for p, k in enumerate(chunk.owner):
            start, end = cuts[p], cuts[p + 1]
            if end - start >= length:
                parts[k].append(rolled[start : end - length + 1])
            elif end > start and not parts[k]:
                short = np.zeros(1, np.uint64)
                for h in hashes[start:end]:
                    short = w.mix(short + h)
                parts[k].append(w.mix(short + np.uint64(end - start)))
    return [np.unique(np.concatenate(p)) if p else np.zeros(0, np.uint64) for p in parts]


def _sets_of(texts: pa.Array, rows: int = 200) -> Iterator[np.ndarray]:
    """The sets of a batch one after the other; few texts are decoded at a time."""
    for start in range(0, len(texts), rows):
        yield from shingle_sets([t or "" for t in texts.slice(start, rows).to_pylist()])


def class_of(shingles: np.ndarray) -> int | None:
    """64 bits of a digest of the set; None for the empty set."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signer(hashes: int = HASHES) -> Callable[[np.ndarray], bytes]:
    """Minima of multiply-shift functions of the shingles' upper 32 bits."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2)
    high = np.uint64(32)

    def sign(shingles: np.ndarray) -> bytes:
        least = np.full(hashes, 0xFFFFFFFF, np.uint64)
        x = shingles >> high
        for start in range(0, len(x), 1024):
            least = np.minimum(least, ((x[start : start + 1024, None] * a + b) >> high).min(0))
        return least.astype(">u4").tobytes()

    return sign


def _features(text: Column) -> Column:
    kind = pa.struct([("n", pa.int64()), ("node", pa.int64()), ("signature", pa.binary())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sign = _signer()
        for texts in batches:
            rows = [(len(s), class_of(s), sign(s) if len(s) else None) for s in _sets_of(texts)]
            yield pa.array([dict(zip(("n", "node", "signature"), r)) for r in rows], kind)

    return F.arrow_udf(run, "struct<n: bigint, node: bigint, signature: binary>")(text)


def _class_column(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([class_of(s) for s in _sets_of(texts)], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def _shingle_column(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = [s.view(np.int64) for s in shingle_sets([t or "" for t in texts.to_pylist()])]
            yield pa.array(sets, pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<bigint>")(text)


def _agreeing(a: Column, b: Column) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(len(x), -1) for x in (a, b))
        return pa.array((left == right).sum(1).astype(np.int32))

    # Types are named for Spark, since annotations of this module are strings.
    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")(a, b)


def _may_link(a: str, b: str) -> Column:
    """Whether the shingles that are in no other class leave room for a link: the shared
    ones are at most n - unique on either side, and 9 * shared >= 4 * (n + n) at 0.8."""
    shared = F.least(F.col(f"{a}.n") - F.col(f"{a}.unique"), F.col(f"{b}.n") - F.col(f"{b}.unique"))
    return 9 * shared >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _confirm(pairs: DataFrame, info: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose signatures and then full sets are alike enough.

    Members ``a`` meet their hub ``b`` in slices, so a hub of very many pairs is compared
    in many tasks, and one text at a time is held next to the hub's set."""
    signed = info.select("node", "signature")
    likely = (
        pairs.join(signed.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a")
        .join(signed.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
        .where(_agreeing(F.col("sa"), F.col("sb")) >= AGREEING)
        .select("a", "b")
    )
    likely = cut_lineage(likely, "likely-pairs")
    hubs = cut_lineage(likely.groupBy("b").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "hub-slices")
    members = likely.join(hubs, "b").select(
        F.col("a").alias("node"), F.col("b").alias("hub"),
        F.pmod(F.xxhash64("a"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"),
    )
    copies = hubs.select(
        F.col("b").alias("node"), F.col("b").alias("hub"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"),
    )
    rows = (
        members.unionByName(copies).join(texts, "node").select("hub", "slice", "role", "node", "text")
        .repartition("hub", "slice").sortWithinPartitions("hub", "slice", "role")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            names = ("hub", "slice", "role", "node")
            keys = list(zip(*(batch.column(c).to_pylist() for c in names)))
            a, b = [], []
            for (key, piece, role, node), s in zip(keys, _sets_of(batch.column("text"))):
                if role == 0:
                    hub, own = (key, piece), s
                elif hub == (key, piece):
                    shared = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * shared >= 80 * (len(own) + len(s) - shared):
                        a.append(node)
                        b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a long, b long")


def _shared(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray | None:
    """Sizes of the intersections of sets ``i[k]`` and ``j[k]``; None if that is dearer than
    to count them pair by pair.  Shingles that occur in the same sets are one column."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(place, kind="stable")
    pattern = np.add.reduceat(w.mix(owner.astype(np.uint64) + w.ODD)[order], np.cumsum(count) - count)
    several = np.nonzero(count > 1)[0]
    _, first, weight = np.unique(pattern[several], return_index=True, return_counts=True)
    left, at_left = np.unique(i, return_inverse=True)
    right, at_right = np.unique(j, return_inverse=True)
    if len(left) * len(right) * len(first) > STEPS * len(i):
        return None
    column = np.full(len(values), -1)
    column[several[first]] = np.arange(len(first))
    column = column[place]
    product = np.zeros((len(left), len(right)))
    for start in range(0, len(first), 1024):
        size = min(1024, len(first) - start)
        here = (column >= start) & (column < start + size)
        cells = np.zeros((len(sets), size))
        cells[owner[here], column[here] - start] = 1
        product += (cells[left] * weight[start : start + size]) @ cells[right].T
    return product[at_left, at_right]


def _links_of_group(group: list[tuple]) -> Iterator[tuple[int, int]]:
    """Links that join components, from rows of one pair of blocks."""
    group = list({x[5]: x for x in group}.values())  # a text may be there several times
    left, right, band = group[0][1], group[0][2], group[0][4]
    signs = np.stack([np.frombuffer(x[8], np.uint32) for x in group])
    block, component, n = (np.array([x[k] for x in group]) for k in (3, 6, 7))
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(group)):
        if left != right and block[i] != left:
            continue
        j = np.arange(i + 1, len(group)) if left == right else np.nonzero(block == right)[0]
        j = j[(component[j] != component[i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))]
        same = signs[j] == signs[i]
        first = same.reshape(len(j), BANDS, ROWS).all(2).argmax(1) == band
        agree = same.sum(1)
        good = first & (agree >= AGREEING)
        pairs.append((np.full(int(good.sum()), i), j[good], agree[good]))
    a, b, agree = (np.concatenate(x) for x in zip(*pairs)) if pairs else 3 * (np.zeros(0, int),)
    if not len(a):
        return
    used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    sets = list(_sets_of(pa.array([group[k][9] for k in used], pa.string())))
    i, j = place[: len(a)], place[len(a) :]
    counted = _shared(sets, i, j)
    sure = np.full(len(a), -1.0) if counted is None else counted
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    # The likeliest first: each link found spares all pairs of the two components.
    order = np.argsort(-agree, kind="stable")
    if counted is not None:
        total = n[a] + n[b]
        order = order[100 * sure[order] >= 80 * (total[order] - sure[order])]
    for k in order.tolist():
        x, y = root(int(component[a[k]])), root(int(component[b[k]]))
        if x == y:
            continue
        if counted is None:
            s, t = sets[i[k]], sets[j[k]]
            shared = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * shared < 80 * (len(s) + len(t) - shared):
                continue
        parent[max(x, y)] = min(x, y)
        yield group[a[k]][5], group[b[k]][5]


def _mixed(state: DataFrame) -> DataFrame:
    """``(bucket, main, rest, blocks)`` of buckets with several components: the largest one,
    the blocks that all others fill, and those of all members."""
    parts = state.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))

    def blocks(m: Column, n: Column) -> Column:
        return F.ceil(F.greatest(m / BLOCK, n / BLOCK_SHINGLES)).cast("int")

    rest = blocks(F.col("m") - F.col("h.m"), F.col("n") - F.col("h.n"))
    # Facts about buckets are written before they are joined: adaptive execution splits a
    # large bucket only in a join whose sides are plain shuffles.
    return cut_lineage(
        parts.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("n").alias("n"),
             F.max(F.struct("m", "n", "component")).alias("h"))
        .where("parts > 1")
        .select("bucket", F.col("h.component").alias("main"), rest.alias("rest"),
                (rest + blocks(F.col("h.m"), F.col("h.n"))).alias("blocks")),
        "mixed-buckets",
    )


def _links_between(state: DataFrame, mixed: DataFrame, content: DataFrame, within: int | None) -> DataFrame:
    """Links between components in ``state(bucket, band, node, n, component)``.

    Members of a bucket are dealt to blocks; each block (``within``: a seed) or each pair of
    blocks is one group of rows, of bounded size however large the bucket is."""
    members = state.join(mixed, "bucket")
    if within is not None:
        own = F.pmod(F.xxhash64("node", F.lit(within)), F.col("blocks")).cast("int")
        dealt = members.withColumn("own", own).withColumn("other", F.col("own"))
    else:
        code, main = F.xxhash64("node", F.lit(-1)), F.col("component") == F.col("main")
        own = F.when(main, F.col("rest") + F.pmod(code, F.col("blocks") - F.col("rest"))).otherwise(F.pmod(code, F.col("rest")))
        last = F.when(main, F.col("rest")).otherwise(F.col("blocks")) - 1
        dealt = members.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    rows = (
        dealt.join(content, "node")
        .select("bucket", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                "own", "band", "node", "component", "n", "signature", "text")
        .repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][:3] != row[:3]:
                    yield emit(list(_links_of_group(group)))
                    group = []
                group.append(row)
        if group:
            yield emit(list(_links_of_group(group)))

    return rows.mapInArrow(run, "a long, b long")


def _grown(links: DataFrame, known: DataFrame, content: DataFrame) -> DataFrame:
    """``(node, component)`` by ``links`` and all further links inside buckets."""
    joined, before, seed = components(links), None, 0
    while True:
        state = cut_lineage(
            known.select("bucket", "band", "node", "n").join(joined, "node", "left")
            .withColumn("component", F.coalesce("component", "node")),
            "state",
        )
        mixed = _mixed(state)
        wide, left = mixed.agg(F.max("rest"), F.sum(F.col("rest") * F.col("blocks").cast("double"))).first()
        if wide is None:
            return joined
        last = wide == 1 or (before is not None and 2 * left > before)
        more = cut_lineage(_links_between(state, mixed, content, None if last else seed), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            joined = components(links)
        if last:
            return joined
        before, seed = left, seed + 1


def _groups(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n, node)`` per document, and ``(node, root, component_id)`` per class."""
    features = cut_lineage(
        documents.select("doc_id", "text").withColumn("f", _features(F.col("text")))
        .select("doc_id", "f.n", "f.node", "f.signature"),
        "features",
    )
    classes = cut_lineage(
        features.where("n > 0").groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")),
        "classes",
    )
    bands = F.array(*(
        F.xxhash64(F.lit(k), F.substring("signature", 4 * ROWS * k + 1, 4 * ROWS)) for k in range(BANDS)
    ))
    placed = classes.select("node", F.posexplode(bands).alias("band", "bucket"))
    met = cut_lineage(
        placed.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high").select("bucket"),
        "met-buckets",
    )
    members = cut_lineage(placed.join(met, "bucket"), "members")

    candidates = classes.join(members.select("node").distinct(), "node")
    ids = candidates.select("node", F.col("rep").alias("id"))
    texts = cut_lineage(
        documents.select("doc_id", "text").alias("d")
        .join(ids.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.id")))
        .select("c.node", "d.text")
        .where(_class_column(F.col("text")) == F.col("node")),
        "texts",
    )
    unique = (
        texts.select("node", F.explode(_shingle_column(F.col("text"))).alias("shingle"))
        .groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"))
        .where("node = other").groupBy("node").agg(F.count("*").alias("unique"))
    )
    # More than a fifth of unique shingles: no link is possible.
    info = cut_lineage(
        candidates.join(unique, "node", "left").select("node", "n", "signature", F.coalesce("unique", F.lit(0)).alias("unique"))
        .where("5 * unique <= n"),
        "info",
    )
    known = cut_lineage(members.join(info.select("node", "n", "unique"), "node"), "known")
    hubs = cut_lineage(
        known.groupBy("bucket")
        .agg(F.min(F.struct((F.col("unique") / F.col("n")).alias("share"), "node", "n", "unique")).alias("h"))
        .select("bucket", "h.node", "h.n", "h.unique"),
        "hubs",
    )
    first = cut_lineage(
        known.alias("m").join(hubs.alias("h"), "bucket").where("m.node != h.node").where(_may_link("m", "h"))
        .select(F.col("m.node").alias("a"), F.col("h.node").alias("b")).distinct(),
        "first-pairs",
    )
    links = cut_lineage(_confirm(first, info, texts), "links")
    joined = _grown(links, known, texts.join(info.select("node", "signature"), "node"))
    rooted = classes.join(joined, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return features.select("doc_id", "n", "node"), rooted.join(smallest, "root").select("node", "root", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    NULL, empty and blank texts have no shingles and stand alone.  Texts of one to three
    words are one shingle.  A NULL doc_id is never the smallest; a group without any id
    has component NULL.  Repeated rows are members of one group.  Rows with one doc_id
    and different texts are told apart by their texts.
    """
    rows, groups = _groups(documents)
    return rows.join(groups, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group, that of its smallest doc_id.

    Of several rows with that id in one group, one stays.  Documents without words stay."""
    rows, groups = _groups(documents)
    key, node = fresh(documents, "key__", "node__")
    first = (
        rows.join(groups, "node").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("k"))
        .select(F.xxhash64("k.doc_id", "k.node").alias(key), F.col("k.node").alias(f"{node}_kept"))
    )
    worded = F.coalesce(quoted("text").rlike(_HAS_WORD), F.lit(False))
    marked = documents.where(worded).withColumn(node, _class_column(quoted("text"))).withColumn(
        key, F.xxhash64(quoted("doc_id"), quoted(node))
    )
    kept = marked.join(first, key).where(quoted(node) == quoted(f"{node}_kept")).dropDuplicates([key])
    columns = [quoted(c) for c in documents.columns]
    return kept.select(*columns).unionByName(documents.where(~worded).select(*columns))


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS u(i)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT rid, rid FROM w),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, ways.b FROM r JOIN ways ON r.b = ways.a) SELECT * FROM r),
c AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM reach r JOIN w ON w.rid = r.b GROUP BY r.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w LEFT JOIN n USING (rid) JOIN c USING (rid)
"""
