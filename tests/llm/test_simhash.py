import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from postlens.llm import simhash
from tests.conftest import SF
from tests.llm.plain import ASCII_LOWER


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=2):
    """Smallest value reachable from each of the distinct values."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {v: find(v) for v in root}


def plain(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(prints)
    out = []
    for (doc, _), p in zip(rows, prints):
        ids = [d for (d, _), q in zip(rows, prints) if root[q] == root[p] and d is not None]
        out.append((doc, f"{p:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def found(documents, **options):
    return sorted((tuple(r) for r in simhash.near_duplicates(documents, **options).collect()), key=repr)


def test_masks_cover_every_pair_of_bits():
    tables = simhash.masks()
    assert len(tables) == 7
    assert all(any(not t >> a & 1 and not t >> b & 1 for t in tables) for a in range(64) for b in range(64))


def test_given_documents_equal_plain_version(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(documents) == plain([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "one two three four"), (5, "ONE two three four"), (5, "one two three four"),
            (6, "é"), (7, "É"), (8, "two words"), (9, long), (10, long + " end"), (None, "stands alone here"), (11, "a b c\x0bd e")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fingerprint", "component", "table", "a.b"):
        documents = documents.withColumn(name, F.lit(1))
    assert found(documents, hot_rows=2) == plain(rows)
    assert found(documents.limit(0)) == []


@pytest.mark.parametrize("block", [2, 5, 64])
def test_links_join_what_all_pairs_join(spark, block):
    # Runs of values few bits apart, many in one bucket, and far ones.
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for start in (rng.getrandbits(64), 0, (1 << 64) - 1):
        for _ in range(150):
            values.add(start)
            for _ in range(rng.choice((1, 2, 3))):
                start ^= 1 << rng.choice((0, 1, 2, 7, 14, 30, 31, 62, 63))
    signed = [(simhash._signed(v),) for v in values]
    links = simhash.covering_links(spark.createDataFrame(signed, "fingerprint long"), block=block).collect()
    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    root = {v[0]: v[0] for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        root[find(a)] = find(b)
    groups, expected = {}, {}
    for v in values:
        groups.setdefault(find(simhash._signed(v)), set()).add(v)
    for v, r in plain_components(values).items():
        expected.setdefault(r, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    # In small buckets links are fewer than members, in large ones values are.
    assert len(links) <= 7 * 29 * len(values)
    with pytest.raises(ValueError):
        simhash.covering_links(spark.range(1).withColumnRenamed("id", "fingerprint"), radius=3)
