import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import near_duplicates as nd
from postlens.llm import words as w
from postlens.llm.components import components
from tests.llm import plain

SCHEMA = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], SCHEMA)


def result(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.random():.9f}"
    return " ".join(out)


def test_equals_all_pairs_with_groups_around_the_limit(spark):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(14):
            rows.append((len(rows), edited(base, rng.choice([0, 0, 1, 1, 2, 3, 5]) * len(base) // 60, rng)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", " \t ", "One two", "one TWO", "one two three", "É é", "é é"])]
    assert result(nd.near_duplicates(docs(spark, rows))) == plain.near_duplicates(rows)


def templated(rng, rows):
    """Pages of one template with six of twenty exchangeable blocks."""
    frame = [f"t{k}" for k in range(150)]
    blocks = [[f"b{k}x{i}" for i in range(8)] for k in range(20)]
    return [" ".join(frame + sum((blocks[k] for k in sorted(rng.sample(range(20), 6))), [])) for _ in range(rows)]


@pytest.mark.parametrize("steps", [0, nd.STEPS])
def test_templated_texts_in_many_blocks_equal_all_pairs(spark, monkeypatch, steps):
    monkeypatch.setattr(nd, "BLOCK", 12)
    monkeypatch.setattr(nd, "STEPS", steps)
    rng = random.Random(8)
    rows = list(enumerate(templated(rng, 160)))
    assert result(nd.near_duplicates(docs(spark, rows))) == plain.near_duplicates(rows)


def test_intersections_as_a_product():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    sets += sets[:5]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(10), np.arange(5, 35)))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert nd._shared(sets, i, j).tolist() == want


def test_null_ids_repeated_rows_and_ties(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(None, text), (7, text), (7, text), (3, text + " end"), (9, "alone in the world"), (9, text), (None, "nobody knows this one")]
    assert result(nd.near_duplicates(docs(spark, rows))) == plain.near_duplicates(rows)
    kept = nd.keep_one(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [
        (-1, "nobody knows this one"), (3, text + " end"), (9, "alone in the world")]


def test_empty_table_and_clashing_columns(spark):
    none = docs(spark, [])
    assert nd.near_duplicates(none).count() == 0 and nd.keep_one(none).count() == 0
    odd = docs(spark, [(1, "a b c d e"), (2, "a b c d e")])
    for c in ("node", "key__", "kept", "component_id", "n", "a.b"):
        odd = odd.withColumn(c, F.lit(None).cast("string"))
    kept = nd.keep_one(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_long_texts_are_cut_without_a_trace():
    rng = np.random.default_rng(1)
    text = " ".join(map(str, rng.integers(0, 500, 3000))) + "\n" + "y" * 4000 + "\ttail of it all"
    whole = w.chunks([text])
    assert sum(len(c.owner) for c in whole) == 1
    saved = w.CHUNK
    try:
        reference = nd.shingle_sets([text, "short"])
        pieces = list(w.chunks([text, "short"], 3, 1000))
        assert len({id(c) for c in pieces}) > 5
        original = w.chunks
        w.chunks = lambda t, overlap=0, size=1000: original(t, overlap, 1000)
        again = nd.shingle_sets([text, "short"])
    finally:
        w.CHUNK, w.chunks = saved, original
    assert all((a == b).all() for a, b in zip(reference, again))


def test_components_of_a_chain_a_star_and_loops(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 160)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (0, 1), (1, 0)], "a long, b long")
    found = dict(tuple(r) for r in components(edges).collect())
    assert found == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}}
