"""Only grams that may be a head's become rows, and texts are not shuffled to look at heads."""

import pytest
from pyspark.sql import functions as F

from postlens.operators import near_copies as n

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty knoll ledge marsh notch ocean plume".split()


def _text(seed, words):
    out = []
    for k in range(words):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(WORDS[seed >> 60] + str(seed >> 40 & 0xFFFF))
    return " ".join(out)


@pytest.fixture
def posts(spark):
    rows = [("a", k, _text(k, 400)) for k in range(12)]
    rows.append(("a", 12, _text(99, 50) + " " + rows[3][2][:80] + " " + _text(98, 50)))
    rows.append(("b", 13, _text(97, 50) + " " + rows[3][2][:80]))
    df = spark.createDataFrame(rows, "part string, node long, text string")
    return df.withColumn("head", F.substring("text", 1, 80))


def test_few_grams_of_long_texts_become_rows(posts):
    heads = n.head_marks(posts)
    assert heads.count() == posts.count()
    found = n.hits(posts, n.gram_bits(heads))
    assert n.marks(posts).count() > 100 * 12
    assert found.count() < 2 * posts.count()


def test_head_grams_are_those_of_the_whole_text(posts):
    columns = ("node", "at", "gram", "size")
    whole = n.marks(posts).where("size > 0").select(*columns)
    assert sorted(n.head_marks(posts).select(*columns).collect()) == sorted(whole.collect())


def test_heads_are_found_in_their_part_only(posts):
    found = n.contained_heads(posts).select("part", "node").collect()
    assert [tuple(r) for r in found] == [("a", 12)]


def test_a_crowded_bitmap_only_lets_more_pass(spark, posts, monkeypatch):
    every = spark.sparkContext.broadcast(n.np.full(n.BLOCKS * n.BLOCK_BITS // 8, 255, n.np.uint8))
    monkeypatch.setattr(n, "gram_bits", lambda grams: every)
    found = n.contained_heads(posts).select("part", "node").collect()
    assert [tuple(r) for r in found] == [("a", 12)]
