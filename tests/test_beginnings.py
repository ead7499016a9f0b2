"""Grams that texts share, or that are only their own head's, make no rows on the way to near-copies."""

import itertools

from pyspark.sql import functions as F

from postlens.operators import near_copies as n

SIZES = ["1 BHK semi furnished flat in a quiet lane", "2 BHK fully furnished flat by the lake side", "Spacious flat with two halls and a terrace"]
PLACES = [" near Hi-Tech City and the old market", " at Gachibowli, five minutes from the bus", " in Madhapur on the second main road"]
TERMS = [". Deposit of two months is asked for", ". Available from the first of next month", ". Car parking, lift and water all day"]


def _posts(spark, rows):
    df = spark.createDataFrame(rows, "part string, node long, text string")
    return df.withColumn("head", F.substring("text", 1, 80))


def _from_fragments():
    texts = [f"{a}{b}{c} {k:04d}{d}" for k, (a, b, c, d) in enumerate(itertools.product(SIZES, PLACES, TERMS, SIZES))]
    return [("a", k, text) for k, text in enumerate(texts)]


def _contained(rows):
    """By comparing all texts with all heads of their part."""
    heads = {(part, text[:80]) for part, _, text in rows}
    return sorted((p, h, node) for part, node, text in rows for p, h in heads if p == part and h != text[:80] and h in text)


def test_shared_grams_make_no_rows(spark, monkeypatch):
    rows, counts = _from_fragments(), {}
    cut = n.cut_lineage

    def counted(df, name):
        done = cut(df, name)
        counts[name] = counts.get(name, 0) + done.count()
        return done

    monkeypatch.setattr(n, "cut_lineage", counted)
    found = n.contained_heads(_posts(spark, rows)).collect()
    assert sorted((r.part, r.head, r.node) for r in found) == _contained(rows) == []
    assert counts["head-grams"] == len(rows) and counts["grams"] + counts["candidates"] < len(rows) / 4


def test_heads_of_all_sizes_are_found_wherever_they_lie(spark):
    rows = _from_fragments()
    base = [text for _, _, text in rows]
    for k, text in enumerate(base[:9]):
        for size in (50, 51, 66, 79, 80, 81):
            rows.append(("b", len(rows), text[:size]))  # shorter heads begin longer texts
        rows.append(("b", len(rows), "x" * (k + 1) + text))
        rows.append(("b", len(rows), "Again and again, é " * 3 + text[:80] + " end"))
        rows.append(("c", len(rows), "Again and again, é " * 3 + text[:80] + " end"))
        rows.append(("b", len(rows), base[k + 9][:50] + text[:79]))
    expected = _contained(rows)
    found = n.contained_heads(_posts(spark, rows)).collect()
    assert sorted((r.part, r.head, r.node) for r in found) == expected and len(expected) > 100
