import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlens.llm import phrases
from tests.llm.plain import ASCII_LOWER


def plain_counts(rows, longest=3):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang or "und", tuple(words[i : i + k])] += 1
    return counts, totals


def plain(rows, longest=3, least=10, top=2000, share=50):
    counts, totals = plain_counts(rows, longest)
    chosen = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), f in chosen.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * f >= share * counts[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    out = []
    for lang in totals:
        scored = []
        for (la, w), a in chosen.items():
            if la == lang and (la, w) not in gone:
                cuts = [(1_000_000 * a * a // (counts[la, w[:k]] * counts[la, w[k:]]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(w).encode(), counts[la, w[:k]], counts[la, w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "dd", "x y", "the", "THE"]
    boiler = "all rights of this long notice are kept by its owner and by nobody else at all"
    rows = []
    for i in range(n):
        piece = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        text = " ".join(w + rng.choice(["", "", "", ".", ",", "\n", "\t", ";x", "\x0b"]) for w in piece)
        if i % 7 == 0:
            text += " " + boiler + rng.choice(["", ".", " " + rng.choice(words)])
        rows.append((text, rng.choice(["en", "fr", None, "und"])))
    return rows


@pytest.mark.parametrize("seed, options", [(2, {"top": 7}), (3, {"longest": 4, "least": 5}), (4, {"longest": 2})])
def test_equals_plain_version(spark, seed, options):
    rows = texts(seed)
    found = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), **options).collect()
    assert sorted(tuple(r) for r in found) == plain(rows, **options) != []


def test_odd_rows(spark):
    rows = [(None, "en"), ("", None), (" . \t,", "en"), ("one two " * 12, "en"), ("one two " * 12, "en"), ("na " * 40, "en"),
            ("single", "fr"), ("word " * 400_000, "de"), ("tick. " * 300_000, "de")]
    documents = spark.createDataFrame(rows, "text string, lang string")
    for name in ("gram", "n", "k", "at", "a.b"):
        documents = documents.withColumn(name, F.lit(1))
    assert sorted(tuple(r) for r in phrases.collocations(documents).collect()) == plain(rows)
    assert phrases.collocations(documents.limit(0)).count() == 0


@pytest.mark.parametrize("longest, least, hot_share", [(3, 1, 1), (3, 4, 1), (3, 4, 0), (4, 3, 0)])
def test_counts_come_from_flow(spark, monkeypatch, longest, least, hot_share):
    for name, value in (("HELD", 5), ("SAMPLE", 1), ("HOT_SHARE", hot_share), ("SLICES", 4)):
        monkeypatch.setattr(phrases, name, value)
    rows = texts(6, 120)
    documents = spark.createDataFrame(rows, "text string, lang string")
    hot = phrases._hot_nodes(documents.withColumn("text", F.coalesce("text", F.lit("")).cast("binary")).fillna("und"), longest)
    assert bool(hot) == (not hot_share)
    counts, totals = phrases.phrase_counts(phrases.flow(documents, longest, least), longest, least)
    expected, words = plain_counts(rows, longest)
    assert {(r.lang, tuple(r.gram.split(" "))): r.f for r in counts.collect()} == {p: f for p, f in expected.items() if f >= least}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in words.items() if v}


@pytest.mark.parametrize("rounds", [0, 2, 9])
def test_paths_hold_every_edge_once(spark, rounds):
    chain = [f"w{i}" for i in range(300)]
    ring = ["r", "s", "t", "u", "r", "s", "t"]
    edges = [("en", " ".join(chain[i : i + 3]), 10 + i) for i in range(298)]
    edges += [("fr", " ".join(ring[i : i + 3]), 1) for i in range(4)] + [("en", "o o o", 5), ("en", "w5 w6 z", 3)]
    paths = phrases.compact(spark.createDataFrame(edges, "lang string, gram string, f long"), cut=64, rounds=rounds).collect()
    found = [(p.lang, " ".join(p.words[i : i + 3]), w) for p in paths for i, w in enumerate(p.weights)]
    assert sorted(found) == sorted(edges)
    assert all(len(p.words) == len(p.weights) + 2 and len(p.weights) <= 2**rounds + 1 for p in paths)
    if rounds == 9:
        assert max(len(p.weights) for p in paths) > 20 and len(paths) < 40
