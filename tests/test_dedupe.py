"""Admission and near-copies against sequential loops; plans of hot keys."""

import random

import pytest

from postlens.operators import dedupe, first_come
from postlens.operators.near_copies import drop_near_copies
from postlens.plans import catalogue
from tests.conftest import SF

SCHEMA = "id long, raw_text string, contact string, bhk string, location string"


def sequential(rows, stored=()):
    """Insert one by one: known triple first, then known text."""
    texts, triples, kept = set(), set(), []

    def enter(r):
        texts.add(r[1])
        triples.add(r[2:])

    for r in stored:
        enter(r)
    for r in sorted(rows):
        complete = bool(r[2]) and bool(r[3]) and r[4] is not None
        if (complete and r[2:] in triples) or (r[1] is not None and r[1] in texts):
            continue
        enter(r)
        kept.append(r[0])
    return kept


def batch(rng, n, start=0, functional=False):
    rows = []
    for i in range(start, start + n):
        text = rng.choice(["t1", "t2", "t3", "t4", "t5", None])
        source = random.Random(str(text)) if functional else rng
        triple = tuple(source.choice(c) for c in ((None, "", "c1", "c2"), ("1", "2", None), ("A", "B", None)))
        rows.append((i, text, *triple))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_admission_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows, old = batch(rng, 25, 100, functional=True), batch(rng, 6, functional=True)
    old = [r for r in old if r[0] in sequential(old)]
    stored = spark.createDataFrame(old, SCHEMA)
    got = dedupe.admit_new(spark.createDataFrame(rows, SCHEMA), stored)
    assert sorted(r.id for r in got.collect()) == sequential(rows, old)


@pytest.mark.parametrize("seed", range(4))
def test_admission_against_stored_rows_of_other_triples(spark, seed):
    rng = random.Random(seed + 20)
    rows, old = batch(rng, 25, 2, functional=True), batch(rng, 4)
    old = [r for r in old if r[0] in sequential(old)]
    got = dedupe.admit_new(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(old, SCHEMA))
    assert sorted(r.id for r in got.collect()) == sequential(rows, old)


def test_stored_text_with_another_triple_keeps_the_text_out(spark):
    stored = spark.createDataFrame([(1, "same text", "c1", "3", "Kokapet")], SCHEMA)
    new = spark.createDataFrame([(5, "same text", "c1", "2", "Kondapur"), (6, "other", "c1", "2", "Kondapur")], SCHEMA)
    assert [r.id for r in dedupe.admit_new(new, stored).collect()] == [6]


@pytest.mark.parametrize("seed", range(3))
def test_admission_with_two_keys(spark, seed):
    rng = random.Random(seed + 50)
    rows, old = batch(rng, 30, 100), batch(rng, 3)
    old = [r for r in old if r[0] in sequential(old)]
    stored = spark.createDataFrame(old, SCHEMA)
    got = dedupe.admit_new_two_keys(spark.createDataFrame(rows, SCHEMA), stored)
    assert sorted(r.id for r in got.collect()) == sequential(rows, old)


def test_a_chain_of_conflicts_needs_few_rounds(spark, monkeypatch):
    # Texts and triples alternate, so every row is in conflict with the one before it.
    chain = [(i, f"t{(i + 1) // 2}", "c", f"{i // 2}", "A") for i in range(1000)]
    rounds = []
    for name in ("_round", "_chain_round"):
        plain = getattr(first_come, name)
        monkeypatch.setattr(first_come, name, lambda *a, plain=plain: rounds.append(1) or plain(*a))
    got = dedupe.admit_new_two_keys(spark.createDataFrame(chain, SCHEMA))
    assert sorted(r.id for r in got.collect()) == sequential(chain) == list(range(0, 1000, 2))
    assert len(rounds) <= 5


@pytest.mark.parametrize("seed", range(4))
def test_chains_with_branches_equal_one_by_one(spark, seed, monkeypatch):
    monkeypatch.setattr(first_come, "PLAIN_ROUNDS", 0)
    rng = random.Random(seed)
    rows = [(i, f"t{rng.randrange(40)}", "c", f"{rng.randrange(40)}", "A") for i in range(80)]
    got = dedupe.admit_new_two_keys(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r.id for r in got.collect()) == sequential(rows)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_with_rows_that_are_no_members(spark, seed, monkeypatch):
    monkeypatch.setattr(first_come, "PLAIN_ROUNDS", seed % 2)
    rng = random.Random(seed)
    rows = sorted({(rng.randrange(15), n, n, rng.random() < 0.5) for n in range(40) for _ in range(2)})
    rows = list({r[:2]: r for r in rows}.values())
    kept = []
    for node in range(40):
        mine = {e: m for e, n, _, m in rows if n == node}
        rivals = [(e, m) for e, n, _, m in rows if n in kept and e in mine]
        if mine and not any(m or mine[e] for e, m in rivals):
            kept.append(node)
    frame = spark.createDataFrame(rows, "edge long, node long, ord long, member boolean")
    assert sorted(r.node for r in first_come.first_come(frame).collect()) == kept


def test_null_texts_and_open_triples_never_conflict(spark):
    rows = spark.createDataFrame([(1, None, None, "2", "A"), (2, None, None, "2", "A"), (3, "x", "c", "2", None),
                                  (4, "y", "c", "2", None)], SCHEMA)
    assert dedupe.unique_texts(rows).count() == 4
    assert dedupe.unique_across_groups(rows).count() == 4


def test_hot_keys_are_cut_before_the_shuffle(spark):
    plan = dedupe.admit_new(spark.createDataFrame([(1, "x", "c", "2", "A")], SCHEMA))
    text = plan._jdf.queryExecution().executedPlan().toString()
    before_shuffle = text[text.index("Exchange"):]
    assert "WindowGroupLimit" in before_shuffle and "Partial" in before_shuffle


def test_choice_and_look_up_share_one_shuffle(spark):
    stored = spark.createDataFrame([(1, "x", "c", "2", "A")], SCHEMA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = dedupe.admit_new(stored, stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 4  # texts looked up, then one for either side of the keys


def greedy(posts):
    kept = {}
    for part, key, text in sorted(posts, key=lambda p: p[1]):
        text = text.strip()
        if len(text) < 50:
            continue
        mine = kept.setdefault(part, [])
        if any(text in s or s in text or text[:80] in s or s[:80] in text for _, s in mine):
            continue
        mine.append((key, text))
    return sorted(key for rows in kept.values() for key, _ in rows)


def make_posts(rng, n):
    """Short alphabets and copied pieces, so that heads occur inside other posts."""
    posts = []
    for key in range(n):
        text = "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(rng.choice([30, 50, 60, 79, 80, 81, 130])))
        if posts and rng.random() < 0.75:
            piece = rng.choice(posts)[2]
            cut = rng.choice([50, 60, 79, 80, 100, 500])
            before = "".join(rng.choice("xy") for _ in range(rng.choice([0, 0, 1, 40])))
            text = before + piece[:cut] + "".join(rng.choice("pq") for _ in range(rng.choice([0, 5, 60])))
        posts.append((rng.randrange(2), key, text))
    return posts


@pytest.mark.parametrize("seed", range(3))
def test_near_copies_equal_the_greedy_loop(spark, seed):
    rng = random.Random(seed)
    posts = [p for b in range(12) for p in
             [(f"{b}-{part}", b * 1000 + key, text) for part, key, text in make_posts(rng, 25)]]
    df = spark.createDataFrame(posts, "part string, post_id long, text string").repartition(3)
    got = drop_near_copies(df, ["part"], hot_rows=5)
    assert sorted(r.post_id for r in got.collect()) == greedy(posts)


def test_one_head_shared_by_a_third_of_all_posts(spark):
    head = "Spacious flat for rent, close to the lake and the metro station, call the owner now"
    posts = [("g", i, (head if i % 3 == 0 else f"post number {i} ") + f" with text {i} of its own, long enough to count")
             for i in range(300)]
    posts += [("g", 1000 + i, f"seen elsewhere {i}: {head}") for i in range(100)]
    df = spark.createDataFrame(posts, "part string, post_id long, text string")
    got = drop_near_copies(df, ["part"], hot_rows=20)
    assert sorted(r.post_id for r in got.collect()) == greedy(posts)


def test_merged_admission_equals_one_by_one(spark):
    from postlens.plans import jobs

    rows = jobs.to_listings(catalogue.posts(spark, SF), predictions=catalogue.predictions(spark, SF))
    rows = rows.select("id", "raw_text", "contact", "bhk", "location").cache()
    got = sorted(r.id for r in dedupe.admit_new_two_keys(rows).collect())
    assert got == sequential([tuple(r) for r in rows.collect()])


def test_incomplete_rows_are_not_known_by_their_id(spark):
    schema = "id long, raw_text string, contact string, bhk double, location string"
    stored = spark.createDataFrame([(1, None, None, None, None)], schema)
    new = spark.createDataFrame([(1, None, None, None, None), (2, "text", None, None, None)], schema)
    for rule in (dedupe.unique_texts, dedupe.unique_across_groups, dedupe.admit_new):
        assert sorted(r.id for r in rule(new, stored).collect()) == [1, 2]


def test_rows_without_a_shared_key_make_no_edges(spark, monkeypatch):
    rows = spark.range(500).selectExpr(
        "id", "concat('text ', id % 499) AS raw_text", "if(id % 2 = 0, concat('9', id), '') AS contact", "'2' AS bhk", "'kondapur' AS location"
    )
    written, cut = {}, dedupe.cut_lineage

    def count(df, name):
        written[name] = cut(df, name)
        return written[name]

    monkeypatch.setattr(dedupe, "cut_lineage", count)
    # The last text is that of the first row.
    assert sorted(r.id for r in dedupe.admit_new_two_keys(rows).collect()) == list(range(499))
    assert written["keys"].count() == 500 and written["shared-keys"].count() == 2
    assert max(len(r.edge) for r in written["shared-keys"].collect()) == 16
