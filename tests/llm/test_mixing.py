from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from postlens.llm import mixing


def water_level(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, full, target = 1.5 * sum(sizes.values()), {}, {}
    while True:
        rest = {s: w for s, w in weight.items() if s not in full}
        target = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s for s in target if target[s] >= 2 * sizes[s]}
        if not over:
            return {**target, **full}
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]
        if len(full) == len(weight):
            return full


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_nearness(spark, seed):
    names = ["a", "b", "B", "é", None, "tiny", "none", "hot"]
    rows = []
    for i in range(3000):
        s = "hot" if i % 3 == 0 else names[(i * 7 + seed) % 6]
        rows.append((i, s, " ".join(["w"] * ((i * i + seed) % 40))))
    rows += [(9000, "none", ""), (9001, "none", None)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("key", F.lit(0)).withColumn("copies", F.lit(7))
    found = mixing.mix(documents).join(documents.select("doc_id", "source"), "doc_id").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = water_level(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes)  # half of the longest document
    applied = mixing.apply_mix(documents).collect()
    assert set(applied[0].asDict()) == {*documents.columns, "copies_"}
    assert {r["doc_id"]: r["copies_"] * r["size"] for r in mixing.apply_mix(documents).join(mixing.mix(documents), "doc_id").collect() if r["size"]} == {
        r["doc_id"]: r["taken"] for r in found if r["taken"]}


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "a", "x y"), (1, "a", "x y"), (None, "a", "z"), (2, "b", "w " * 50_000)]
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = mixing.mix(documents).collect()
    assert len(found) == 5 and len({r["taken"] for r in found if r["doc_id"] == 1}) == 1
    assert mixing.mix(documents.limit(0)).count() == 0 and mixing.apply_mix(documents.limit(0)).count() == 0
    assert mixing.mix(documents.where("text is null")).first()["target"] == 0.0
