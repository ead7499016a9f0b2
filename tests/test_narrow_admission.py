"""Admission on keys alone: what a merged batch writes on the way, and rounds without crowded edges."""

import random

import pytest
from pyspark.sql import functions as F

from postlens.functions.predictions import decode_predictions
from postlens.operators import first_come as f
from postlens.plans import catalogue, jobs
from postlens.sources import fixture
from postlens.streaming import ingest
from tests.conftest import SF


@pytest.fixture
def written(monkeypatch):
    """(name, columns, rows) of the tables that a batch and its rounds write."""
    found = []
    for module in (ingest, f):
        def noted(df, name, cut=module.cut_lineage):
            done = cut(df, name)
            found.append((name, done.columns, done.count()))
            return done

        monkeypatch.setattr(module, "cut_lineage", noted)
    return found


def test_texts_are_written_once_before_they_enter(spark, tmp_path, written):
    posts = catalogue.posts(spark, SF).where("post_id < 600")
    predictions = fixture.predictions_from_posts(catalogue.posts(spark, SF))
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 300), (200, 600)):  # a hundred posts come twice
        posts.where(F.col("post_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(posts.schema).parquet(landed)
        ingest.start_ingest(stream, out, str(tmp_path / "cp"), predictions=predictions, buckets=4).awaitTermination()
    texts = [(name, rows) for name, columns, rows in written if "raw_text" in columns]
    assert texts == [("batch-listings", 300), ("batch-listings", 400)]
    expected = jobs.ingest(posts, predictions=predictions).select("id").collect()
    assert sorted(spark.read.parquet(out).select("id").collect()) == sorted(expected)
    assert not [c for c in spark.read.parquet(out).columns if c.startswith("_")]


def _sequential(incidence):
    kept, nodes = [], {}
    for edge, node, member in incidence:
        nodes.setdefault(node, set()).add((edge, member))
    for node in sorted(nodes):
        if not any(e == x and (m or n) for k in kept for e, m in nodes[k] for x, n in nodes[node]):
            kept.append(node)
    return kept


def test_rounds_give_the_same_with_and_without_crowded_edges(spark, written):
    rand = random.Random(3)
    rows = sorted({(rand.randrange(25), rand.randrange(60), rand.random() < 0.7) for _ in range(150)})
    rows = [r for r in rows if (r[0], r[1], not r[2]) not in rows or r[2]]
    incidence = spark.createDataFrame(rows, "edge long, node long, member boolean").withColumn("ord", F.col("node"))
    expected, tables = _sequential(rows), []
    for hot_rows in (2, 10**6):
        del written[:]
        assert sorted(r.node for r in f.first_come(incidence, hot_rows).collect()) == expected
        tables.append(sum(name == "met" for name, _, _ in written))
    rounds = sum(name == "conflicts" for name, _, _ in written) - 1
    assert rounds > f.PLAIN_ROUNDS and tables[1] == rounds - f.PLAIN_ROUNDS < tables[0]


def test_fields_of_answers_are_told_apart_as_before(spark):
    answers = ['{"bhk": null, "rent": 0, "floor": false}', '{"bhk": 3, "rent": "12000", "floor": 7}', "[]", "{}", None, '{"a.b": 1, "BHK": 2}']
    rows = spark.createDataFrame(list(enumerate(answers)), "post_id long, raw_output string")
    found = decode_predictions(rows).orderBy("post_id").select("model_bhk", "model_rent", "model_floor", "model_empty").collect()
    none = (None, None, None)
    assert [tuple(r) for r in found] == [
        (*none, False), ("3", 12000, "7", False), (*none, True), (*none, True), (*none, True), (*none, False)]
