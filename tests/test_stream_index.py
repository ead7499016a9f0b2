"""The ingest stream with all its rules, its key index, and totals over several checkpoints."""

import pytest
from pyspark.sql import functions as F

from postlens.operators.near_copies import drop_near_copies
from postlens.plans import catalogue, jobs
from postlens.sources import fixture
from postlens.sources.versions import BatchTable, publish, read_published
from postlens.streaming import ingest, totals
from tests.conftest import SF


def land(posts, path, cuts):
    """Posts by id as JSON files, one file for each range between ``cuts``."""
    for low, high in zip([0, *cuts], [*cuts, 10**9]):
        posts.where((F.col("post_id") >= low) & (F.col("post_id") < high)).coalesce(1).write.mode("append").json(path)


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("cuts", [[300, 310]])
def test_merged_ingest_equals_one_batch(spark, tmp_path, cuts):
    posts = catalogue.posts(spark, SF).where("post_id < 700")
    predictions = fixture.predictions_from_posts(posts)
    land(posts, str(tmp_path / "in"), cuts)
    out = str(tmp_path / "out")
    stream = ingest.read_posts(spark, str(tmp_path / "in"), files_per_batch=1)
    ingest.start_ingest(stream, out, str(tmp_path / "cp"), predictions=predictions, tasks=4, buckets=4).awaitTermination()
    assert ids(spark.read.parquet(out).select("id")) == ids(jobs.ingest(posts, predictions=predictions).select("id"))


@pytest.mark.parametrize("cuts", [[200, 210]])
def test_near_copies_across_batches(spark, tmp_path, cuts):
    posts = catalogue.posts(spark, SF).where("post_id < 500").withColumn("group_id", F.lit(1))
    out, kept = str(tmp_path / "out"), []
    near = ingest.NearCopies(spark, out, ["group_id"], buckets=4)
    for b, (low, high) in enumerate(zip([0, *cuts], [*cuts, 500])):
        part = posts.where((F.col("post_id") >= low) & (F.col("post_id") < high))
        if b == 1:  # a batch that runs again decides as before
            near.filter(part, "r", b)
        kept += ids(near.filter(part, "r", b).select("post_id"))
    expected = ids(drop_near_copies(posts, ["group_id"]).select("post_id"))
    assert sorted(kept) == expected and len(expected) < 450


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    index = ingest.key_index(spark, str(tmp_path / "t"), 64)
    keys = lambda low, n: spark.range(low, low + n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    few, files = keys(10**6, 3), []
    for batch in range(10):
        index.append(keys(batch * 500, 500), "r", batch)
        files.append(len(index.paths(index.touched(few), index.settled("r", 99))))
    # Three buckets at most, in fewer than FAN folders of each level, however many batches.
    assert max(files) <= 3 * (BatchTable.FAN + 2) and files[-1] < 3 * 10
    assert index.find(list(range(64)), "r", 99).count() == 10 * 500
    assert index.find(list(range(64)), "r", 9).count() == 9 * 500
    index.append(keys(9 * 500, 10), "r", 9)
    assert index.find(list(range(64)), "other", 0).count() == 9 * 500 + 10


def test_broken_rows_go_aside_and_the_rest_goes_on(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"post_id": 1, "group_id": 1, "text": "2bhk flat in Kondapur, rent 20000"}\n{"post_id": 2, "group_id": 1, "text": null}\n'
        '{"post_id": 3, "group_\n{"group_id": 2, "text": "no id"}\n')
    out, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    stream = ingest.read_posts(spark, str(tmp_path / "in"))
    ingest.start_ingest(stream, out, str(tmp_path / "cp"), quarantine=bad).awaitTermination()
    assert ids(spark.read.parquet(out).select("id")) == [1]
    found = {(r.group_id, r.reason): r.failed for r in ingest.quarantined(spark, bad).collect()}
    assert found == {(1, "no text"): 1, (None, "not a JSON object"): 1, (2, "no id"): 1}


def test_totals_of_two_checkpoints_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(BatchTable, "FAN", 2)
    posts, out = catalogue.posts(spark, SF), str(tmp_path / "out")
    for name, low, high in (("a", 0, 700), ("b", 700, 10**9)):
        part = posts.where((F.col("post_id") >= low) & (F.col("post_id") < high))
        land(part, str(tmp_path / name), [low + 100, low + 200, low + 300])
        stream = ingest.read_posts(spark, str(tmp_path / name), files_per_batch=1)
        totals.start_group_totals(stream, out, str(tmp_path / f"cp-{name}")).awaitTermination()
    got = {r.group_id: r.parsed for r in totals.group_totals(spark, out).collect()}
    assert got == {r.group_id: r["count"] for r in posts.groupBy("group_id").count().collect()}
    assert len(BatchTable(spark, out).read()[1]) < 8


def test_publish_all_or_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert publish(spark.range(3), path) and ids(read_published(spark, path)) == [0, 1, 2]
    assert not publish(spark.range(0), path)
    with pytest.raises(Exception, match="boom"):
        publish(spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("boom"))).cast("long").alias("id")), path)
    assert ids(read_published(spark, path)) == [0, 1, 2]
    # The new version may be made from the old one.
    assert publish(read_published(spark, path).where("id > 0"), path) and ids(read_published(spark, path)) == [1, 2]
