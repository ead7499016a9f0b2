"""Streams give what the batch jobs give, also over several batches and with broken input."""

import json

from pyspark.sql import functions as F

from postlens.operators import dedupe
from postlens.plans import catalogue, jobs
from postlens.streaming import ingest, totals
from tests.conftest import SF


def land(posts, path, parts=3):
    """Posts as JSON files in arrival order, one file per micro-batch."""
    for i in range(parts):
        posts.where(F.col("post_id") % 1500 >= i * 500).where(F.col("post_id") < (i + 1) * 500).coalesce(
            1).write.mode("append").json(path)


def test_ingest_in_batches_equals_one_batch(spark, tmp_path):
    posts = catalogue.posts(spark, SF)
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(posts, landed)
    (tmp_path / "in" / "zz-broken.json").write_text('{"post_id": 99, "text": \n' + json.dumps(
        {"post_id": 5000, "group_id": 1, "scraped_at": "2024-01-01T00:00:00.000Z", "text": "one more"}) + "\n")
    batches = []
    query = ingest.start_ingest(
        ingest.read_posts(spark, landed, files_per_batch=1), out, str(tmp_path / "cp"),
        quarantine=str(tmp_path / "bad"), after_batch=lambda df, i: batches.append(df.count()))
    query.awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(out).select("id").collect())
    expected = sorted(r.id for r in dedupe.admit_new(jobs.to_listings(posts)).select("id").collect())
    assert len(batches) == 4 and sum(batches) == len(got)
    assert got == sorted([*expected, 5000])
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    # Nothing new: a second run over the same folder adds nothing.
    ingest.start_ingest(ingest.read_posts(spark, landed), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == len(got)


def test_totals_over_batches(spark, tmp_path):
    posts = catalogue.posts(spark, SF)
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(posts, landed)
    stream = ingest.read_posts(spark, landed, files_per_batch=1)
    totals.start_group_totals(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = {r.group_id: r.parsed for r in totals.group_totals(spark, out).collect()}
    assert got == {r.group_id: r["count"] for r in posts.groupBy("group_id").count().collect()}


def test_toggles_over_batches(spark, tmp_path):
    log = catalogue.saved_log(spark, SF)
    landed, out = str(tmp_path / "in"), str(tmp_path / "out")
    log.repartition(3).write.parquet(landed)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    totals.start_toggles(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted(totals.saved_after_toggles(spark, out).collect())
    assert got == sorted(catalogue.saved_list(spark, SF).collect())


def test_bounded_uniqueness(spark, tmp_path):
    landed = str(tmp_path / "in")
    spark.sql("select 1L post_id, timestamp'2024-01-01' scraped_at, 'same' text union all "
              "select 2L, timestamp'2024-01-02', 'same' union all select 3L, timestamp'2024-01-02', 'other'"
              ).write.parquet(landed)
    stream = spark.readStream.schema("post_id long, scraped_at timestamp, text string").parquet(landed)
    out = str(tmp_path / "out")
    ingest.unique_within(stream, "30 days").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == ["other", "same"]


def test_second_checkpoint_keeps_the_first_data(spark, tmp_path):
    posts = catalogue.posts(spark, SF)
    out = str(tmp_path / "out")
    for part, ids in (("a", F.col("post_id") < 400), ("b", F.col("post_id") < 800)):
        posts.where(ids).coalesce(1).write.json(str(tmp_path / part))
        ingest.start_ingest(
            ingest.read_posts(spark, str(tmp_path / part)), out, str(tmp_path / f"cp-{part}")).awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(out).select("id").collect())
    whole = jobs.to_listings(posts.where("post_id < 800"))
    assert got == sorted(r.id for r in dedupe.admit_new(whole).select("id").collect())
