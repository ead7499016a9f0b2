"""The first batch of a table has nothing to look up, later ones have."""

from postlens.plans import catalogue
from postlens.streaming import ingest
from tests.conftest import SF


def test_only_later_batches_look_for_stored_rows(spark, tmp_path, monkeypatch):
    asked = []
    touched = ingest.BucketIndex.touched
    monkeypatch.setattr(ingest.BucketIndex, "touched", lambda self, *a: asked.append(1) or touched(self, *a))
    posts = catalogue.posts(spark, SF).where("post_id < 300")
    table, landed = str(tmp_path / "table"), str(tmp_path / "in")
    counts = []
    for _ in range(2):
        posts.coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(posts.schema).parquet(landed)
        ingest.start_ingest(stream, table, str(tmp_path / "checkpoint"), buckets=2).awaitTermination()
        counts.append((len(asked), spark.read.parquet(table).count()))
    assert counts[0][0] == 0 and counts[1][0] == 2
    assert counts[0][1] == counts[1][1] > 0
