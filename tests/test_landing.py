"""Landing in parts: each part is one micro-batch, in as many files as its rows ask for."""

from postlens.plans import catalogue


def test_a_part_of_many_rows_is_many_files_and_one_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalogue, "LANDED_ROWS", 10)
    rows = spark.range(120).withColumnRenamed("id", "post_id")
    batches = []

    def start(stream):
        def run(batch, batch_id):
            batches.append((sorted(r[0] for r in batch.collect()), len(list((tmp_path / "landed").glob("*.parquet")))))

        query = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp"))
        return query.trigger(availableNow=True).start()

    catalogue._in_batches(spark, rows, "post_id", str(tmp_path), 3, start)
    assert [b[0] for b in batches] == [list(range(k, k + 40)) for k in (0, 40, 80)]
    files = [0, *(b[1] for b in batches)]
    assert all(after - before > 1 for before, after in zip(files, files[1:]))
