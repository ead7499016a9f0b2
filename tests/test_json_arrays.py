"""JSON arrays read in byte ranges against a whole reading."""

import json
import random

import pytest

from postlens.sources import json_arrays
from postlens.sources.json_arrays import read_json_arrays

SCHEMA = "id long, text string, tags array<string>, inner struct<a: string, more: struct<b: long>>"
NASTY = ["", "}", "{", "\"", "\\", "\\\"{", "}{\\\\", "]", "[{", "é𝒳", "a\nb", "x" * 300, "\\u007b", ", {\"id\": 9}", "{\"id\": 7}"]


def elements(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(NASTY, k=rng.randint(0, 4)))
    return [
        {"id": i, "text": word(), "tags": [word() for _ in range(rng.randint(0, 3))],
         "inner": {"a": word(), "more": {"b": rng.randint(0, 9)}} if rng.random() < 0.5 else None}
        for i in range(n)
    ]


def found(rows):
    return sorted((r.asDict(recursive=True) for r in rows.collect()), key=lambda r: r["id"])


@pytest.mark.parametrize("split", [64, 997, 10**7])
def test_any_split_gives_the_same_elements(spark, tmp_path, split):
    rows = elements(120, split)
    (tmp_path / "a.json").write_text(json.dumps(rows[:50], indent=2, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps(rows[50:110]))
    # Arrays one after the other, members that are no objects, an empty array and file.
    (tmp_path / "c.json").write_text(json.dumps([1, *rows[110:115], "}{", None]) + "\n" + json.dumps(rows[115:]))
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        if split < 1000:
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        got = found(read_json_arrays(spark, str(tmp_path), SCHEMA))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == rows


def test_only_empty_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text(" [ ] ")
    assert read_json_arrays(spark, str(tmp_path), SCHEMA).collect() == []


def test_elements_within_a_chunk_are_not_shuffled(spark, tmp_path):
    rows = [{"id": i, "text": "x" * 100, "tags": [], "inner": None} for i in range(4000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    ends, cut = [], json_arrays.cut_lineage

    def keep(df, name):
        ends.extend([found := cut(df, name)] if name == "json-ends" else [])
        return found if name == "json-ends" else cut(df, name)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(json_arrays, "cut_lineage", keep)
        got = json_arrays.read_json_arrays(spark, str(tmp_path), SCHEMA)
    assert got.count() == 4000
    size = sum(len(r.lead) + len(r.tail or b"") for r in ends[0].collect())
    assert 0 < size < len(json.dumps(rows)) / 20


@pytest.mark.parametrize("chunk", [1, 40, 500])
def test_any_chunk_gives_the_same_elements(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(json_arrays, "CHUNK", chunk)
    rows = elements(150, chunk)
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False))
    assert found(read_json_arrays(spark, str(tmp_path), SCHEMA)) == rows
