import duckdb
import pytest

import corpus_pipeline
from postlens.llm import decontamination, quality, secret_scan
from postlens.llm import queries as registered
from tests.conftest import SF
from tests.llm import plain


def rows(table):
    return sorted(zip(*(table.column(n).to_pylist() for n in sorted(table.column_names))), key=repr)


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = registered.queries()[name](spark, SF).toArrow()
    theirs = duck.sql(registered.oracle_sql()[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names) and rows(mine) == rows(theirs)


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.queries()) == list(range(1, 14))


def test_pipeline_equals_plain_steps(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    found = corpus_pipeline.run(spark, SF).collect()
    scored = {r["doc_id"]: r["predicted"] for r in quality.score_documents(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    left = [(r["doc_id"], r["text"]) for r in documents.collect() if scored[r["doc_id"]]]
    kept = {d for d, _, _, keep in plain.near_duplicates(left) if keep}
    left = [(d, t) for d, t in left if d in kept]
    items = [(r["item_id"], dc_words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(x[i : i + 10]) for _, x in items for i in range(max(1, len(x) - 9)) if x}
    left = [(d, t) for d, t in left if not any(tuple(x) in windows for x in slices(dc_words(t)))]
    assert {r["doc_id"] for r in found} <= {d for d, _ in left}
    texts = dict(left)
    for r in found:
        clean = texts[r["doc_id"]]
        for start, end in sorted(((s, e) for s, _, e in plain.secrets(clean)), reverse=True):
            assert clean[start:end] not in r["text"]
        assert r["copies"] in (1, 2)
    # Targets: half as many words again as are left, none more than twice.
    assert sum(r["copies"] * len(r["text"].split()) for r in found) == pytest.approx(
        1.5 * sum(len(t.split()) for _, t in left), rel=0.15)


def dc_words(text):
    return decontamination.split_words(text or "")


def slices(x):
    return [x[i : i + n] for n in range(1, 11) for i in range(len(x) - n + 1)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    text = "some words that come again and again in here"
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, text, None, None, None), (2, text, None, None, None),
           (3, "long " * 30000, "en", "s", 150000), (4, "token=abcdefghijklmnop", "en", "s", 22)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("key", "node", "found", "score", "copies", "a.b"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(extra, F.lit(1))
    out = stage(spark, docs, SF)
    assert out.columns[: len(docs.columns)] == docs.columns
    if name != "mixing":
        assert out.columns == docs.columns
        assert {r["doc_id"] for r in out.collect()} >= {None, 1, 2, 4} - ({2} if name == "quality" else set())
    assert stage(spark, docs.limit(0), SF).count() == 0
    assert secret_scan.MASK not in text
