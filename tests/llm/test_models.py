import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from postlens.llm import language, quality, toxicity
from postlens.llm.common import fold, train_in_rounds
from tests.conftest import SF

BIG = SF.replace("sf0.001", "sf0.01")


def accuracy(result, labels, label):
    held = result.where("held_out").join(labels, "doc_id")
    return held.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    result = quality.score_documents(documents, labels)
    assert accuracy(result, labels, "quality") >= 0.95
    row = result.agg(F.count("*"), F.min("score"), F.max("score")).first()
    assert row[0] == documents.count() and 0 <= row[1] <= row[2] <= 1


def test_toxicity_finds_words_with_known_beginnings(spark):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{rng.integers(300)}" for _ in range(n))
    rows = [(i, say(30) + (f" vileness{rng.integers(50)} " if i % 3 == 0 else " ") + say(20), "en" if i % 2 else None)
            for i in range(900)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = documents.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    assert accuracy(toxicity.score_documents(documents, labels), labels, "toxic") >= 0.97


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_every_labelled_row_is_learned(spark, module, label):
    """A mark that only rows late in the order of their hash have is learned too."""
    plain = spark.range(12000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias(label))
    late = F.row_number().over(Window.partitionBy(label).orderBy(F.xxhash64("doc_id"))) > 5400
    word = F.when(late, F.when(F.col(label) == 0, "mild").otherwise("vile")).when(F.col(label) == 0, "calm").otherwise("grim")
    filler = [F.concat(F.lit("w"), (F.xxhash64("doc_id", F.lit(k)) % 40).cast("string")) for k in range(12)]
    marked = plain.withColumn("text", F.concat_ws(" ", *filler[:6], word, *filler[6:])).withColumn("lang", F.lit("en"))
    rows = marked.cache()
    scored = module.score_documents(rows.select("doc_id", "text", "lang"), rows.select("doc_id", label), task_rows=3000).join(rows, "doc_id")
    late = scored.where(F.col("text").contains("vile") | F.col("text").contains("mild"))
    assert late.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= 0.95
    assert scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= 0.97


def test_moves_are_averaged_over_the_tasks_that_moved(spark):
    rows = spark.createDataFrame([(k % 3, k, "x", "en", 1) for k in range(9)], "task long, order long, text string, lang string, y int")
    moves = [np.float32([1, 0, 0]), np.float32([3, 5, 0]), None]

    def learn(own, state, number):
        assert own.column("order").to_pylist() == sorted(own.column("order").to_pylist()) and len(own) == 3
        move = moves[own.column("task")[0].as_py()]
        return None if move is None else state + move

    assert train_in_rounds(rows, np.zeros(3, np.float32), 2, learn).tolist() == [4, 10, 0]
    assert train_in_rounds(rows.where("task = 2"), np.zeros(3, np.float32), 2, learn) is None


def test_language_on_held_out_rows(spark):
    documents = spark.read.parquet(f"{BIG}/documents.parquet")
    held = language.predict_documents(documents).where("held_out").join(documents, "doc_id")
    assert held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] >= 0.97


ODD = [(None, None, None), (1, "", "en"), (2, "12 34 !?", "en"), (3, "word", "en"), (3, "word", "en"), (4, "mot " * 60000, "fr"),
       (5, "same words in it", "en"), (6, "un mot de plus", "fr"), (7, "日本語", None)]


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(spark, module, label):
    documents = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, None), (6, 0), (None, 1), (7, 5)], f"doc_id long, {label} int")
    rows = module.score_documents(documents, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 3}) == 1
    if label == "toxic":
        assert all(r["predicted"] == 0 for r in rows if r["doc_id"] in (None, 1))
    unlearned = module.score_documents(documents, labels.limit(0)).collect()
    assert {r["score"] for r in unlearned} <= {0.5, 0.5 - 1e-6}
    assert module.score_documents(documents.limit(0), labels).count() == 0


def test_language_on_odd_rows(spark):
    documents = spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumn("found", F.lit(1))
    rows = {r["doc_id"]: r for r in language.predict_documents(documents).collect()}
    assert rows[None]["lang_pred"] == rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und"
    assert rows[4]["lang_pred"] == "fr" and 0 <= rows[4]["score"] <= 1
    assert rows[7]["lang_pred"] in ("en", "fr")
    assert language.predict_documents(documents.limit(0)).count() == 0


def test_scores_do_not_depend_on_neighbours():
    weights = np.random.default_rng(0).normal(size=1 << 10).astype(np.float32)
    texts = ["a b c", "", "Größe ist alles", "x" * 3000, "a b c"]
    together = quality._scorer(weights)(texts)
    assert np.allclose(together, [quality._scorer(weights)([t])[0] for t in texts]) and together[0] == together[4]


def test_fold_of_null_is_null(spark):
    assert spark.range(1).select(fold(F.lit(None).cast("long"), 5).alias("f")).first()["f"] is None


def test_language_needs_a_letter_and_learns_known_rows_only(spark):
    rows = [(i % 3, f"the words of text {i} are read here", None if i % 2 else "en") for i in range(12)]
    rows += [(50, "½ ² ①", "en"), (51, "12 :-)", "en"), (52, "x", "en"), (53, None, "en")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.predict_documents(documents).collect()}
    assert [found[i] for i in (50, 51, 52, 53, 0)] == ["und", "und", "en", "und", "en"]
