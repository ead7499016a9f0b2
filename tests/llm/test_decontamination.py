from pyspark.sql import functions as F

from postlens.llm import decontamination as dc
from tests.conftest import SF

ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."),
         (None, "nameless words"), (5, "Short-ITEM"), (6, "single")]
TEXTS = [None, "", "zero one TWO three, four five six seven eight nine ten! end", "a short item and a short item",
         "one two three four five six seven eight nine x", "nameless words here", "single", "ten " * 50000 + "short item",
         "one two three four five six seven eight nine ten eleven twelve", "Élan single"]


def plain(items, texts):
    windows = {}
    for name, text in items:
        words = dc.split_words(text or "")
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(name)
    out = []
    for text in texts:
        words, hit, names = dc.split_words(text or ""), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(words[i : i + n])]
        out.append((len(words), len(hit), sorted(str(x) for x in names if x is not None)))
    return out


def test_equals_plain_search_in_one_and_many_blocks(spark):
    documents = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("found", F.lit(0))
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1)
    want = plain(ITEMS, TEXTS)
    for words in (1_000, 3):
        rows = dc.with_hits(documents, benchmark, "hits", block_words=words).orderBy("doc_id").collect()
        assert [(r["hits"]["n_words"], r["hits"]["n_hit"], r["hits"]["items"]) for r in rows] == want
    clean = dc.drop_contaminated(documents, benchmark)
    assert clean.columns == documents.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == [i for i, x in enumerate(want) if not x[1]]


def test_empty_tables(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert dc.contamination(documents.limit(0), benchmark).count() == 0
    assert dc.contamination(documents, benchmark.limit(0)).where("contaminated or n_items > 0").count() == 0
