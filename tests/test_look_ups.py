"""Word look-ups and numbers out of text: the results, and what a row costs."""

import itertools

from pyspark.sql import functions as F

from postlens.functions import fixed_values as fv
from postlens.functions.text import contains_any, whole_number


def test_grouped_words_find_what_each_word_finds(spark):
    for needles in (fv.FEMALE_SIGNALS, fv.VEG_SIGNALS, fv.NO_BROKERAGE_SIGNALS, fv.AREAS, ("a", "ab"), ("x",)):
        texts = [*needles, *(n[1:] for n in needles), *(n[:-1] for n in needles), "", None]
        texts += [a[:4] + b for a, b in itertools.pairwise(needles)]
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        for t, found in rows.select("t", F.expr(contains_any("t", needles))).collect():
            assert found == (None if t is None else any(n in t for n in needles))


def test_a_text_without_any_word_costs_few_look_ups():
    # Look-ups that are always made: those outside of an inner group.
    for needles in (fv.FEMALE_SIGNALS, fv.VEG_SIGNALS, fv.NO_BROKERAGE_SIGNALS):
        sql = contains_any("t", needles)
        inner = sum(part.split("))")[0].count("contains") for part in sql.split(" AND (")[1:])
        assert sql.count("contains") - inner <= len(needles) // 2


def test_texts_without_digits_never_reach_the_cast(spark):
    values = {"": None, None: None, ",": None, "1,200": 1200, "007": 7, "9" * 25: None}
    rows = spark.createDataFrame([(v,) for v in values], "c string")
    assert dict(rows.select("c", F.expr(whole_number("c"))).collect()) == values
    assert "!= '' THEN try_cast" in whole_number("c")
