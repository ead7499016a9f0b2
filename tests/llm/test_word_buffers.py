"""The words of a learning task of op9: what they hold, and what is held besides them."""

import tracemalloc

import numpy as np

from postlens.llm import toxicity as t
from tests.llm.test_bags import _texts


def test_words_of_a_task_take_little_more_than_themselves():
    texts = _texts(300, 700)
    t._words_per_text(texts[:2], t.BUCKETS)
    tracemalloc.start()
    words = t._words_per_text(texts, t.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    count = sum(map(len, words))
    assert count == 300 * 700 and len(words) == 300
    tracemalloc.start()
    t._words_per_text(_texts(1, t.w.CHUNK // 10), t.BUCKETS)
    chunk = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * 2 * (1 + len(t.BEGINNINGS)) * count + 1.5 * chunk


def test_words_follow_their_texts():
    texts = ["", *_texts(3, 50), "", "one two two", "-"]
    words = t._words_per_text(texts, t.BUCKETS)
    assert [len(ids) for ids in words] == [0, 50, 50, 50, 0, 3, 0]
    for text, ids in zip(texts, words):
        (alone,) = t._words_per_text([text], t.BUCKETS)
        assert np.array_equal(ids, alone)
    assert t._words_per_text([], t.BUCKETS) == []
