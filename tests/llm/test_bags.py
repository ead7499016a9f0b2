"""The bags of a learning task: what they hold, and what is held besides them."""

import tracemalloc

import numpy as np

from postlens.llm import quality as q


def _texts(count, words):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    return [" ".join("".join(letters[rng.integers(0, 26, 9)]) for _ in range(words)) for _ in range(count)]


def test_bags_take_little_more_than_themselves():
    texts = _texts(600, 700)
    q._bags(texts[:2], q.BUCKETS)
    tracemalloc.start()
    bags = q._bags(texts, q.BUCKETS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    own = sum(ids.nbytes + share.nbytes for ids, share in bags)
    one = _texts(1, q.w.CHUNK // 10)
    tracemalloc.start()
    q._bags(one, q.BUCKETS)
    chunk = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * own + 1.5 * chunk


def test_bags_follow_their_texts():
    texts = ["", *_texts(3, 50), "", "one two two"]
    bags = q._bags(texts, 1 << 10)
    assert len(bags) == len(texts) and [len(bags[k][0]) for k in (0, 4)] == [0, 0]
    for text, (ids, share) in zip(texts, bags):
        (alone, other), = q._bags([text], 1 << 10)
        assert np.array_equal(ids, alone) and np.array_equal(share, other)
        assert ids.dtype == np.int32 and share.dtype == np.float32
    assert q._bags([], 1 << 10) == []


def test_a_cut_text_is_one_bag(monkeypatch):
    text = _texts(1, 300)[0]
    (whole, share), = q._bags([text], 1 << 20)
    cut = q.w.chunks
    monkeypatch.setattr(q.w, "chunks", lambda texts: cut(texts, size=500))
    _, (ids, other) = q._bags(["x", text], 1 << 20)
    assert set(ids) <= set(whole) and np.isclose(other.sum(), 1) and abs(len(ids) - len(whole)) < 100


def test_a_bag_takes_a_number_for_each_bucket():
    texts = _texts(600, 700)
    tracemalloc.start()
    bags = q._bags(iter(texts), q.BUCKETS)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 0.6 * sum(ids.nbytes + share.nbytes for ids, share in bags)


def test_counts_beyond_a_number_are_whole():
    (ids, share), (_, short) = q._bags(["ab " * 9000 + "cd", "ab ab cd"], 1 << 20)
    assert len(set(ids)) == len(ids) and np.isclose(share.sum(), 1)
    # A repeated word adds nearly as much as each feature of the word.
    assert np.isclose(share.max(), 1 / 8, rtol=0.01) and np.count_nonzero(share > 0.1) == 8
