"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words and of the character n-grams
of its words, all hashed into one table; a softmax over two classes follows.  Training
is plain stochastic gradient descent over all labelled rows: tasks go over their own
rows, and after every pass the moves of their weights are averaged (where one task holds
all rows it makes all passes at once).

A repeated word adds one more token, the same for every word, because a bag of words
does not see repetition.

Inputs of a score are the characters of the text and nothing else.  NULL and empty
texts have no tokens and score like a zero vector, 0.5.  Without labelled rows every
text scores 0.5.  Texts are read whole.  Equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import TASK_ROWS, fold, labelled, per_batch, texts_of, train_in_rounds

BUCKETS = 1 << 17
DIM = 12
RATE = 0.5
#: Passes over the labelled rows, and updates at least, however few those are.
EPOCHS, STEPS = 4, 6000
#: Characters of the n-grams.
SHORTEST, LONGEST = 2, 4
THRESHOLD = 0.3
FOLDS, HELD = 5, 0


def _features(chunk: w.Chunk, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features of one kind, and the place in the chunk that each is at.

    Kinds: words, repeated words, and n-grams of each length."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    found = w.words(chunk.points, chunk.blank, chunk.starts)
    hashes = found.hashes()
    yield (hashes >> bits).astype(np.int64), found.start
    again = np.nonzero((hashes[1:] == hashes[:-1]) & (found.piece[1:] == found.piece[:-1]))[0] + 1
    yield np.zeros(len(again), np.int64), found.start[again]
    for n, grams, good in w.char_grams(chunk.points, chunk.blank, LONGEST):
        if n >= SHORTEST:
            place = np.nonzero(good)[0]
            yield (grams[place] >> bits).astype(np.int64), place


class _Bags(Sequence):
    """Per text its distinct buckets and their shares.

    A bucket of a text takes one number: which it is, and how often below; higher counts
    take several.  All numbers lie in one long buffer: many small arrays would stay with
    the worker after the task."""

    def __init__(self, buckets: int):
        self.kind = np.uint32 if buckets <= 1 << 24 else np.uint64
        self.bits = 8 * np.dtype(self.kind).itemsize - (buckets - 1).bit_length()
        self.held, self.ends = bytearray(), [0]

    def put(self, ids: np.ndarray, n: np.ndarray) -> None:
        most = (1 << self.bits) - 1
        parts = np.maximum(1, -(-n // most))
        counts = np.full(parts.sum(), most)
        counts[np.cumsum(parts) - 1] = n - most * (parts - 1)
        numbers = (np.repeat(ids, parts).astype(self.kind) << self.kind(self.bits)) | counts.astype(self.kind)
        self.held.extend(numbers.data)
        self.ends.append(self.ends[-1] + len(numbers))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= k < len(self):
            raise IndexError(k)
        numbers = np.frombuffer(self.held, self.kind)[self.ends[k] : self.ends[k + 1]]
        ids = (numbers >> self.kind(self.bits)).astype(np.int32)
        n = (numbers & self.kind((1 << self.bits) - 1)).astype(np.float64)
        if (ids[1:] == ids[:-1]).any():
            ids, where = np.unique(ids, return_inverse=True)
            n = np.bincount(where, n)
        return ids, (n / max(1, n.sum())).astype(np.float32)


def _bags(texts: Iterable[str], buckets: int) -> Sequence[tuple[np.ndarray, np.ndarray]]:
    """The bags of all texts.  A text is put together as soon as its last piece is counted,
    so that the counts of one chunk and of one text are held besides the bags."""
    bags = _Bags(buckets)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    last = -1
    for chunk in w.chunks(texts):
        features = list(_features(chunk, buckets))
        ids, place = (np.concatenate(x) for x in zip(*features))
        piece = np.searchsorted(chunk.starts, place, "right") - 1
        keys, n = np.unique(piece * buckets + ids, return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(chunk.starts) + 1) * buckets)
        for p, k in enumerate(chunk.owner):
            if k != last and parts:
                bags.put(*_sums(parts))
                parts.clear()
            at, last = slice(cuts[p], cuts[p + 1]), k
            parts.append((keys[at] - p * buckets, n[at]))
    if parts:
        bags.put(*_sums(parts))
    return bags if len(bags) else []


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts, from the counts of its pieces."""
    ids, n = (np.concatenate(x) for x in zip(*parts))
    ids, where = np.unique(ids, return_inverse=True)
    return ids, np.bincount(where, weights=n, minlength=len(ids)).astype(np.int64)


def _learn(bags: Sequence[tuple[np.ndarray, np.ndarray]], docs: list[tuple[int, int]], vectors: np.ndarray,
           out: np.ndarray, passes: range, of: int, rate: float, rng: np.random.Generator) -> None:
    """These passes over ``docs``, of so many, each a place in ``bags`` and a label; vectors and
    output weights change in place."""
    done, steps = passes.start * len(docs), max(1, of * len(docs))
    for _ in passes:
        for k in rng.permutation(len(docs)):
            place, y = docs[k]
            ids, weight = bags[place]
            step = rate * (1 - done / steps)
            done += 1
            hidden = weight @ vectors[ids]
            logits = hidden @ out
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            # An average over many features has small shares; the rate makes up for it.
            vectors[ids] -= (step * min(len(ids), 50)) * np.outer(weight, back)


def train(documents: DataFrame, labels: DataFrame, learn: Column, task_rows: int = TASK_ROWS,
          buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> bytes:
    """The model as bytes, ``4 * buckets`` of them: per bucket the difference of the two
    class logits that its vector adds.  ``learn`` says which labels may be used."""
    rows, tasks = labelled(documents, labels, "quality", learn, task_rows)
    rows.persist(StorageLevel.DISK_ONLY)
    alone = tasks == 1

    def start(rng: np.random.Generator) -> np.ndarray:
        return rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)

    def run(own: pa.Table, flat: np.ndarray, number: int) -> np.ndarray | None:
        bags = _bags(texts_of(own), buckets)
        docs = [(k, y) for k, (bag, y) in enumerate(zip(bags, own.column("y").to_pylist())) if len(bag[0])]
        if not docs:
            return None
        rng = np.random.default_rng(7 + number)
        start(rng)  # the first permutation comes after what was drawn for the start
        vectors, out = flat[: buckets * dim].reshape(buckets, dim), flat[buckets * dim :].reshape(dim, 2)
        least = -(-STEPS // len(docs))
        each = max(epochs, least) if alone else -(-least // epochs)
        _learn(bags, docs, vectors, out, range(number * each, (number + 1) * each), each if alone else epochs * each, rate, rng)
        return flat

    first = np.concatenate([start(np.random.default_rng(7)).ravel(), np.zeros(2 * dim, np.float32)])
    trained = train_in_rounds(rows, first, 1 if alone else epochs, run)
    rows.unpersist()
    flat = first if trained is None else trained
    out = flat[buckets * dim :].reshape(dim, 2)
    return (flat[: buckets * dim].reshape(buckets, dim) @ (out[:, 1] - out[:, 0])).astype(np.float32).tobytes()


def _scorer(weights: np.ndarray) -> Callable[[list[str]], np.ndarray]:
    def scores(texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for chunk in w.chunks(texts):
            sums, counts = np.zeros(len(chunk.points)), np.zeros(len(chunk.points), np.int32)
            for ids, place in _features(chunk, len(weights)):
                sums[place] += weights[ids]  # a kind has one feature at a place
                counts[place] += 1
            total += w.per_owner(np.add.reduceat(sums, chunk.starts), chunk.owner, len(texts))
            count += w.per_owner(np.add.reduceat(counts, chunk.starts), chunk.owner, len(texts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1), -30, 30)))

    return scores


def score_column(spark, model: bytes) -> Callable[[Column], Column]:
    """``text -> score`` for a model of ``train``."""
    shared = spark.sparkContext.broadcast(model)  # of a size set by parameters
    return per_batch(lambda: _scorer(np.frombuffer(shared.value, np.float32)), pa.float64(), "double")


def score_documents(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    A NULL doc_id is never learned from; its ``held_out`` is false.  Repeated rows are
    scored one by one.  Other columns are ignored.
    """
    learn = fold(F.col("doc_id"), FOLDS) != HELD
    model = train(documents, labels, learn, **parameters)
    score = score_column(documents.sparkSession, model)
    scored = documents.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
