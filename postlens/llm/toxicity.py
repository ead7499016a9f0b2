"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the mean of hashed vectors of the word and of its beginnings.
Filters of several widths slide over the words, each keeps its largest response
(max pooling), and a logistic unit reads those.  Training is stochastic gradient
descent with per-weight rates over all labelled rows: tasks go over their own rows, and
after every pass the moves of their weights are averaged (where one task holds all rows
it makes all passes at once).

Thresholds are calibrated by language: every fourth labelled row of a task is kept back,
and for each language the cut that separates those best is moved to the common threshold
by a shift of the logit.  The language is guessed from the text by word frequencies that
are counted in all labelled rows, never read from a column.

NULL and empty texts and texts without a letter or digit score below the threshold.  Without labelled rows every text scores 0.5.  Texts are read whole.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut_lineage
from . import words as w
from .common import TASK_ROWS, fold, in_order, labelled, per_batch, texts_of, train_in_rounds

BUCKETS = 1 << 15
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
RATE = 0.05
#: Passes over the labelled rows, and updates at least, however few those are.
EPOCHS, STEPS = 5, 6000
#: A word is looked up whole and by so many of its first characters.
BEGINNINGS = (3, 4, 5, 6)
#: Words that stand for a language, and the languages that are told apart.
LANGUAGE_WORDS, LANGUAGES = 300, 64
#: Logits are told apart in steps of this part of one when thresholds are chosen.
LOGIT_BINS = 256
THRESHOLD = 0.7
FOLDS, HELD = 3, 1


def _words(chunk: w.Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per word of the chunk: its buckets (a row), its hash and its piece.

    ASCII letters count in lower case; ASCII characters other than letters and digits
    separate words."""
    points = w.lower_ascii(chunk.points)
    letter = (points >= 128) | ((points >= 97) & (points <= 122)) | ((points >= 48) & (points <= 57))
    found = w.words(points, ~letter, chunk.starts)
    whole = found.hashes()
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    kinds = [whole] + [w.mix(found.hashes(n) + np.uint64(n)) for n in BEGINNINGS]
    return np.stack([(x >> bits).astype(np.int32) for x in kinds], 1), whole, found.piece


def _words_per_text(texts: Iterable[str], buckets: int) -> list[np.ndarray]:
    """Per text the buckets of its words, a row each.

    They lie in one long buffer and take no more bytes than a bucket needs: many small
    arrays would stay with the worker after the task."""
    kind = np.min_scalar_type(buckets - 1)
    held, sizes = bytearray(), []
    for chunk in w.chunks(texts):
        ids, _, piece = _words(chunk, buckets)
        held.extend(ids.astype(kind).data)
        sizes.extend([0] * (chunk.owner[-1] + 1 - len(sizes)))
        for k, n in zip(chunk.owner, np.bincount(piece, minlength=len(chunk.starts))):
            sizes[k] += int(n)
    rows = np.frombuffer(held, kind).reshape(-1, 1 + len(BEGINNINGS))
    return np.split(rows, np.cumsum(sizes)[:-1]) if sizes else []


def _start(rng: np.random.Generator, buckets: int, dim: int, filters: int) -> list[np.ndarray]:
    """Vectors, kernels, offsets, output weights and bias before training."""
    vectors = rng.normal(0, 0.3, (buckets, dim)).astype(np.float32)
    kernels = [rng.normal(0, 0.3, (n * dim, filters)).astype(np.float32) for n in WIDTHS]
    offsets = [np.zeros(filters, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32)
    return [vectors, *kernels, *offsets, out, np.zeros(1, np.float32)]


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in arrays])


def _shaped(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    """Views of ``flat`` in the shapes of ``like``."""
    cuts = np.cumsum([x.size for x in like])
    return [part.reshape(x.shape) for part, x in zip(np.split(flat[: cuts[-1]], cuts[:-1]), like)]


def _learn(docs: list[tuple[np.ndarray, int]], params: list[np.ndarray], state: list[np.ndarray],
           passes: int, rate: float, rng: np.random.Generator) -> None:
    """Go over ``docs`` so often; parameters and their sums of squares change in place."""
    vectors, kernels, offsets = params[0], params[1 : 1 + len(WIDTHS)], params[1 + len(WIDTHS) : -2]
    out, bias = params[-2:]
    dim, filters = vectors.shape[1], kernels[0].shape[1]

    def step(param: np.ndarray, square: np.ndarray, at, gradient: np.ndarray) -> None:
        square[at] += gradient * gradient
        param[at] -= rate * gradient / np.sqrt(square[at])

    def forward(ids: np.ndarray):
        rows = vectors[ids].mean(1) if len(ids) else np.zeros((0, dim), np.float32)
        pooled, where = [], []
        for n, kernel, offset in zip(WIDTHS, kernels, offsets):
            padded = np.vstack([rows, np.zeros((n, dim), np.float32)])
            windows = np.hstack([padded[j : len(rows) + 1 + j] for j in range(n)])
            response = windows @ kernel
            best = response.argmax(0)
            pooled.append(response[best, np.arange(filters)] + offset)
            where.append((best, windows[best]))
        h = np.concatenate(pooled)
        return h, where, float(np.maximum(h, 0) @ out + bias[0])

    for _ in range(passes):
        for k in rng.permutation(np.arange(len(docs))):
            ids, y = docs[k]
            h, where, z = forward(ids)
            error = np.float32(1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            if abs(error) < 0.01:
                continue
            down = np.where(h > 0, error * out, 0).astype(np.float32)
            step(out, state[-2], slice(None), error * np.maximum(h, 0))
            step(bias, state[-1], slice(None), np.array([error], np.float32))
            at, gradients = [], []
            for i, n in enumerate(WIDTHS):
                best, windows = where[i]
                d = down[i * filters : (i + 1) * filters]
                back = (kernels[i] * d).T.reshape(filters, n, dim) / ids.shape[1]
                place = best[:, None] + np.arange(n)
                real = (place < len(ids)) & (d != 0)[:, None]
                at.append(ids[place[real]].ravel())
                gradients.append(np.repeat(back[real], ids.shape[1], 0))
                step(kernels[i], state[1 + i], slice(None), (windows * d[:, None]).T)
                step(offsets[i], state[1 + len(WIDTHS) + i], slice(None), d)
            touched, slot = np.unique(np.concatenate(at), return_inverse=True)
            if len(touched):
                total = np.zeros((len(touched), dim), np.float32)
                np.add.at(total, slot, np.concatenate(gradients))
                step(vectors, state[0], touched, total)


def _rows(rows: pa.Table, kept_back: bool) -> tuple[Iterator[str], list[int]]:
    """Texts and labels of a task: of every fourth row, which is kept back, or of the others."""
    part = np.nonzero((np.arange(len(rows)) % 4 == 3) == kept_back)[0]
    return texts_of(rows, part), rows.column("y").to_numpy()[part].tolist()


def _language_words(rows: DataFrame, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of all rows; hashes of their common words, sorted; per such word the
    logarithms of its share in each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for chunk in w.chunks(own):
                    found, n = np.unique(_words(chunk, buckets)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "word", "n"],
                    )

    known = rows.select("text", F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    languages = sorted(r["lang"] for r in most.collect())
    counts = cut_lineage(
        known.where(F.col("lang").isin(languages)).mapInArrow(count, "lang string, word long, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "language-words",
    )
    totals = {r["lang"]: r["n"] + 1 for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = counts.withColumn("place", place).where(F.col("place") <= LANGUAGE_WORDS).select("word").distinct()
    # At most LANGUAGES * LANGUAGES * LANGUAGE_WORDS narrow rows.
    table = counts.join(F.broadcast(common), "word").toArrow()
    words, slot = np.unique(table.column("word").to_numpy().view(np.uint64), return_inverse=True)
    shares = np.full((len(words), len(languages)), 0.5)
    numbers = {x: i for i, x in enumerate(languages)}
    shares[slot, [numbers[x] for x in table.column("lang").to_pylist()]] += table.column("n").to_numpy()
    odds = np.log(shares / np.array([totals.get(x, 1) for x in languages], np.float64))
    return languages, words, odds.astype(np.float32)


def _known(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that stand for languages, and their numbers."""
    if not len(common):
        return np.zeros(0, int), np.zeros(0, int)
    slot = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    place = np.nonzero(common[slot] == hashes)[0]
    return place, slot[place]


def _shifts(bins: np.ndarray, languages: int) -> np.ndarray:
    """Per language, and last for all together, the logit that separates the labels best.

    ``bins`` has a row for each language number, rounded logit and label: how many rows
    have them, and their least and greatest logit."""

    def cut(own: np.ndarray) -> float | None:
        logits, slot = np.unique(own[:, 1], return_inverse=True)
        least, most = np.full(len(logits), np.inf), np.full(len(logits), -np.inf)
        np.minimum.at(least, slot, own[:, 4])
        np.maximum.at(most, slot, own[:, 5])
        below, above = (np.bincount(slot, own[:, 3] * (own[:, 2] == y), len(logits)) for y in (1, 0))
        if below.sum() < 5 or above.sum() < 5:
            return None
        # Errors of a cut before a logit: positives below it, negatives from it on.
        errors = np.concatenate([[0], np.cumsum(below)]) + np.concatenate([np.cumsum(above[::-1])[::-1], [0]])
        best = np.nonzero(errors == errors.min())[0]
        i = int(best[len(best) // 2])
        low = most[i - 1] if i else least[0] - 1
        high = least[i] if i < len(least) else most[-1] + 1
        return float((low + high) / 2)

    every = cut(bins)
    every = np.log(THRESHOLD / (1 - THRESHOLD)) if every is None else every
    own = [cut(bins[bins[:, 0] == n]) for n in range(languages)]
    return np.array([every if c is None else c for c in own] + [every], np.float64)


def _separated(rows: DataFrame, model: dict[str, np.ndarray], languages: int) -> np.ndarray:
    """:func:`_shifts` from the logits of all rows that are kept back."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(own: pa.Table) -> pa.Table:
        texts, labels = _rows(in_order(own), True)
        z, guess = _logits(shared.value)(list(texts))
        bins = np.rint(np.clip(z, -30, 30) * LOGIT_BINS).astype(np.int64)
        columns = (guess.astype(np.int64), bins, np.array(labels, np.int64), z.astype(np.float64))
        judged = pa.table([pa.array(c) for c in columns], ["guess", "bin", "y", "z"])
        counted = judged.group_by(["guess", "bin", "y"]).aggregate([("z", "count"), ("z", "min"), ("z", "max")])
        names = ["guess", "bin", "y", "n", "least", "most"]
        return counted.select(["guess", "bin", "y", "z_count", "z_min", "z_max"]).rename_columns(names)

    # At most 60 * LOGIT_BINS logits of two labels in each language.
    counted = (
        rows.groupBy("task").applyInArrow(judge, "guess long, bin long, y long, n long, least double, most double")
        .groupBy("guess", "bin", "y").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        .toArrow()
    )
    return _shifts(np.stack([c.to_numpy() for c in counted.columns], 1).astype(np.float64).reshape(-1, 6), languages)


def train(documents: DataFrame, labels: DataFrame, learn: Column, task_rows: int = TASK_ROWS,
          buckets: int = BUCKETS, dim: int = DIM, filters: int = FILTERS, epochs: int = EPOCHS,
          rate: float = RATE) -> bytes:
    """The model as bytes; parameters set its size.  ``learn`` says which labels may be used."""
    rows, tasks = labelled(documents, labels, "toxic", learn, task_rows)
    rows.persist(StorageLevel.DISK_ONLY)
    alone = tasks == 1
    start = _start(np.random.default_rng(11), buckets, dim, filters)

    def run(own: pa.Table, flat: np.ndarray, number: int) -> np.ndarray:
        texts, ys = _rows(own, False)
        docs = list(zip(_words_per_text(texts, buckets), ys))
        rng = np.random.default_rng(11 + number)
        like = _start(rng, buckets, dim, filters)
        half = len(flat) // 2
        passes = max(epochs, -(-STEPS // len(docs))) if alone else -(-STEPS // (epochs * len(docs)))
        _learn(docs, _shaped(flat[:half], like), _shaped(flat[half:], like), passes, rate, rng)
        return flat

    first = _flat(start)
    first = np.concatenate([first, np.full_like(first, 1e-2)])
    trained = train_in_rounds(rows, first, 1 if alone else epochs, run)
    languages, common, odds = _language_words(rows, buckets)
    params = _shaped(first if trained is None else trained, start)
    model = dict(vectors=params[0], out=params[-2], bias=params[-1], learned=np.array([trained is not None]),
                 common=common, odds=odds)
    for n in range(len(WIDTHS)):
        model |= {f"k{n}": params[1 + n], f"o{n}": params[1 + len(WIDTHS) + n]}
    model["shifts"] = _separated(rows, model, len(languages))
    rows.unpersist()
    buffer = io.BytesIO()
    np.savez(buffer, **model)
    return buffer.getvalue()


def _logits(model: dict[str, np.ndarray]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """``texts -> logits before any shift, and numbers of the likeliest languages`` (-1
    without any known word)."""
    vectors, out, bias, common, odds = (model[k] for k in ("vectors", "out", "bias", "common", "odds"))
    kernels = [model[f"k{n}"] for n in range(len(WIDTHS))]
    offsets = np.concatenate([model[f"o{n}"] for n in range(len(WIDTHS))])
    buckets, dim = vectors.shape
    filters = kernels[0].shape[1]
    # The response of a window is a sum over its words: one product for all of them.
    slices = np.hstack([k[j * dim : (j + 1) * dim] for n, k in zip(WIDTHS, kernels) for j in range(n)])
    overlap = max(WIDTHS) - 1

    def logits(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The window after the last word holds zero vectors only: no response is below 0.
        best = np.zeros((len(texts), len(offsets)), np.float32)
        language = np.zeros((len(texts), odds.shape[1]))
        known = np.zeros(len(texts), bool)
        for chunk in w.chunks(texts, overlap):
            ids, hashes, piece = _words(chunk, buckets)
            if not len(ids):
                continue
            total = vectors[ids[:, 0]]
            for c in range(1, ids.shape[1]):
                total += vectors[ids[:, c]]
            # Zero rows keep windows from reaching into the next text.
            row = np.arange(len(ids)) + piece * overlap
            padded = np.zeros((row[-1] + 1 + overlap, slices.shape[1]), np.float32)
            padded[row] = (total / ids.shape[1]) @ slices
            response = np.zeros((len(padded), len(offsets)), np.float32)
            column = 0
            for n, width in enumerate(WIDTHS):
                at = slice(n * filters, (n + 1) * filters)
                for j in range(width):
                    response[: len(padded) - j, at] += padded[j:, column : column + filters]
                    column += filters
            first = np.nonzero(np.diff(piece, prepend=-1))[0]
            # A piece ends where the next begins; the pad rows between hold partial
            # windows only of words that belong to neither, so they are left out.
            owner = chunk.owner[piece[first]]
            np.maximum.at(best, owner, np.maximum.reduceat(response[row], first))
            place, slot = _known(hashes, common)
            mine = chunk.owner[piece[place]]
            np.add.at(language, mine, odds[slot])
            known[mine] = True
        z = np.maximum(best + offsets, 0) @ out + bias[0]
        return z, np.where(known, language.argmax(1) if odds.shape[1] else 0, -1)

    return logits


def _scorer(blob: bytes) -> Callable[[list[str]], np.ndarray]:
    model = dict(np.load(io.BytesIO(blob)))
    if not model["learned"][0]:
        return lambda texts: np.full(len(texts), 0.5)
    logits, shifts = _logits(model), model["shifts"]
    target = np.log(THRESHOLD / (1 - THRESHOLD))

    def scores(texts: list[str]) -> np.ndarray:
        z, guess = logits(texts)
        score = 1 / (1 + np.exp(-np.clip(z - shifts[guess] + target, -30, 30)))
        # Without a word there is nothing to judge.
        empty = np.array([not any(c.isalnum() for c in t) for t in texts], bool)
        return np.where(empty, np.minimum(score, THRESHOLD - 1e-6), score)

    return scores


def score_column(spark, model: bytes) -> Callable[[Column], Column]:
    """``text -> score`` for a model of ``train``."""
    shared = spark.sparkContext.broadcast(model)  # of a size set by parameters
    return per_batch(lambda: _scorer(shared.value), pa.float64(), "double")


def score_documents(documents: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    A NULL doc_id is never learned from; its ``held_out`` is false.  Repeated rows are
    scored one by one.  Other columns are ignored.
    """
    learn = fold(F.col("doc_id"), FOLDS) != HELD
    score = score_column(documents.sparkSession, train(documents, labels, learn, **parameters))
    return documents.select("doc_id", score(F.col("text")).alias("score")).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
