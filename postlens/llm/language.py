"""Language identification: n-gram filters with one bit per language.

A Bloom filter of each language's frequent character n-grams and words is stored bit
by bit across languages: slot i holds the bits of all languages at position i, so one
look-up of an n-gram returns all languages that contain it.  A text's hits are counted
per language, the hits expected from the filter's own false positives are taken off,
and the language with the largest rest wins (ties: first by name).

Filters are learned from a bounded sample of rows of each language.  Inputs of a
prediction are the characters of the text and nothing else.  NULL texts and texts
without a letter are ``und`` with score 0, as are all texts when nothing was learned.
Texts are read whole.  Equal texts have equal predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as w
from .common import bounded_sample, fold, per_batch

SLOTS = 1 << 19
PROBES = 2
SHORTEST, LONGEST = 2, 4
#: N-grams that a language's filter takes at most, the most frequent ones.
GRAMS = 20_000
#: Rows per language that learning reads.
PER_LANGUAGE = 400
#: Languages of the sample at most, the most frequent ones; bounds the model.
LANGUAGES = 1024
UNKNOWN = "und"
FOLDS, HELD = 4, 2


def _grams(chunk: w.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of words and n-grams, ASCII in lower case, and their places in the chunk.

    Digits and ASCII signs separate words."""
    points = w.lower_ascii(chunk.points)
    letter = (points >= 128) | ((points >= 97) & (points <= 122))
    found = w.words(points, ~letter, chunk.starts)
    yield w.mix(found.hashes() + np.uint64(1)), found.start
    for n, hashes, good in w.char_grams(points, ~letter, LONGEST):
        if n >= SHORTEST:
            place = np.nonzero(good)[0]
            yield hashes[place], place


def _slots(hashes: np.ndarray, probe: int, slots: int) -> np.ndarray:
    """Position of each n-gram for the given hash function of the filter."""
    bits = np.uint64(slots.bit_length() - 1)
    return ((hashes >> np.uint64(probe * 22)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _filter_bits(texts: list[str], grams: int, slots: int) -> np.ndarray:
    """One language's filter: a bit per slot."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for chunk in w.chunks(texts):
        new = np.concatenate([h for h, _ in _grams(chunk)])
        fresh, n = np.unique(new, return_counts=True)
        keys, where = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
    order = np.lexsort((keys, -counts))[:grams]
    bits = np.zeros(slots, bool)
    for probe in range(PROBES):
        bits[_slots(keys[order], probe, slots)] = True
    return bits


def train(documents: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, grams: int = GRAMS,
          slots: int = SLOTS) -> tuple[list[str], np.ndarray]:
    """Languages in name order and the sliced filter, ``slots x words`` of 64 bits.

    At most ``per_language`` rows of a language are read, in the order of a hash of
    their id, and at most ``LANGUAGES`` languages.  Each language is one task."""
    known = documents.select("doc_id", F.col("lang").cast("string").alias("lang")).where(
        learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)
    )
    languages = sorted(
        r["lang"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    )
    if not languages:
        return [], np.zeros((slots, 1), np.uint64)
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        known.where(F.col("lang").isin(languages))
        .withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= per_language)
        .select("doc_id")
        .distinct()
    )
    # A chosen id may have other rows, of a language that is not learned.
    sample = bounded_sample(documents.where(F.col("lang").cast("string").isin(languages)), chosen, per_language * len(languages), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[str]] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
        for lang in sorted(texts):
            bits = np.packbits(_filter_bits(texts[lang], grams, slots)).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([bits], pa.binary())], ["lang", "bits"])

    parts = sample.repartition(len(languages), "lang").mapInArrow(run, "lang string, bits binary").collect()
    filters = {r["lang"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in parts if r["lang"] in languages}
    names = sorted(filters)
    sliced = np.zeros((slots, -(-len(names) // 64)), np.uint64)
    for k, name in enumerate(names):
        sliced[:, k // 64] |= filters[name].astype(np.uint64) << np.uint64(k % 64)
    return names, sliced


def _predictor(names: list[str], sliced: np.ndarray) -> Callable[[list[str]], list[dict]]:
    slots = len(sliced)
    fill = np.array([((sliced[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))])
    false = np.minimum(fill**PROBES, 0.999)

    def predict(texts: list[str]) -> list[dict]:
        hits = np.zeros((len(texts), len(names)))
        total = np.zeros(len(texts))
        for chunk in w.chunks(texts) if names else ():
            counts = np.zeros((len(chunk.starts), len(names)))
            n = np.zeros(len(chunk.starts))
            for hashes, place in _grams(chunk):
                cuts = np.searchsorted(place, np.append(chunk.starts, len(chunk.points)))
                n += np.diff(cuts)
                for word in range(sliced.shape[1]):
                    masks = sliced[_slots(hashes, 0, slots), word]
                    for probe in range(1, PROBES):
                        masks &= sliced[_slots(hashes, probe, slots), word]
                    for k in range(64 * word, min(64 * word + 64, len(names))):
                        bit = ((masks >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int32)
                        sums = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
                        counts[:, k] += sums[cuts[1:]] - sums[cuts[:-1]]
            np.add.at(hits, chunk.owner, counts)
            np.add.at(total, chunk.owner, n)
        out = []
        rest = np.maximum(hits - total[:, None] * false, 0) / (1 - false) if names else hits
        for text, row in zip(texts, rest):
            if not names or not any(map(str.isalpha, text)):
                out.append({"lang": UNKNOWN, "score": 0.0})
                continue
            best, everything = int(row.argmax()), float(row.sum())
            out.append({"lang": names[best], "score": float(row[best]) / everything if everything else 0.0})
        return out

    return predict


def predict_column(spark, model: tuple[list[str], np.ndarray]) -> Callable[[Column], Column]:
    """``text -> struct(lang, score)`` for a model of ``train``.  The score is the
    winner's share of all corrected hits."""
    shared = spark.sparkContext.broadcast(model)  # slots x languages / 8 bytes, set by parameters
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])
    return per_batch(lambda: _predictor(*shared.value), kind, "struct<lang: string, score: double>")


def predict_documents(documents: DataFrame, **parameters) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    A NULL doc_id is never learned from; its ``held_out`` is false.  Repeated rows are
    predicted one by one.  Columns other than doc_id, text and lang are ignored.
    """
    model = train(documents, fold(F.col("doc_id"), FOLDS) != HELD, **parameters)
    predict = predict_column(documents.sparkSession, model)
    return documents.select("doc_id", predict(F.col("text")).alias("found")).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD, F.lit(False)).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )
