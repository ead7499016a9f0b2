import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.llm import hard_negatives as hn


def plain(rows):
    """rows: (vec_id, vector, label), each once."""
    used = []
    for vec_id, vector, label in dict.fromkeys((i, None if v is None else tuple(v), y) for i, v, y in rows):
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for a in used:
        if a[0] % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1]) for r in used if r is not a]
        scored.sort()
        for p in [s for s in scored if s[2] == a[1]][:5]:
            good = [n for n in scored if n[2] != a[1] and 50 * -p[0] <= 100 * -n[0] <= 95 * -p[0]][:3]
            out += [(a[0], p[1], k, n[1], -p[0], -n[0]) for k, n in enumerate(good, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_equals_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) + (k % 10 == i % 10) for k in range(12)], i % 10) for i in range(700)]
    # Ties: equal vectors under several ids.
    rows += [(700 + i, rows[0][1], 3) for i in range(12)] + [(720 + i, rows[50][1], 7) for i in range(12)]
    found = hn.mine(frame(spark, rows)).collect()
    assert sorted(tuple(r) for r in found) == plain(rows) and len(found) > 50


def test_small_blocks_and_packs(spark, monkeypatch):
    for name, value in (("BLOCK", 4), ("GROUP_PAIRS", 300), ("PACK", 7), ("BUFFER", 10)):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(2)
    rows = [(i, [rng.randint(-3, 9) / 4 for _ in range(5)], i % 3) for i in range(600)]
    assert sorted(tuple(r) for r in hn.mine(frame(spark, rows)).collect()) == plain(rows)


def test_odd_rows(spark):
    near = [1.0, 0.5, 0.25]
    rows = [(0, near, 1), (1, near, 2), (1, near, 2), (2, None, 2), (3, [1.0, None, 0.0], 2), (4, [math.nan, 1.0, 1.0], 2),
            (5, near, None), (None, near, 2), (6, [math.inf, 0.0, 0.0], 2), (8, [], 2), (9, [0.9], 1), (10, [0.7, 0.4, 0.2, 5.0], 1),
            (11, [1e300, 0.0, 0.0], 2), (50, near, 3), (7, near, 9), (100, [0.0, 0.0, 0.0], 4), (101, [0.0], 4), (102, [0.0, 0.0, 0.0], 5)]
    table = frame(spark, rows)
    for name in ("v", "score", "role", "a.b"):
        table = table.withColumn(name, F.lit(1))
    usable = [r for r in rows if r[0] != 11]
    assert sorted(tuple(r) for r in hn.mine(table).collect()) == plain(usable) != []
    assert hn.mine(table.limit(0)).count() == 0


@pytest.mark.parametrize("largest, width", [(256, 4), (1 << 20, 8), (1 << 30, 16)])
def test_packed_products_are_exact(largest, width):
    rng = random.Random(largest)
    rows = [[rng.choice((-largest, largest, rng.randint(-largest, largest))) for _ in range(5)] for _ in range(40)]
    anchors = [[rng.choice((-largest, largest)) for _ in range(5)] for _ in range(5)]
    assert hn.field_width(largest, 5) == width
    packed = hn.pack(rows, largest, width)
    raw = [hn.scores(a, packed, len(rows), largest, width) for a in anchors]
    found = hn.unpack(raw, anchors, 5, len(rows), largest, width)
    assert found.dtype == np.int64
    assert found.tolist() == [[sum(x * y for x, y in zip(a, r)) for r in rows] for a in anchors]
