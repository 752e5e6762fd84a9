"""Hard negatives against brute force, with ties, repeated rows, null and odd vectors, and other columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, anchor string, score string, part int"


def rows(n, dim, seed, values=None):
    rng = random.Random(seed)
    pick = (lambda: rng.choice(values)) if values else (lambda: rng.gauss(0, 0.3))
    return [(i, [float(np.float32(pick())) for _ in range(dim)], rng.randint(0, 3), "r", "a", "s", 1) for i in range(n)]


def brute(rows_, k=5, m=10):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64), lab) for i, v, lab, *_ in rows_
            if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for at, (a, q, lab) in enumerate(good):
        if a is None or a % 10:
            continue
        same, other = [], []
        for j, (i, v, of) in enumerate(good):
            if j != at and len(v) == len(q):
                (same if of == lab else other).append((int(v @ q), i))
        for s, p in sorted(same, key=order)[:k]:
            fit = sorted((r for r in other if 30 * s <= 100 * r[0] <= 90 * s), key=order)[:m]
            out += [(a, p, n, i, s, t) for n, (t, i) in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, data):
    out = negatives.mine(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("dim", [1, 7, 8, 20])
def test_random_vectors(spark, dim, monkeypatch):
    monkeypatch.setattr(negatives, "PART_ROWS", 50)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 7)
    data = rows(230, dim, dim)
    assert mined(spark, data) == brute(data)


def test_ties_and_repeats(spark):
    data = rows(120, 3, 5, values=[0.0, 0.25, -0.25])  # few scores, so ties everywhere
    data += [data[10], data[10], data[20]]  # repeated rows, anchors among them
    data += [(None, [0.25, 0.25, 0.0], 1, "r", "a", "s", 1), (200, [0.25] * 5, 1, "r", "a", "s", 1), (210, [], 1, "r", "a", "s", 1), (211, [], 1, "r", "a", "s", 1), (212, [], 2, "r", "a", "s", 1)]
    data += [(220, None, 1, "r", "a", "s", 1), (230, [0.1, None, 0.2], 1, "r", "a", "s", 1), (240, [0.1, float("nan"), 0.2], 1, "r", "a", "s", 1),
             (250, [0.1, float("inf"), 0.2], 1, "r", "a", "s", 1), (260, [0.1, 0.2, 0.2], None, "r", "a", "s", 1)]
    got = mined(spark, data)
    assert got == brute(data)
    assert any(r[0] == 210 for r in got)  # vectors without components score 0


def test_one_vector_repeated(spark):
    data = [(i, [0.5] * 9, i % 2, "r", "a", "s", 1) for i in range(300)]
    assert mined(spark, data) == []  # a negative scores as much as the positive, above 90 %
    data += [(301, [0.3] * 9, 1, "r", "a", "s", 1), (302, [0.3] * 9, 1, "r", "a", "s", 1)]
    assert mined(spark, data) == brute(data)


def test_scores_are_exact(spark):
    data = [(10, [1e6, -1e6 - 1 / 16], 1, "r", "a", "s", 1), (11, [1e6, -1e6], 1, "r", "a", "s", 1), (12, [5e5, -5e5], 2, "r", "a", "s", 1)]
    assert mined(spark, data) == brute(data) != []
    with pytest.raises(ValueError, match="63 bits"):
        mined(spark, [(10, [1e15], 1, "r", "a", "s", 1)])


def test_planes_and_tables():
    rng = np.random.default_rng(1)
    for dim in (0, 1, 8, 13):
        q, a = rng.integers(-512, 512, (40, dim)), rng.integers(-512, 512, (9, dim))
        assert (negatives.scores(negatives.subset_sums(a), negatives.planes(q, 10)) == q @ a.T).all()
