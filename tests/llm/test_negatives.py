"""Hard negatives against all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoframe.llm import negatives


def brute(rows, every=100, scale=256):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = (label, [math.floor(scale * x) for x in v])
            good[i] = min(q, good.get(i, q))
    out = []
    for a, (label, q) in good.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(q, r)) for i, (_, r) in good.items()}
        order = sorted(good, key=lambda i: (-score[i], i))
        liked = [i for i in order if i != a and good[i][0] == label][:5]
        for p in liked:
            window = [i for i in order if good[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(window)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("x")).repartition(3)
    return sorted(map(tuple, negatives.mine_negatives(df).collect()))


def table(n, width, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[r.integers(6)] + spread * r.normal(size=width)
        v /= np.sqrt((v * v).sum())
        rows.append((i, [float(np.float32(x)) for x in v], int(r.integers(4))))
    return rows


@pytest.mark.parametrize(("width", "spread"), [(8, 0.2), (3, 1.0), (40, 0.5)])
def test_equal_to_all_pairs(spark, monkeypatch, width, spread):
    monkeypatch.setattr(negatives, "TILE", 37)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "SLICE", 4)
    rows = table(700, width, width, spread)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = table(320, 6, 1)
    rows += [(None, [1.0] * 6, 1), (1000, None, 1), (1001, [1.0] * 6, None), (1002, [1.0, None] * 3, 1), (1003, [float("nan")] * 6, 1), (1004, [float("inf")] * 6, 2), (1100, [0.0] * 6, 1), (1005, [0.0] * 6, 1)]
    rows += [(2000 + i, rows[200][1], i % 3) for i in range(40)]  # ties
    rows += [(200, rows[200][1], 0), (200, rows[200][1], 0), (300, rows[5][1], 3)]  # repeated keys
    rows += [(1200, [0.5, 0.5], 2), (1201, [], 1), (1300, [x * 1000 for x in rows[7][1]], 0)]  # other lengths and norms
    rows += [(1400, [0.3] * 6, 77)]  # alone in its class
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(5, [1.0], 1)]) == []
    assert run(spark, [(100, [1.0], 1)]) == []


def test_bounds_hold_and_skip(spark):
    """Every score lies in its bounds, and rows far from what is searched aren't scored."""
    r = np.random.default_rng(3)
    q = np.floor(256 * np.concatenate([r.normal(size=(50, 16)), 50 + r.normal(size=(50, 16)), -50 + r.normal(size=(50, 16))])).astype("<i8")
    references = q[[0, 60, 120]] / np.sqrt((q[[0, 60, 120]] ** 2).sum(1))[:, None]
    ids, labels = np.arange(len(q)), np.ones(len(q), int)
    scored = []
    real = negatives.products
    block = {"id": [1000], "label": [1], "q": [q[60].tolist()], "angles": negatives.angles_to(q[60:61], references).tolist(), "least": [[-(1 << 61)]], "greatest": [[1 << 61]]}
    held = negatives.Held(block, True, 5, 3)
    negatives.products = lambda a, b: scored.append(len(b)) or real(a, b)
    try:
        for part in (slice(50, 100), slice(0, 50), slice(100, 150)):
            held.meet({"n": 50, "ids": ids[part].astype("<i8").tobytes(), "labels": labels[part].astype("<i8").tobytes(), "q": q[part].tobytes(), "norms": negatives.norms_of(q[part]).tobytes(), "angles": negatives.angles_to(q[part], references).tobytes()})
    finally:
        negatives.products = real
    assert sum(scored) <= 50
    score = q @ q[60]
    assert set(held.best[2]) == set(sorted(ids, key=lambda i: (-score[i], i))[:5])


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[3**19, 5]]), np.array([[3**19 + 1, 7]])
    assert negatives.products(a, b)[0, 0] == 3**19 * (3**19 + 1) + 35
    with pytest.raises(ValueError, match="does not fit"):
        negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
