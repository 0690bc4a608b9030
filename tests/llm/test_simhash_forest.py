import itertools

import numpy as np
import pytest

from phonoframe.llm import simhash


def roots(n, pairs):
    root = list(range(n))
    for i, j in pairs:
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    return root


def test_lowest_keeps_earlier_links():
    """x = 5 has r = 3 from before; (p, x) and (t, r) come now."""
    low = np.array([0, 1, 2, 3, 4, 3])
    got = simhash._lowest(low, np.array([2, 1]), np.array([5, 3]))
    assert got.tolist() == roots(6, [(5, 3), (2, 5), (1, 3)])


@pytest.mark.parametrize("held", [0, 5, 1 << 20])
def test_forest_in_chunks(monkeypatch, held):
    monkeypatch.setattr(simhash, "PAIRS", held)
    rng = np.random.default_rng(held)
    for _ in range(300):
        n = 30
        fp = rng.integers(0, 2**10, n, dtype=np.uint64)
        group = np.sort(rng.integers(0, 2, n))
        a, b = simhash._forest(fp, group, 2)
        close = [(i, j) for i, j in itertools.combinations(range(n), 2) if group[i] == group[j] and int(fp[i] ^ fp[j]).bit_count() <= 2]
        assert roots(n, zip(a, b, strict=True)) == roots(n, close)


def test_components_say_when_rounds_do_not_do(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.components(edges, rounds=1).count()


def test_components_of_stars_take_no_round(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(21, 20)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges, rounds=0).collect()}
    assert got == {i: 0 for i in range(1, 9)} | {21: 20}
