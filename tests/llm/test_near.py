import itertools
import random

import numpy as np
import pytest

from phonoframe.llm import near

DOCS = "uid long, text string"


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n)]


def jaccard(s, t):
    a, b = (set(near.shingle_set(x or "").tolist()) for x in (s, t))
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(texts, similarity=0.8):
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= similarity:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    return {i: r for i, r in enumerate(root) if root.count(r) > 1}


def copies(rng, sizes=(60, 150, 400)):
    """Copies with a stretch of other words at the end, of similarities from 0.6 to 1."""
    texts = []
    for n in sizes:
        for share in (0.6, 0.7, 0.76, 0.78, 0.82, 0.85, 0.9, 0.95):
            base = words(rng, n)
            k = round(n * (1 - share) / (1 + share))
            texts += [" ".join(base), " ".join(base[: n - k] + words(rng, k))]
    return texts


@pytest.mark.parametrize("small_parts", [False, True])
def test_near_groups_are_those_of_all_pairs(spark, monkeypatch, small_parts):
    """Small parts: large groups and hot buckets are cut, and some of their rows aren't like the first one."""
    rng = random.Random(2)
    base, texts = words(rng, 200), copies(rng)
    for i in range(40):  # one group of many copies
        texts.append(" ".join(base[:i] + ["other"] + base[i + 1 :]))
    texts += ["", None, " ", "a b", "A  b", "alone"]
    if small_parts:
        monkeypatch.setattr(near, "PART_TEXTS", 7)
        monkeypatch.setattr(near, "BUCKET_ROWS", 5)
        chain = words(rng, 120)
        for i in range(0, 60, 3):  # each is like the next, the last isn't like the first
            texts.append(" ".join(words(rng, i) + chain[i:]))
            chain = texts[-1].split()
        texts += [t.upper() for t in texts[-20:]]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["uid"]: r["root"] for r in near.near_groups(df, "uid").collect()}
    assert got == brute(texts)


def test_most_pairs_of_the_least_similarity_are_fetched():
    """0.8 to 0.82: a 64-bit fingerprint within 6 bits finds about a fifth."""
    rng = random.Random(7)
    found = total = 0
    for _ in range(150):
        n = rng.choice((80, 200, 500))
        base = words(rng, n)
        other = base[: n - round(n * 0.105)] + words(rng, round(n * 0.105))
        if not 0.8 <= jaccard(" ".join(base), " ".join(other)) < 0.84:
            continue
        a, b = (near.long_fingerprint(near.shingle_set(" ".join(x))) for x in (base, other))
        split = near.BLOCKS // 4
        total += 1
        found += bool((a[:split].view(np.uint16) == b[:split].view(np.uint16)).any()) and int(np.bitwise_count(a[split:] ^ b[split:]).sum()) <= near.MOST_BITS
    assert total > 50 and found >= 0.95 * total


@pytest.mark.parametrize("more", [1, 2, 4])
def test_longer_keys_of_larger_tables_fetch_as_many(more):
    rng = random.Random(9)
    nibbles = near.key_nibbles(near.CHANCE_ROWS << (12 + 4 * more))
    assert nibbles.shape == (near.BLOCKS << more, 4 + more)
    assert all(len(set(k)) == 4 + more for k in nibbles.tolist())
    found = total = 0
    while total < 60:
        n = rng.choice((80, 200, 500))
        base = words(rng, n)
        other = base[: n - round(n * 0.105)] + words(rng, round(n * 0.105))
        if not 0.8 <= jaccard(" ".join(base), " ".join(other)) < 0.84:
            continue
        keys = near.block_keys(np.stack([near.long_fingerprint(near.shingle_set(" ".join(x))) for x in (base, other)]), nibbles)
        total += 1
        found += bool((keys[0] == keys[1]).any())
    assert found >= 0.95 * total


def test_rows_that_share_a_key_by_chance_stay_few():
    for power in range(8, 38):
        keys, width = near.key_nibbles(1 << power).shape
        assert (1 << power) >> (4 * width) < near.CHANCE_ROWS and keys <= 16 * near.BLOCKS


def test_keys_tell_blocks_apart():
    fp = np.zeros((1, near.BLOCKS // 4 + near.CHECK), np.uint64)
    for n in (0, 1 << 30, 1 << 40):
        nibbles = near.key_nibbles(n)
        assert len(np.unique(near.block_keys(fp, nibbles))) == len(nibbles)


def test_connected_rows_take_no_pairs():
    n = 200_000
    x, y = near.forest(np.zeros((n, 2), np.uint64), np.zeros(n, np.int64), 1)
    assert len(x) == n - 1 and not y.any()


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 40
        check = rng.integers(0, 4, (n, 2), dtype=np.uint64) << np.uint64(3)
        group = np.sort(rng.integers(0, 4, n))
        x, y = near.forest(check, group, 1)

        def tops(pairs):
            root = list(range(n))
            for i, j in pairs:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
            return root

        close = [(i, j) for i, j in itertools.combinations(range(n), 2) if group[i] == group[j] and np.bitwise_count(check[i] ^ check[j]).sum() <= 1]
        assert tops(zip(x, y, strict=True)) == tops(close)
