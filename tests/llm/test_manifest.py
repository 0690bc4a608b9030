"""The Merkle manifest against one built by hand."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from phonoframe.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, leaf string"


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def tree(nodes):
    """The root, and each leaf's siblings (left, right) of every level."""
    steps, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for i in range(len(nodes)):
            a = at[i] // 16 * 16
            steps[i].append((level[a : at[i]], level[at[i] + 1 : a + 16]))
            at[i] //= 16
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], steps


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = tree([leaf_of(r) for r in groups[s]])
    if not names:
        return []
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops, strict=True):
        for r, steps in zip(groups[s], trees[s][1], strict=True):
            steps = steps + top
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc = leaf_of((r[0], text, *r[2:]))
            for left, right in steps:
                acc = h(*left, acc, *right)
            out.append((r[0], leaf_of(r), trees[s][0], root, h(*(x for left, right in steps for x in [*left, *right])), acc, acc == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in manifest.lowered(df).collect()), key=str)


def row(i, text, source, lang="en", n=3):
    return (i, text, lang, source, n, "clash", "clash")


def test_sizes_of_groups_and_sparse_keys(spark):
    r = random.Random(1)
    rows = []
    for source, n in (("a", 1), ("b", 16), ("c", 17), ("d", 300), ("é", 33), (None, 5), ("", 2), ("=", 257)):
        ids = set()
        while len(ids) < n:
            ids.add(r.choice([r.randrange(600), r.randrange(-(1 << 63), 1 << 63), r.randrange(1 << 30), -r.randrange(100)]))
        rows += [row(i, r.choice(["Text", "text", "", None, "ÄA " * 50]), source, r.choice(["en", None]), r.choice([None, 5])) for i in ids]
    got = run(spark, rows)
    assert got == by_hand(rows)
    assert {v for *_, v in got} == {True, False}


def test_many_groups(spark):
    rows = [row(i, f"T{i}", f"s{i % 300}") for i in range(700)]
    assert run(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("copies", [3, 70])
def test_repeated_keys_and_rows(spark, monkeypatch, copies):
    monkeypatch.setattr(manifest, "COPIES", 16)
    rows = [row(i, f"T{i}", "ab"[i % 2]) for i in range(100)]
    rows += [row(7, f"T{i % 5}", "b") for i in range(copies)] + [row(None, f"T{i}", "a") for i in range(copies)] + [row(None, "x", None)] * copies
    assert run(spark, rows) == by_hand(rows)


def test_one_row_and_none(spark):
    assert run(spark, []) == []
    for text in ("A", None, "x" * 1_000_000):
        rows = [row(0, text, None)]
        assert run(spark, rows) == by_hand(rows)


def test_other_tables_and_fields(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part"), F.lit("v").alias("v"))
    done = manifest.audited(df, "k", "part", ("k", "v"), {"v": F.lit("w")}, F.col("k") == 11)
    assert {r["k"] for r in done.filter("not verified").collect()} == {11}
    assert done.select("root").distinct().count() == 1
