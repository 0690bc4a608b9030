import hashlib
import random

import pytest

from phonoframe.llm import fuse, snapshots

DOCS = "doc_id long, text string, digest int, known string"


def batch(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in rows], DOCS)


def brute(rows, stored):
    """What ingest says of a batch, and what is stored after it."""
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    least = lambda k: -1 if k is None else k
    said, after = [], dict(stored)
    for t, keys in groups.items():
        top = max(keys, key=least)
        for k in keys:
            keep = stored.get(t, top)
            said.append((k, keep, len(keys), t in stored, t not in stored and k == top, hashlib.sha256(t.encode()).hexdigest()))
        after.setdefault(t, top)
    return sorted(said, key=str), after


@pytest.mark.parametrize("bound", [fuse.BROADCAST_BYTES, 0])
def test_batches_meet_the_snapshots_of_earlier_ones(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(fuse, "BROADCAST_BYTES", bound)
    rng, stored, key = random.Random(5), {}, 0
    for name in ("a", "b", "c"):
        rows = []
        for _ in range(120):
            key += 1
            rows.append((key, rng.choice(["hot", None, "", "e\u0301", "w " * 5000, f"t{rng.randint(0, 90)}", f"{name}{rng.randint(0, 30)}"])))
        want, stored = brute(rows, stored)
        got = snapshots.ingest(batch(spark, rows), str(tmp_path), name).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    held = [r for name in snapshots.names(spark, str(tmp_path)) for r in spark.read.parquet(f"{tmp_path}/{name}/rows").collect()]
    assert {r["text"]: r["key"] for r in held} == stored and len(held) == len(stored)


def test_snapshots_dont_change_and_cut_off_ones_are_written_again(spark, tmp_path):
    one = batch(spark, [(1, "a"), (None, "a"), (2, "b"), (2, "b")])
    snapshots.ingest(one, str(tmp_path), "one")
    with pytest.raises(ValueError, match="one"):
        snapshots.ingest(one, str(tmp_path), "one")
    (tmp_path / "one" / "filters" / "_SUCCESS").unlink()
    assert snapshots.names(spark, str(tmp_path)) == []
    got = snapshots.ingest(one, str(tmp_path), "one").collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(0, 1, 2, False), (1, 1, 2, True), (2, 2, 2, True), (2, 2, 2, True)]
    assert snapshots.names(spark, str(tmp_path)) == ["one"]
    again = snapshots.ingest(one, str(tmp_path), "two").collect()
    assert all(r["known"] and not r["kept"] for r in again)


def test_empty_batches(spark, tmp_path):
    assert snapshots.ingest(batch(spark, []), str(tmp_path), "none").count() == 0
    assert snapshots.ingest(batch(spark, [(1, "a")]), str(tmp_path), "some").first()["kept"]
