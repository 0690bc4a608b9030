import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from phonoframe.llm import exact_dedup, fuse, repeats, simhash

DOCS = "doc_id long, text string"


def odd_texts():
    return [None, "", " ", "a", "a", "\x00", "é" * 300, "é" * 300, "word " * 40000, "<|endoftext|>", "same text", "same text", "same text"]


def with_clashes(spark, texts):
    """Columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, b"y") for i, t in enumerate(texts)], f"{DOCS}, uid string, n int, digest binary")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 70000])
def test_fuse_has_no_false_negatives(n):
    keys = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
    f = fuse.build(keys)
    assert fuse.contains(f, keys).all()
    others = np.random.default_rng(n + 1).integers(-(2**63), 2**63 - 1, 20000)
    assert fuse.contains(f, others).mean() < 0.02
    if n > 1000:
        assert len(f) < 1.4 * n + 64


def brute_exact(texts):
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_dedup(spark, batches):
    rng = random.Random(batches)
    texts = odd_texts() + [rng.choice(["hot", "cold", f"t{rng.randint(0, 60)}"]) for _ in range(300)]
    got = exact_dedup.exact_dedup(with_clashes(spark, texts), batches=batches).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_exact(texts)


def test_exact_dedup_without_rows_and_with_null_keys(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")], DOCS)
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [(-1, -1, 1, True), (-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True)]


def test_exact_dedup_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(fuse, "BROADCAST_BYTES", 0)
    texts = ["a", "b", "a", "c", "b", None, ""]
    got = exact_dedup.exact_dedup(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_exact(texts)


def plain_fingerprint(text, words=4):
    """Bit by bit, as the contract words it, with another binding's one-shot hash of each shingle."""
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(texts, words=4, distance=4):
    fp = [plain_fingerprint(t or "", words) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (f"{fp[i]:016x}", find(i)) for i in range(len(texts))}


def near_copies(n, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    texts = []
    for _ in range(n):
        base = rng.choices(words, k=rng.randint(1, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("block_rows", [simhash.BLOCK_ROWS, 3])
def test_simhash_components(spark, block_rows):
    texts = odd_texts() + near_copies(60)
    got = simhash.simhash_components(with_clashes(spark, texts), block_rows=block_rows).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_components(texts)


def test_simhash_other_distances(spark):
    texts = near_copies(30, 5)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for distance in (3, 6):
        got = simhash.simhash_components(df, words=5, distance=distance, block_rows=4 if distance == 3 else 1000).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_components(texts, 5, distance)


def test_simhash_without_rows(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_with_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (5, "other words stand here now"), (None, "alone " * 9), (2, None), (None, "")], DOCS)
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (5, 5), (None, None), (2, 2), (None, 2)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, 61)} | {100: 99}


def brute_repeats(texts, size=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + size] for x in data for i in range(len(x) - size + 1))
    out = {}
    for k, x in enumerate(data):
        removed = [False] * len(x)
        for i in range(len(x) - size + 1):
            if seen[x[i : i + size]] > 1:
                removed[i : i + size] = [True] * size
        kept = bytes(c for c, r in zip(x, removed, strict=True) if not r)
        runs = sum(r and not p for r, p in zip(removed, [False, *removed], strict=False))
        out[k] = (len(x), sum(removed), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeated_texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghéñ", k=rng.randint(2, 9))) for _ in range(800)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(k) for k in (25, 40, 70)]
    texts = []
    for _ in range(60):
        x = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            x += " " + p[a : a + rng.randint(50, len(p))] + " " + prose(rng.randint(0, 40))
        texts.append(x)
    base = prose(60)
    return [*texts, texts[3], texts[3], "", None, "a" * 700, "ab" * 250, "a" * 199, "a" * 200, *(base[: i * 9] + "#" + base[i * 9 :] for i in range(1, 25))]


@pytest.mark.parametrize("limit", [fuse.BROADCAST_BYTES, 1400])
def test_repeats(spark, monkeypatch, limit):
    """With the small limit the filters come in many slices."""
    monkeypatch.setattr(fuse, "BROADCAST_BYTES", limit)
    texts = repeated_texts()
    got = repeats.remove_repeats(with_clashes(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == brute_repeats(texts)
    assert {r["uid"] for r in got} == {"x"}


def test_repeats_of_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    data = [t.encode() for t in repeated_texts(8)[:40] if t]
    whole, cut = ({i: set() for i in range(len(data))} for _ in range(2))
    for out, segment in ((whole, 1 << 20), (cut, 300)):
        monkeypatch.setattr(repeats, "SEGMENT", segment)
        for b in repeats.blocks(data, 200):
            for t, first, n in zip(b.text, b.first, b.size, strict=True):
                out[int(t)] |= set(range(first, first + n))
    assert whole == cut == {i: set(range(max(0, len(x) - 199))) for i, x in enumerate(data)}


def test_repeats_without_rows_and_with_equal_keys(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    same = "xy" * 150
    df = spark.createDataFrame([(1, same), (1, same), (1, "other"), (None, "z" * 10)], DOCS)
    assert sorted((r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(df).collect()) == [(5, 0), (10, 0), (300, 300), (300, 300)]


@pytest.mark.parametrize("kind", ["string", "long"])
def test_repeats_know_rows_by_place_where_keys_dont(spark, kind):
    texts = [*repeated_texts(8)[:20], None, "", "tail " * 90, "tail " * 90]
    keys = [None if i % 5 == 0 else i % 7 for i in range(len(texts))]
    df = spark.createDataFrame([(None if k is None else str(k) if kind == "string" else k, t, i, b"x") for i, (k, t) in enumerate(zip(keys, texts, strict=True))], f"doc_id {kind}, text string, row int, kept binary")
    got = repeats.remove_repeats(df).collect()
    assert {r["row"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got} == brute_repeats(texts)
    assert len(got) == len(texts) and all(r["doc_id"] == (None if keys[r["row"]] is None else (str if kind == "string" else int)(keys[r["row"]])) for r in got)


@pytest.mark.parametrize("weak", ["anchors", "all"])
def test_repeats_when_hashes_collide(spark, monkeypatch, weak):
    """Only digests and ranks decide: with hashes of a few values the result is the same."""
    mix = repeats._mix
    monkeypatch.setattr(repeats, "_mix", lambda x: mix(x) & np.uint64(0xFF << 40) if weak == "anchors" else x & np.uint64(0))
    texts = repeated_texts(12)[30:]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == brute_repeats(texts)


@pytest.mark.parametrize("threshold", [16, 33, 100])
def test_repeats_at_other_thresholds(spark, threshold):
    texts = repeated_texts(5)[20:70]
    got = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), DOCS), threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == brute_repeats(texts, threshold)


def test_doubling_finds_equal_positions(spark):
    """Runs of one core, of cores that differ in one byte, and of cores with a piece of their own."""
    rng = random.Random(9)
    core = bytes(rng.choices(b"abcd", k=193))
    runs, texts = [], []
    for i in range(40):
        c = bytearray(core)
        if i % 4 == 1:
            c[rng.randrange(193)] = ord("x")
        lead = rng.randint(0, 7)
        size = rng.randint(1, lead + 1)
        data = bytes(rng.choices(b"ab", k=lead)) + bytes(c) + bytes(rng.choices(b"ab", k=size - 1 + 200 - lead - 193))
        runs.append((i, 1000 * i, size, lead, bytearray(data)))
        texts += [(i, 1000 * i + t, data[t : t + 200]) for t in range(size)]
    seen = collections.Counter(x[2] for x in texts)
    got = repeats.doubled(spark.createDataFrame(runs, "uid long, first int, size int, lead int, bytes binary"))
    assert sorted(map(tuple, got.collect())) == sorted(x[:2] for x in texts if seen[x[2]] > 1)
