import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from phonoframe.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
PARTS = ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'ll", "é", "ß", "中", "😀", "1", "23", "!", "--", "<|endoftext|>", "<|endo", "\t", "\xa0", "the", "ing", "\x1c", "\r\n", "́", " x", " I'm", "aaaa", "\x85", "​"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "ab" * 2000, " " * 60, "\n" * 9, "x y " * 4000]


def test_packing_encoder_is_the_library(library):
    encoder = packing.Encoder(bpe.vocabulary_source(PATH))
    rng = random.Random(4)
    long_white = [" " * 1_000_000 + "x", "y" + "\n \t" * 300_000 + "z <|endoftext|>", "\u3000" * 700_000]
    for text in odd(3000, 5) + ["".join(rng.choices("ab<|endoftext|> ", k=200)) for _ in range(200)] + ["ab" * 200_000, *long_white]:
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.ids("").dtype == np.dtype("<u4")


def test_packing_refuses_ids_out_of_order():
    spec = json.loads(bpe.vocabulary_source(PATH))
    spec["model"]["merges"][10], spec["model"]["merges"][20] = spec["model"]["merges"][20], spec["model"]["merges"][10]
    with pytest.raises(ValueError, match="order"):
        packing.Encoder(json.dumps(spec).encode())


def test_packing_leaves_tokens_that_no_merge_makes_to_the_library():
    spec = json.loads(bpe.vocabulary_source(PATH))
    spec["model"]["vocab"]["qzqzqz"] = max(spec["model"]["vocab"].values()) + 1
    source = json.dumps(spec)
    encoder, own = packing.Encoder(source.encode()), Tokenizer.from_str(source)
    for text in ("qzqzqz", "a qzqzqz, qzqzqzqzqz", *odd(50)):
        assert encoder.ids(text).tolist() == own.encode(text, add_special_tokens=False).ids


def test_a_worker_holds_one_operators_memory(monkeypatch):
    monkeypatch.setattr(bpe, "_LOADED", {})
    a = bpe.once(("counts", "held"), dict)
    assert bpe.once(("counts", "held"), dict) is a and bpe.once(("counts", "more"), list) == []
    bpe.once(("ids", "held"), dict)
    assert list(bpe._LOADED) == ["ids"] and bpe.once(("counts", "held"), dict) is not a


def test_both_encoders_are_the_library(library):
    v = bpe.Vocabulary(bpe.vocabulary_source(PATH))
    offsets = v.offsets()
    for text in odd(3000):
        want = library.encode(text, add_special_tokens=False).ids
        pieces = v.pieces(text)
        assert [i for p in pieces for i in v.encode(p)] == want
        assert sum(map(v.count, pieces)) == len(want)
        assert bpe.decoded(np.array(want, "<u4").tobytes(), *offsets) == library.decode(want, skip_special_tokens=False) == text


def test_memory_is_bounded():
    r = bpe.Remembered(len, 10)
    for i in range(1000):
        assert r[f"{i % 37}"] == len(f"{i % 37}")
        assert len(r) <= 10 and len(r.older) <= 10
    assert r["x" * 1000] == 1000 and "x" * 1000 not in r


def test_count_and_round_trip(spark, library):
    texts = [None, *odd()]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], f"{DOCS}, n_tokens int")
    counted = {r["doc_id"]: tuple(r)[1:] for r in bpe.count_tokens(df, PATH).collect()}
    trip = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in bpe.round_trip(df, PATH).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert counted[i] == (len((t or "").encode()), len(want), len(want) > 512)
        assert trip[i] == (np.array(want, "<u4").tobytes(), t or "")
    again = spark.createDataFrame([(1, trip[5][0]), (2, None)], "k int, ids binary")
    assert [r[0] for r in again.select(bpe.decode_ids(again, PATH, again["ids"])).collect()] == [texts[5], None]
    assert bpe.count_tokens(df.limit(0), PATH).count() == bpe.round_trip(df.limit(0), PATH).count() == packing.pack_documents(df.limit(0), PATH).count() == 0


def test_vocabulary_files_have_a_bound(monkeypatch):
    monkeypatch.setattr(bpe, "VOCABULARY_BYTES", 1000)
    with pytest.raises(ValueError, match="at most"):
        bpe.vocabulary_source(PATH)


def test_packing_of_documents(spark, library):
    rng = random.Random(2)
    texts = [None, "", *odd(100), *(" ".join(rng.choices(["alpha", "beta", "gamma", "x1"], k=rng.randint(1, 1500))) for _ in range(150)), "long one " * 9000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), PATH).collect()
    check_pack(got, {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}, 2)


def check_pack(got, ids, twice):
    by_sequence = {}
    for r in got:
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for k, p in pieces.items():
        p = sorted(set(p))
        assert [x[0] for x in p] == list(range(len(p)))
        assert [x[1] for x in p] == list(np.cumsum([0, *[x[2] for x in p]])[:-1]) and sum(x[2] for x in p) == len(ids[k])
        assert all(x[2] == 2048 for x in p[1:])
    total = sum(r["length"] for r in got)
    assert len(by_sequence) <= -(-total // 2048) + 1


def test_packing_in_many_blocks(spark):
    rng = random.Random(3)
    sizes = [rng.randint(300, 1100) for _ in range(600)]
    items = spark.createDataFrame([(i, s, "z") for i, s in enumerate(sizes)], "k int, length int, bins string")
    got = packing.pack(items, block_items=64).collect()
    assert sorted(r["k"] for r in got) == list(range(600))
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048
    assert len(fill) <= 1.06 * sum(sizes) / 2048
    assert packing.pack(items.limit(0)).count() == 0


def test_crossover_keeps_every_item():
    rng = np.random.default_rng(0)
    sizes = np.sort(rng.integers(100, 1500, 300))[::-1]
    population = packing.evolve(sizes, [], 2048, rng, 4, 40)
    first = packing.fitness(packing.evolve(sizes, [], 2048, np.random.default_rng(1), 1, 0)[0], sizes, 2048)
    for bins in population:
        assert len(bins) == 300 and np.bincount(bins, weights=sizes).max() <= 2048
    assert packing.fitness(population[0], sizes, 2048) <= first


def test_lost_tasks_are_done_again_alike(spark):
    items = spark.createDataFrame([(i, 200 + i * 37 % 900) for i in range(300)], "k int, length int")
    a, b = (hashlib.sha256(str(sorted(map(tuple, packing.pack(items, block_items=100).collect()))).encode()).hexdigest() for _ in range(2))
    assert a == b


def test_megabytes_in_one_pre_token():
    """Ten megabytes of one letter take memory for their length, and time that grows with it."""
    import resource
    import time

    v = bpe.Vocabulary(bpe.vocabulary_source(PATH))
    assert len(v.encode_pre_token(b"a" * 1000)) == v.count_pre_token(b"a" * 1000) == 250
    start = time.process_time()
    ids = v.encode_pre_token(b"a" * 1_000_000)
    once = time.process_time() - start
    assert set(ids) == {ids[0]} and len(ids) == 250_000
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    assert len(v.encode_pre_token(b"a" * 10_000_000)) == 2_500_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10
    assert time.process_time() - start < 40 * max(once, 0.2)
