"""Byte-level encoding against the tiktoken library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from phonoframe.llm import bpe, byte_level, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["'", "s", "re", "ll", "ve", "'t", " ", "  ", "\n", "\t", "a", "b1", "1", "½", "!", "?", "''", "é", "中", "\u3000", "\xa0", "\u200b", "😀", "\x1c", "don", "'D", "\u2003", "٣", "ǅ", "ºª", "Ⅷ", "\u0558", "\U00011de0", "<|endoftext|>", "\x00"]


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return byte_level.Ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


@pytest.fixture(scope="module")
def table():
    return np.frombuffer(byte_level.code_point_classes(), np.uint8)


def encoded(texts, table, ranks):
    return [np.frombuffer(i, "<u4").tolist() for i in byte_level.encoded_all(texts, table, bpe.Remembered(ranks.packed))]


def test_odd_texts(ranks, library, table):
    r = random.Random(7)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 80))) for _ in range(8000)] + ["", " ", "'", "'r", "'re", " a", "  a", "a ", "\n a"]
    assert encoded(texts, table, ranks) == [library.encode_ordinary(t) for t in texts]
    assert encoded([], table, ranks) == []
    assert encoded(["", "", ""], table, ranks) == [[], [], []]


def test_classes_are_the_librarys(table):
    """Code points around which versions of Unicode differ, and a part of all others: is each in one pre-token with the mark before it?"""
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and (c < 0x3500 or c % 37 == 0)]
    for mark, kind in (("a", byte_level.LETTER), ("1", byte_level.NUMBER), ("!", byte_level.OTHER)):
        ranks = {bytes([b]): b for b in range(256)} | {mark.encode() + bytes([b]): 256 + b for b in range(256)}
        asked = tiktoken.Encoding("asked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        wrong = [hex(c) for c in points if (asked.encode_ordinary(mark + chr(c))[0] >= 256) != (table[c] == kind)]
        assert wrong == []


def test_scan_equals_one_step_after_another(table):
    r = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 4096, 4097, 300_000):
        kind = r.integers(0, 9, n).astype(np.uint8)
        state, expected = byte_level.ENDED, []
        for k in kind.tolist():
            expected.append(byte_level.BEGINS[k, state])
            state = byte_level.STEP[k, state]
        assert byte_level.boundaries(kind).tolist() == expected


def test_long_pre_tokens(ranks, library):
    r = random.Random(3)
    for piece in (b"a" * 5000, b"ab" * 3000, bytes(r.choices(b"abcde", k=4000)), bytes(r.choices(b"etaoinshrdlu", k=20_000)), b"=" * 999):
        for n in (len(piece), 63, 64, 65):
            assert ranks.merged(piece[:n]) == library.encode_ordinary(piece[:n].decode())


def test_megabytes_in_one_pre_token(ranks, table):
    """Time and memory follow the length; what tiktoken refuses, white space in the hundreds of thousands, is encoded too."""
    text = "a" * 2_000_000 + " " * 500_000 + "b"
    ids = byte_level.encoded_all([text], table, bpe.Remembered(ranks.packed))[0]
    assert ranks.decoded(ids, ranks.ends_of(ids)) == text.encode()


def test_query_and_offsets(spark, ranks, library, tmp_path):
    rows = [(1, None, "x"), (2, "", "x"), (3, "it's  <|endoftext|>\n\n 12", "x"), (3, "it's  <|endoftext|>\n\n 12", "x"), (4, "é中😀" * 30_000, "x"), (None, " a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = byte_level.round_trip(docs, PATH)
    for (key, text, _), row in zip(sorted(rows, key=str), sorted(done.collect(), key=lambda r: str((r["doc_id"], bytes(r["decoded"]).decode() or None))), strict=True):
        ids = library.encode_ordinary(text or "")
        assert (row["doc_id"], np.frombuffer(row["ids"], "<u4").tolist(), bytes(row["decoded"])) == (key, ids, (text or "").encode())
        ends = np.frombuffer(row["ends"], "<u4").tolist()
        assert all(ranks.data[ranks.start[i] : ranks.start[i] + ranks.size[i]].tobytes() == (text or "").encode()[a:b] for i, a, b in zip(ids, [0, *ends], ends))
    again = done.select("doc_id", byte_level.decode_ids(done, PATH).alias("again"), "decoded")
    assert again.filter(F.col("again") != F.col("decoded")).count() == 0
    assert byte_level.round_trip(docs.limit(0), PATH).count() == 0
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op12_byte_level_bpe(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(k, len(i := library.encode_ordinary(t or "")), sha(np.array(i, "<u4").tobytes()), sha((t or "").encode())) for k, t, _ in rows}
    with pytest.raises(ValueError, match="one pattern"):
        byte_level.round_trip(docs, PATH, pattern="x")
