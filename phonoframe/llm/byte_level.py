"""Byte-level byte-pair encoding with pre-tokens found by arrays, and decoding by offsets.

The code points of a batch of texts become classes. Each class is a function from the state of a small automaton to its
next state; such functions compose associatively, so that the states at all code points come from a scan over blocks and
blocks of blocks, column by column, with no regular expression and no loop over code points. The slices between the
boundaries are merged by the ranks of a vocabulary and remembered.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import over_texts, whole

#: Classes of code points; the last ones depend on what follows, see ``classes_of``.
LETTER, NUMBER, SPACE, OTHER, LAST_SPACE, LAST_BLANK, SHORT, LONG, END = range(9)
#: States: in letters, numbers, others, white space; after a blank that begins a pre-token; after a pre-token that has ended; one and two letters before a contraction ends.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, BLANK, ENDED, ONE_LEFT, TWO_LEFT = range(8)
# What stands after an apostrophe in a contraction.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Functions that are composed in a row.
BLOCK = 64


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(class, state) -> next state, and whether a pre-token begins there."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for kind, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[kind] = inside
        begins[kind, [inside, BLANK]] = False
    step[LETTER, ONE_LEFT], step[LETTER, TWO_LEFT] = ENDED, ONE_LEFT
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    for kind, left in ((SHORT, ONE_LEFT), (LONG, TWO_LEFT)):  # an apostrophe begins a contraction only where a pre-token begins
        step[kind] = left
        step[kind, [IN_OTHERS, BLANK]] = IN_OTHERS
        begins[kind, [IN_OTHERS, BLANK]] = False
    step[SPACE] = IN_SPACES
    begins[SPACE, IN_SPACES] = False
    step[LAST_SPACE], step[LAST_BLANK], step[END] = ENDED, BLANK, ENDED
    return step, begins


STEP, BEGINS = automaton()


@functools.cache
def code_point_classes() -> bytes:
    """The class of each code point as tiktoken sees it: LETTER, NUMBER, SPACE or OTHER.

    Python, ``regex`` and tiktoken know different versions of Unicode, so that what Python doesn't know and ``regex`` takes
    for a letter or number is asked of tiktoken: after "a" or "1" it is in one pre-token with that or it isn't.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    kinds, unknown = {"L": LETTER, "N": NUMBER}, []
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        if kind[0] in kinds:
            table[c] = kinds[kind[0]]
        elif kind == "Cn":
            unknown.append(c)
        elif kind[0] == "Z" or c in range(9, 14) or c == 0x85:
            table[c] = SPACE
    chars = "".join(map(chr, unknown))
    for mark, pattern, kind in ((b"a", r"\p{L}", LETTER), (b"1", r"\p{N}", NUMBER)):
        asked = regex.findall(pattern, chars)
        ranks = {bytes([b]): b for b in range(256)} | {mark + bytes([b]): 256 + b for b in range(256)}
        library = tiktoken.Encoding("classes", pat_str=bpe.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        for c in asked:
            if library.encode_ordinary(mark.decode() + c)[0] >= 256:
                table[ord(c)] = kind
    return table.tobytes()


def classes_of(points: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each place of ``points``; at ``ends`` a text ends."""
    kind = table[points]
    kind[ends] = END
    solid = np.zeros(len(kind) + 1, bool)  # what isn't white space; the end of a text isn't either
    solid[:-1] = (kind != SPACE) & (kind != END)
    before_solid = (kind == SPACE) & solid[1:]
    ahead = np.zeros(len(points) + 2, points.dtype)
    ahead[:-2] = points
    ahead[ends] = 0
    for mark in np.flatnonzero(points == ord("'")):
        one, two = ahead[mark + 1], ahead[mark + 2]
        if one < 128 and chr(one) in CONTRACTIONS:
            kind[mark] = SHORT
        elif one < 128 and two < 128 and chr(one) + chr(two) in CONTRACTIONS:
            kind[mark] = LONG
    kind[before_solid] = np.where(points[before_solid] == ord(" "), LAST_BLANK, LAST_SPACE)
    return kind


def composed(functions: np.ndarray, first: int) -> np.ndarray:
    """The state before each of a row of functions (one table of states each) if the row begins in ``first``."""
    n, states = functions.shape
    if n <= BLOCK:
        out = np.empty(n, np.uint8)
        for i, f in enumerate(functions.tolist()):
            out[i] = first
            first = f[first]
        return out
    padded = np.concatenate([functions, np.tile(np.arange(states, dtype=np.uint8), (-n % BLOCK, 1))]).reshape(-1, BLOCK, states)
    whole = padded[:, 0]
    for i in range(1, BLOCK):
        whole = np.take_along_axis(padded[:, i], whole, 1)
    state, rows = composed(whole, first), np.arange(len(padded))
    out = np.empty((len(padded), BLOCK), np.uint8)
    for i in range(BLOCK):
        out[:, i] = state
        state = padded[rows, i, state]
    return out.reshape(-1)[:n]


def boundaries(kind: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each place; the end of a text is a pre-token of its own."""
    n = len(kind)
    blocks = np.concatenate([kind, np.full(-n % BLOCK, END, np.uint8)]).reshape(-1, BLOCK)
    states = STEP.shape[1]
    flat = STEP.reshape(-1)
    whole = STEP[blocks[:, 0]]
    for i in range(1, BLOCK):
        whole = flat[blocks[:, i, None] * np.uint8(states) + whole]
    state = composed(whole, ENDED)
    out = np.empty(blocks.shape, bool)
    begins = BEGINS.reshape(-1)
    for i in range(BLOCK):
        at = blocks[:, i] * np.uint8(states) + state
        out[:, i], state = begins[at], flat[at]
    return out.reshape(-1)[:n]


def slices_of(texts: list[str], table: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes, each text with one byte at its end; where pre-tokens begin; which of them are ends of texts."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    first = np.flatnonzero(boundaries(classes_of(points, ends, table)))
    width = np.ones(len(points), np.uint8)
    for more in (0x80, 0x800, 0x10000):
        width += points >= more
    at = np.cumsum(width, dtype=np.int64) - width
    return joined.encode(), at[first], np.searchsorted(first, ends)


class Ranks:
    """A byte-level vocabulary in tiktoken's format: lines of a token in base64 and its rank, which is its id."""

    def __init__(self, source: bytes):
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, source.splitlines())}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.longest = max(map(len, self.rank))
        n = max(self.rank.values()) + 1
        token = [b""] * n
        for t, r in self.rank.items():
            token[r] = t
        #: The offset table: all tokens' bytes, where each begins, how long it is.
        self.size = np.array([len(t) for t in token])
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(token), np.uint8)

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: adjacent parts are joined, those whose union has the least rank first, leftmost of equals."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n, rank, longest = len(piece), self.rank, self.longest
        if n < 64:
            return self._merged_short(piece)
        after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
        pair = array("q", (rank.get(piece[i : i + 2], -1) for i in range(n)))  # the rank of the union of the parts at i and after it
        pair[n - 1] = -1
        ranks = np.frombuffer(pair, np.int64)
        some = np.flatnonzero(ranks >= 0)
        first = np.sort((ranks[some] << 40) | some)  # the pairs of bytes in order; pairs of larger parts are in the heap
        del ranks
        new: list[int] = []
        k = 0
        while k < len(first) or new:
            if new and (k >= len(first) or new[0] < first[k]):
                found = heapq.heappop(new)
            else:
                found = int(first[k])
                k += 1
            r, i = found >> 40, found & ((1 << 40) - 1)
            if pair[i] != r:
                continue  # a neighbour has been joined meanwhile
            j = after[i]
            pair[j] = -1
            end = after[i] = after[j]
            if end <= n:
                before[end] = i
            for p in (before[i], i):
                if p >= 0:
                    q = after[after[p]] if after[p] < n else n + 1
                    size = q - p
                    pair[p] = rank.get(piece[p:q], -1) if q <= n and size <= longest else -1
                    if pair[p] >= 0:
                        heapq.heappush(new, (pair[p] << 40) | p)
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : after[i]]])
            i = after[i]
        return out

    def _merged_short(self, piece: bytes) -> list[int]:
        rank, ends = self.rank, list(range(len(piece) + 1))
        pairs = [rank.get(piece[i : i + 2], 1 << 40) for i in range(len(piece) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 40:
                break
            i = pairs.index(least)
            del ends[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank.get(piece[ends[i] : ends[i + 2]], 1 << 40)
            if i:
                pairs[i - 1] = rank.get(piece[ends[i - 1] : ends[i + 1]], 1 << 40)
        return [rank[piece[a:b]] for a, b in pairwise(ends)]

    def packed(self, piece: bytes) -> bytes:
        return array("I", self.merged(piece)).tobytes()

    def ends_of(self, ids: bytes) -> np.ndarray:
        """Where each token of a text ends in its bytes."""
        return np.cumsum(self.size[np.frombuffer(ids, "<u4")])

    def decoded(self, ids: bytes, ends: np.ndarray) -> bytes:
        """The bytes of the ids, each token's at its place."""
        ids = np.frombuffer(ids, "<u4")
        if not len(ids):
            return b""
        n = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def encoded_all(texts: list[str], table: np.ndarray, held: bpe.Remembered) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    if not texts:
        return []
    data, at, ends = slices_of(texts, table)
    at = at.tolist()
    out, begin = [], 0
    for end in ends.tolist():
        out.append(b"".join(held.all([data[a:b] for a, b in pairwise(at[begin : end + 1])])))
        begin = end + 1
    return out


def encoded_and_decoded(docs: DataFrame, path: str, text: str = "text", pattern: str = bpe.PRE_TOKEN) -> Column:
    """A struct of each whole text: ids (little-endian unsigned 32-bit), ends (where each token ends in the text's bytes, the
    same way), and the bytes that these two give again."""
    if pattern != bpe.PRE_TOKEN:
        raise ValueError("the automaton is made for one pattern")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((path, bpe.vocabulary_source(path), code_point_classes()))

    def start():
        ranks = bpe.once(("byte level", "ranks", shared.value[0]), lambda: Ranks(shared.value[1]))
        held = bpe.once(("byte level", "held", shared.value[0]), lambda: bpe.Remembered(ranks.packed))
        table = np.frombuffer(shared.value[2], np.uint8)

        def work(texts: list[str]) -> list[dict]:
            out = []
            for ids in encoded_all(texts, table, held):
                ends = ranks.ends_of(ids)
                out.append({"ids": ids, "ends": ends.astype("<u4").tobytes(), "decoded": ranks.decoded(ids, ends)})
            return out

        return work

    return over_texts("ids binary, ends binary, decoded binary", start)(whole(text))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = bpe.PRE_TOKEN) -> DataFrame:
    """(key, ids binary, ends binary, decoded binary) for every row, special strings as ordinary text.

    Null counts as empty, which has no ids. Rows that repeat give one row each; other columns are ignored. A pre-token may
    be as long as its text.
    """
    return docs.select(F.col(key), encoded_and_decoded(docs, path, text, pattern).alias("x")).select(key, "x.ids", "x.ends", "x.decoded")


def decode_ids(docs: DataFrame, path: str, ids: str = "ids") -> Column:
    """The bytes of each row's ids; null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast((path, bpe.vocabulary_source(path)))

    @F.arrow_udf("binary")
    def of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ranks = bpe.once(("byte level decoding", shared.value[0]), lambda: Ranks(shared.value[1]))
        for rows in parts:
            yield pa.array([None if r is None else ranks.decoded(r, ranks.ends_of(r)) for r in rows.to_pylist()], pa.binary())

    return of(F.col(ids))
