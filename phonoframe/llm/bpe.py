"""Byte-level byte-pair encoding inside Spark tasks: counts, ids and texts.

Two encoders that agree with each other: a heap over a linked list of symbols, which only counts,
and a backtracking one over the longest tokens that an Aho-Corasick automaton finds, which gives
ids. Both work on pre-tokens and remember what they have done for pieces between single spaces,
in a memory of bounded size for each worker process.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import over_texts, whole

#: Pieces that a worker process remembers, and the longest of them in characters.
MEMORY, MEMORY_CHARS = 150_000, 48
#: A vocabulary file has this many bytes at most, as it goes to every task.
VOCABULARY_BYTES = 16 << 20
#: How byte-level vocabularies cut a text before merging (a fixed value of theirs).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A single space between two other characters always begins a pre-token.
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Between words a single space or line feed, which is a pre-token or begins one.
_SPACED = re.compile(r"[ \n]?[^ \n]+")


def byte_letters() -> dict[str, int]:
    """The printable character by which vocabulary files write each byte."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level(source: bytes) -> dict:
    """What a tokenizers .json file of a byte-level BPE vocabulary says; others are refused."""
    spec = json.loads(source)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("only byte-level BPE without a normalizer is supported")
    return spec


class Vocabulary:
    """A byte-level BPE vocabulary as a tokenizers .json file describes it."""

    def __init__(self, source: bytes):
        spec = byte_level(source)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        ids = model["vocab"]
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for t, i in ids.items():
            if t not in self.special:
                self.token[i] = to_bytes(t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.length = [len(t) for t in self.token]
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        #: (left id, right id) -> (rank, id of the merged token); id -> its own pair, rank
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = [-1] * self.size
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pair, merged = (ids[left], ids[right]), ids[left + right]
            self.merge[pair] = (rank, merged)
            self.parts.setdefault(merged, pair)
            if self.rank[merged] < 0:
                self.rank[merged] = rank
        self.pre_token = regex.compile(PRE_TOKEN)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._known: dict[tuple[int, int], bool] = {}
        self._automaton = None
        self._counts, self._ids = Remembered(lambda p: self.count_pre_token(p.encode()), MEMORY // 2), Remembered(lambda p: self.encode_pre_token(p.encode()), MEMORY // 2)

    # -- counting: a heap of adjacent pairs over a linked list of symbols

    def count_pre_token(self, data: bytes) -> int:
        """Tokens of one pre-token: its bytes less the merges made, lowest rank first, leftmost of equals."""
        n = len(data)
        if n < 2:
            return n
        symbol = [self.byte_id[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merge = self.merge
        heap = []
        for i in range(n - 1):
            if found := merge.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, found[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if found := merge.get((new, symbol[k])):
                    heapq.heappush(heap, (found[0], i, found[1], new, symbol[k]))
            h = before[i]
            if h >= 0 and (found := merge.get((symbol[h], new))):
                heapq.heappush(heap, (found[0], h, found[1], symbol[h], new))
        return n - merges

    # -- encoding: longest tokens, a table of pairs that may stand together, and steps back

    @property
    def automaton(self):
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            special = set(self.special.values())
            for i, t in enumerate(self.token):
                if len(t) > 1 and i not in special:  # single bytes are tokens everywhere
                    self._automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
            self._automaton.make_automaton()
        return self._automaton

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging would ever leave these two tokens side by side.

        Their common boundary is undone backwards: both are taken apart, the later merge first. If two of the
        parts that meet there would have merged earlier than one of them was made, they can't.
        """
        known = self._known.get((left, right))
        if known is None:
            if len(self._known) > 2 * MEMORY:
                self._known.clear()
            known = self._known[left, right] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        rank, merge, parts = self.rank, self.merge, self.parts
        top = len(merge)  # below this rank a merge of the two would have come first
        while True:
            found = merge.get((left, right))
            if found and found[0] < top:
                return False
            # undo whichever was made last; of equal ones the right, as merging goes from the left
            if rank[left] > rank[right]:
                top, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                top, right = rank[right] + 1, parts[right][0]
            else:
                return True

    @functools.cached_property
    def shorter(self) -> list[int]:
        """Of each token the longest other token that it begins with; -1 for single bytes."""
        special = set(self.special.values())
        known = {t: i for i, t in enumerate(self.token) if t and i not in special}
        return [-1 if i in special else next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1) for i, t in enumerate(self.token)]

    def encode_pre_token(self, data: bytes) -> list[int]:
        """The longest token at each place is kept, and the next shorter ones follow from it, so that memory follows the length."""
        n = len(data)
        token_at = [self.byte_id[b] for b in data]
        if n == 1:
            return token_at
        for end, (less, token) in self.automaton.iter(data.decode("latin-1")):
            token_at[end - less] = token  # a later end is that of a longer token
        size, shorter, known = self.length, self.shorter, self._known
        out: list[int] = []
        dead = bytearray(n + 1)
        at, last, token = 0, -1, token_at[0]
        while True:
            while token >= 0:
                if not dead[at + size[token]]:
                    fits = last < 0 or known.get((last, token))
                    if fits or (fits is None and self.may_follow(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
                last, token = token, token_at[at]
            else:
                dead[at] = 1
                taken = out.pop()
                at -= size[taken]
                last, token = out[-1] if out else -1, shorter[taken]

    # -- whole texts

    def pieces(self, text: str) -> list[str]:
        """Parts whose tokens, in a row, are those of the text; special strings stand alone."""
        if self.special_cut and any(s in text for s in self.special):
            return [q for part in self.special_cut.split(text) if part for q in ([part] if part in self.special else self._plain(part))]
        return self._plain(text) if text else []

    @staticmethod
    def _plain(text: str) -> list[str]:
        if " ".join(text.split()) != text.replace("\n", " "):  # white space in runs, at an end or of other kinds
            first, *rest = _PLAIN_SPACE.split(text)
            return [first, *(" " + p for p in rest)]
        return _SPACED.findall(text)

    def count(self, piece: str) -> int:
        if piece in self.special:
            return 1
        return sum(self._counts.all(self.pre_token.findall(piece)))

    def encode(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [i for ids in self._ids.all(self.pre_token.findall(piece)) for i in ids]

    # -- decoding: where each token's bytes lie in one string

    def offsets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all tokens' bytes, start of each, length of each)."""
        size = np.array([len(t) for t in self.token])
        return np.frombuffer(b"".join(self.token), np.uint8), np.cumsum(size) - size, size


class Remembered(dict):
    """piece -> what a function makes of it; kept for short pieces, up to twice MEMORY of them.

    When it is full it becomes the older half and a new one begins; what is asked for again comes over.
    """

    def __init__(self, of: Callable[[str], object], most: int = MEMORY):
        super().__init__()
        self.of, self.most, self.older = of, most, {}

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.of(piece)
        if len(piece) <= MEMORY_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = value
        return value

    def all(self, pieces: list[str]) -> list:
        return list(map(self.__getitem__, pieces))


_LOADED: dict[str, dict[tuple[str, ...], object]] = {}


def once(name: tuple[str, ...], make: Callable[[], object]):
    """What ``make`` gives, made once in a worker process; a name is (operator, what).

    What another operator has left goes, so that a worker that is used again holds the memory of one operator.
    """
    held = _LOADED.get(name[0])
    if held is None:
        _LOADED.clear()
        held = _LOADED[name[0]] = {}
    if name[1:] not in held:
        held[name[1:]] = make()
    return held[name[1:]]


def vocabulary_source(path: str) -> bytes:
    with open(path, "rb") as f:
        source = f.read(VOCABULARY_BYTES + 1)
    if len(source) > VOCABULARY_BYTES:
        raise ValueError(f"{path}: a vocabulary has at most {VOCABULARY_BYTES} bytes")
    return source


def shared_vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read on the driver and broadcast; its size is checked."""
    return df.sparkSession.sparkContext.broadcast((path, vocabulary_source(path)))


def vocabulary(shared, operator: str) -> Vocabulary:
    path, source = shared.value
    return once((operator, "vocabulary", path), lambda: Vocabulary(source))


def token_counts(docs: DataFrame, path: str, text: str = "text") -> Column:
    """The number of tokens of each whole text; none for a null or empty one."""
    shared = shared_vocabulary(docs, path)

    def start():
        v = vocabulary(shared, "counts")
        held = once(("counts", "held", shared.value[0]), lambda: Remembered(v.count))
        return lambda texts: [sum(held.all(v.pieces(t))) for t in texts]

    return over_texts("long", start)(whole(text))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row; no identifiers are made.

    Special strings in a text are one token each, as is the library's default. Null counts as
    empty: no bytes, no tokens. Rows that repeat give one row each; other columns are ignored.
    """
    counted = docs.select(F.col(key), F.octet_length(whole(text)).cast("long").alias("n_bytes"), token_counts(docs, path, text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _id_bytes(v: Vocabulary) -> Callable[[str], bytes]:
    return lambda piece: array("I", v.encode(piece)).tobytes()


def encoded_and_decoded(docs: DataFrame, path: str, text: str = "text") -> Column:
    """A struct of each whole text's ids, as little-endian unsigned 32-bit integers, and of the text that these ids give again."""
    shared = shared_vocabulary(docs, path)

    def start():
        v = vocabulary(shared, "ids")
        held = once(("ids", "held", shared.value[0]), lambda: Remembered(_id_bytes(v)))
        offsets = once(("ids", "offsets", shared.value[0]), v.offsets)

        def both(text: str) -> tuple[bytes, str]:
            ids = b"".join(held.all(v.pieces(text)))
            return ids, decoded(ids, *offsets)

        return lambda texts: list(map(both, texts))

    return over_texts("ids binary, decoded string", start)(whole(text))


def decode_ids(docs: DataFrame, path: str, ids: Column) -> Column:
    """The text of each row's ids (binary); bytes that aren't UTF-8 become U+FFFD."""
    shared = shared_vocabulary(docs, path)

    @F.pandas_udf("string")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        offsets = once(("decoding", shared.value[0]), lambda: Vocabulary(shared.value[1]).offsets())
        for rows in parts:
            yield pd.Series([None if r is None else decoded(r, *offsets) for r in rows], dtype=object)

    return of(ids)


def decoded(ids: bytes, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> str:
    return _bytes_of(np.frombuffer(ids, "<u4"), data, start, size).decode("utf-8", "replace")


def _bytes_of(ids: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The tokens' bytes in a row, by the offset table alone."""
    n = size[ids]
    ends = np.cumsum(n)
    if not len(ids):
        return b""
    return data[np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded string) for every row; null counts as empty."""
    return docs.select(F.col(key), encoded_and_decoded(docs, path, text).alias("x")).select(key, "x.ids", "x.decoded")
