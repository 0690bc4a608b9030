"""Static binary-fuse filters: about nine bits a key, no false negatives, one in 256 false positives.

A set of keys is dealt to buckets by their value; each bucket's filter is built once, by one
task, and never changes. The filters of a set travel together only up to a checked size.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys a bucket holds on average.
BUCKET = 1 << 16
#: A broadcast set of filters has this many bytes at most.
BROADCAST_BYTES = 64 << 20
_HEAD = struct.Struct("<QII")


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(h: np.ndarray, width: int, segments: int) -> np.ndarray:
    mask = np.uint64(width - 1)
    first = ((h >> np.uint64(32)) * np.uint64(width * segments)) >> np.uint64(32)
    second = (first + np.uint64(width)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * width)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of some 64-bit keys; repeats count once."""
    keys = np.unique(np.asarray(keys).astype(np.int64).view(np.uint64))
    n = len(keys)
    if n == 0:
        return b""
    width = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / width) - 2) if n > 1 else 1
    size = (segments + 2) * width
    for attempt in range(1, 1000):
        seed = attempt * 0x9E3779B97F4A7C15 % 2**64
        h = _mix(keys, seed)
        slots = _slots(h, width, segments)
        if (order := _peel(slots, n, size)) is not None:
            table, prints = np.zeros(size, np.uint8), _prints(h)
            for ids, at in reversed(order):
                table[at] = 0
                table[at] = prints[ids] ^ table[slots[0, ids]] ^ table[slots[1, ids]] ^ table[slots[2, ids]]
            return _HEAD.pack(seed, width, segments) + table.tobytes()
        if attempt % 20 == 0:
            segments += 1 + segments // 8
            size = (segments + 2) * width
    raise ArithmeticError("no seed gives a filter")


def _peel(slots: np.ndarray, n: int, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, the slot each owns); None if some keys can't be freed."""
    ids = np.arange(n, dtype=np.int64)
    count = np.bincount(slots.ravel(), minlength=size)
    total = np.zeros(size, np.int64)
    for row in slots:
        np.add.at(total, row, ids)
    order, left, front = [], n, np.flatnonzero(count == 1)
    while len(front):
        free, where = np.unique(total[front], return_index=True)
        order.append((free, front[where]))
        left -= len(free)
        touched = slots[:, free].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.tile(free, 3))
        touched = np.unique(touched)
        front = touched[count[touched] == 1]
    return order if left == 0 else None


def contains(filter_: bytes, keys: np.ndarray) -> np.ndarray:
    """For each 64-bit key: False if it is surely not in the set."""
    if not filter_:
        return np.zeros(len(keys), bool)
    seed, width, segments = _HEAD.unpack_from(filter_)
    table = np.frombuffer(filter_, np.uint8, offset=_HEAD.size)
    h = _mix(np.asarray(keys).astype(np.int64).view(np.uint64), seed)
    a, b, c = _slots(h, width, segments)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)


def buckets_for(n: int) -> int:
    return max(1, -(-n // BUCKET))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """As pmod(key, buckets) in Spark."""
    return np.mod(np.asarray(keys).astype(np.int64), buckets)


def build_filters(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """(bucket int, filter binary): one static filter for each bucket of the long column ``key``.

    A bucket has BUCKET keys on average, as ``buckets`` follows the number of keys.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "filter": [build(pdf["key"].to_numpy())]})

    dealt = keys.select(F.col(key).alias("key"), F.pmod(F.col(key), F.lit(buckets)).cast("int").alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(one, "bucket int, filter binary")


class FilterSet:
    """All filters of a set, small enough to go to every task."""

    def __init__(self, buckets: int, filters: dict[int, bytes]):
        self.buckets, self.filters = buckets, filters

    def contains(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.int64)
        if self.buckets == 1:
            return contains(self.filters.get(0, b""), keys)
        out, at = np.zeros(len(keys), bool), bucket_of(keys, self.buckets)
        order = np.argsort(at, kind="stable")
        edges = np.flatnonzero(np.diff(at[order])) + 1
        for part in np.split(order, edges) if len(order) else []:
            out[part] = contains(self.filters.get(int(at[part[0]]), b""), keys[part])
        return out


def fits(n: int) -> bool:
    """Whether the filters of n keys may be broadcast."""
    return n * 1.25 + 64 * buckets_for(n) <= BROADCAST_BYTES


def broadcast_filters(keys: DataFrame, key: str, n: int):
    """A broadcast FilterSet of n keys; the caller has asked fits(n)."""
    buckets = buckets_for(n)
    rows = build_filters(keys, key, buckets).toLocalIterator()
    return keys.sparkSession.sparkContext.broadcast(FilterSet(buckets, {r["bucket"]: bytes(r["filter"]) for r in rows}))
