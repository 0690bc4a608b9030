"""SimHash near-duplicates: pigeonhole blocks, Hamming checks, components of the links."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CUT_SETTINGS, cut, each_salt, over_texts, salt, salts_seen, settings, whole

#: Fingerprints of a block that one task compares with each other; larger blocks go by way of hubs.
BLOCK_ROWS = 4096
#: Close pairs that are held before they are merged.
PAIRS = 1 << 20


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the word shingles; A-Z lower-cased, words are split at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp long) for every row."""

    of = over_texts("long", lambda: lambda texts: np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))
    return docs.select(F.col(key), of(whole(text)).alias("fp"))


def cuts(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of so many blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def blocks_for(n: int, distance: int) -> int:
    """How many blocks to cut: keys of blocks - distance equal blocks leave few of n fingerprints together."""
    for blocks in range(distance + 2, 2 * distance + 8):
        if n >> (64 * (blocks - distance) // blocks) < 64:
            return blocks
    return 2 * distance + 8


def block_keys(fp: np.ndarray, distance: int, blocks: int) -> np.ndarray:
    """For each fingerprint one key for every choice of blocks - distance blocks.

    Two fingerprints that differ in up to ``distance`` bits are equal in all blocks of one choice.
    """
    parts, keys = cuts(blocks), []
    for c, chosen in enumerate(itertools.combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << parts[b][1]) - 1) << parts[b][0] for b in chosen)
        x = (fp & np.uint64(mask)) + np.uint64((c + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        keys.append(x ^ (x >> np.uint64(31)))
    return np.stack(keys, axis=1)


def _forest(fp: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of equal ``group`` (sorted): of every fingerprint to the least one it reaches there."""
    n = len(fp)
    low = np.arange(n)
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    end = last[np.searchsorted(last, low)]
    a, pairs, held = low, [], 0
    for d in range(1, n + 1):
        a = a[a + d <= end[a]]
        close = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= distance] if len(a) else a
        pairs.append((close, close + d))
        held += len(close)
        if held > PAIRS or not len(a):
            low = _lowest(low, *(np.concatenate(x) for x in zip(*pairs, strict=True)))
            pairs, held = [], 0
        if not len(a):
            break
    other = np.flatnonzero(low != np.arange(n))
    return other, low[other]


def _lowest(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each index reaches over the pairs (a, b) and what ``low`` holds."""
    held = np.flatnonzero(low != np.arange(len(low)))
    a, b = np.concatenate([a, held]), np.concatenate([b, low[held]])
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        for x in (a, b):
            np.minimum.at(low, low[x], m)
            np.minimum.at(low, x, m)
        low = low[low]
        if (low == before).all():
            return low


def links(distinct: DataFrame, distance: int, blocks: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a long, b long): links whose components are those of all pairs within ``distance``.

    Each fingerprint of ``distinct`` (fp) goes to one bucket for each of its block keys. A task reads its buckets in order and,
    instead of all close pairs, returns a link from each fingerprint to the least one that it
    reaches in its bucket. Buckets over ``block_rows`` hand back their rows, which then meet at
    hubs: two fingerprints are within d bits just if some number is within ceil(d/2) and floor(d/2)
    bits of them. That takes time in proportion to the bucket, whatever its size.
    """

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            fp = pdf["fp"].to_numpy()
            keys = block_keys(fp.view(np.uint64), distance, blocks)
            yield pd.DataFrame({"bucket": keys.view(np.int64).ravel(), "fp": np.repeat(fp, keys.shape[1])})

    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_b, held_f, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def close(b: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            nonlocal large
            edge = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            size = np.diff(np.append(edge, len(b)))
            big = np.repeat((size > block_rows) | (b[edge] == (large if large is not None else b[edge] + 1)), size)
            x, y = _forest(f[~big].view(np.uint64), b[~big], distance)
            fine = f[~big]
            hot = pd.DataFrame({"a": f[big], "b": f[big], "hot": True})
            return pd.concat([pd.DataFrame({"a": fine[x], "b": fine[y], "hot": False}), hot])

        for pdf in itertools.chain(parts, [None]):
            if pdf is not None:
                held_b, held_f = np.append(held_b, pdf["bucket"].to_numpy()), np.append(held_f, pdf["fp"].to_numpy())
            if not len(held_b):
                continue
            at = len(held_b) if pdf is None else int(np.searchsorted(held_b, held_b[-1]))
            if at:
                yield close(held_b[:at], held_f[:at])
                held_b, held_f = held_b[at:], held_f[at:]
            if len(held_b) > block_rows:  # the last bucket is large already: let its rows go
                large = held_b[0]
                yield pd.DataFrame({"a": held_f, "b": held_f, "hot": True})
                held_b, held_f = held_b[:0], held_f[:0]

    dealt = distinct.select("fp").mapInPandas(keyed, "bucket long, fp long").repartition("bucket").sortWithinPartitions("bucket", "fp")
    found = cut(dealt.mapInPandas(compared, "a long, b long, hot boolean").distinct())
    near = found.filter("not hot").select("a", "b")
    hot = found.filter("hot").select(F.col("a").alias("fp"))
    if hot.isEmpty():
        return near
    return near.unionByName(hub_links(hot, distance))


def hub_links(hot: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints by way of the numbers between them, combined before the shuffle."""
    half = -(-distance // 2)

    def around(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        masks = [0] + [sum(1 << b for b in c) for r in range(1, half + 1) for c in itertools.combinations(range(64), r)]
        masks = np.array(masks, np.uint64)
        for pdf in parts:
            for fp in np.array_split(pdf["fp"].to_numpy(), max(1, len(pdf) // 256)):
                yield pd.DataFrame({"hub": (fp.view(np.uint64)[:, None] ^ masks).view(np.int64).ravel(), "fp": np.repeat(fp, len(masks))})

    def close(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            a, b, hub = (pdf[c].to_numpy().view(np.uint64) for c in ("a", "b", "hub"))
            ok = (a != b) & (np.bitwise_count(a ^ hub) + np.bitwise_count(b ^ hub) <= distance)
            yield pdf[ok][["a", "b"]]

    near = hot.mapInPandas(around, "hub long, fp long")
    if distance % 2 == 0:  # all members of a hub are within the distance of each other
        least = near.groupBy("hub").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        return near.join(least, "hub").select(F.col("fp").alias("a"), "b").filter("a != b").distinct()
    # odd: nearest members (one bit less) link with all others of their hub
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))
    inner = near.filter(bits < half).groupBy("hub").agg(F.min("fp").alias("b"))
    return near.join(inner, "hub").select(F.col("fp").alias("a"), "b", "hub").mapInPandas(close, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b) reaches.

    Large-star and small-star steps in turn, each stored, until every node hangs on its root alone; the
    number of steps follows the logarithm of the longest chain. A node's neighbours are dealt to salts, so that those of
    a node with very many meet its least one in as many tasks.
    """

    def with_least(e: DataFrame, low: DataFrame) -> DataFrame:
        """The links of ``e`` (a, b) with m, the least neighbour of a in ``low`` (a, m, seen)."""
        low = low.select("a", "m", each_salt(F.col("seen")).alias("salt"))
        return e.withColumn("salt", salt("b")).join(low, ["a", "salt"])

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), salts_seen(salt("b")).alias("seen")).withColumn("m", F.least("a", "m"))
        return with_least(both.filter("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b")
        low = down.groupBy("a").agg(F.min("b").alias("m"), salts_seen(salt("b")).alias("seen"))
        return with_least(down, low).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()

    def stars(e: DataFrame) -> bool:
        """Whether every node has one link down at most, and then none up: nothing is left to do."""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        with settings(e.sparkSession, CUT_SETTINGS):
            return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty()

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    for _ in range(rounds):
        if stars(e):
            break
        e = cut(small_star(large_star(e)))
    else:
        if not stars(e):
            raise RuntimeError(f"components: links still change after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, fingerprint string of 16 hex digits, component_id) for every row of ``docs``.

    component_id is the least key reachable over fingerprints within ``distance`` bits. Null texts
    count as empty; texts without a word have fingerprint zero and are linked like any other. A
    null key never becomes a component's id unless all keys of the component are null. Rows that repeat a key give one
    row each. Other columns are ignored; an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, key, text, words))
    distinct = cut(rows.groupBy("fp").agg(F.min(key).alias("least"), salts_seen(salt(key)).alias("salts")))
    edges = links(distinct, distance, blocks_for(distinct.count(), distance))
    roots = components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "salts", F.coalesce("root", "fp").alias("root"))
    named = named.withColumn("slot", salt("fp"))
    tops = named.groupBy("root").agg(F.min("least").alias("component_id"), salts_seen(F.col("slot")).alias("seen"))
    named = named.join(tops.select("root", "component_id", each_salt(F.col("seen")).alias("slot")), ["root", "slot"]).select("fp", each_salt(F.col("salts")).alias("salt"), "component_id")
    return rows.withColumn("salt", salt(key)).join(named, ["fp", "salt"]).select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
