"""Near duplicates of a given similarity: blocks of long SimHash fingerprints fetch groups, exact Jaccard of word shingles links."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, cut, each_salt, over_texts, salt, salts_seen, small, whole
from .simhash import components

#: A fingerprint has so many runs of 16 bits whose nibbles make keys, and CHECK longs more that are compared in a bucket.
BLOCKS, CHECK = 64, 2
#: Of the 64 * CHECK bits so many may differ. Texts of 0.8 similarity differ in about 20, others in about 64.
MOST_BITS = 38
#: Unlike rows that share a bucket by chance, at most, on average: keys get longer with the table.
CHANCE_ROWS = 64
#: Rows of a bucket that are compared in one task; a bucket with more is cut to parts.
BUCKET_ROWS = 4096
#: Shingles and texts of a group that are verified together; larger groups are cut to parts.
PART_SHINGLES, PART_TEXTS = 1 << 18, 1024
_ODD = np.random.default_rng(11).integers(0, 2**63, BLOCKS // 4 + CHECK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles; A-Z lower-cased, words are split at ASCII white space."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) > words else [b" ".join(w)]
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 42) for x in runs], np.uint64))


def long_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in BLOCKS // 4 + CHECK longs."""
    ones = np.zeros(64 * len(_ODD), np.int32)
    for i in range(0, len(shingles), 1 << 12):
        x = shingles[i : i + (1 << 12), None] * _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def key_nibbles(n: int) -> np.ndarray:
    """Which nibbles of a fingerprint make each of its keys in a table of ``n`` rows.

    Four nibbles and 64 keys do for some millions of rows; each nibble more takes twice the keys, as two texts of similarity 0.8
    agree in a nibble about every second time. So recall stays, and rows of a bucket that share it by chance stay few.
    """
    more = next(k for k in range(5) if n >> (16 + 4 * k) < CHANCE_ROWS or k == 4)
    width, keys, all_ = 4 + more, BLOCKS << more, np.arange(4 * BLOCKS)
    if not more:
        return all_.reshape(keys, width)
    rng, each = np.random.default_rng(13), len(all_) // width
    return np.concatenate([rng.permutation(all_)[: each * width].reshape(each, width) for _ in range(-(-keys // each))])[:keys]


def block_keys(fp: np.ndarray, nibbles: np.ndarray) -> np.ndarray:
    """Long keys of each fingerprint (rows of longs), one for each row of ``nibbles``."""
    octets = np.ascontiguousarray(fp[:, : BLOCKS // 4]).view(np.uint8)
    each = np.stack([octets & 15, octets >> 4], axis=2).reshape(len(fp), -1)
    keys = np.broadcast_to(np.arange(len(nibbles), dtype=np.int64), (len(fp), len(nibbles))).copy()
    for column in nibbles.T:
        keys = (keys << 4) | each[:, column]
    return keys


def forest(check: np.ndarray, group: np.ndarray, most: int, top: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of every row to the first one that pairs within ``most`` bits connect it with, inside groups of equal ``group`` (sorted).

    ``top`` names for each row the first one that it is known to be connected with.
    """
    n = len(group)
    a = np.arange(n)
    top = a.copy() if top is None else top.copy()
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[:n])
    size = np.diff(np.append(first, n))
    start, end = np.repeat(first, size), np.repeat(first + size - 1, size)
    for d in itertools.count(1):
        a = a[a + d <= end[a]]
        if d & (d - 1) == 0 and len(a):  # groups that are connected need no more pairs
            a = a[np.repeat(np.logical_or.reduceat(top != start, first), size)[a]]
        if not len(a):
            other = np.flatnonzero(top != np.arange(n))
            return other, top[other]
        open_ = a[top[a] != top[a + d]]
        close = open_[np.bitwise_count(check[open_] ^ check[open_ + d]).sum(axis=1) <= most]
        if len(close):
            while True:  # the lower top wins until both ends of every link agree; tops are rows, so that following them merges
                low = np.minimum(top[close], top[close + d])
                if (top[close] == low).all() and (top[close + d] == low).all():
                    break
                for x in (top[close], top[close + d]):
                    np.minimum.at(top, x, low)
                while (top[top] != top).any():
                    top = top[top]


def in_parts(members: DataFrame, most_n: int, most_rows: int, compare: Callable[[pd.DataFrame], pd.DataFrame], fill: Callable[[DataFrame], DataFrame] = lambda m: m) -> DataFrame:
    """(a, b): links that connect in each group of ``members`` (group, row, n; stored) all that like pairs of it connect.

    Groups with over ``most_rows`` rows or ``most_n`` in the sum of n are cut to parts. Every part meets the group's first row as
    well; rows that aren't connected with that one afterwards meet all other parts, in lots of a part's size. So a group of copies takes
    time in proportion to its size, and all pairs of a group meet where its rows are unlike. ``fill`` adds what ``compare``
    needs; that gets row, label (equal for rows that are known to be connected) and guest (pairs without one need no look), and returns a and b.
    """
    parts = F.greatest(F.ceil(F.sum("n") / most_n), F.ceil(F.count(F.lit(1)) / most_rows)).cast("long")
    large = small(cut(members.groupBy("group").agg(parts.alias("parts"), F.min("row").alias("lead")).filter("parts > 1")))
    several = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = members.join(large, "group", "left").withColumn("part", F.pmod(F.xxhash64("row"), several))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    at = F.when(F.col("row") == F.col("lead"), upto(F.col("parts"))).otherwise(F.array("part"))
    met = fill(dealt.withColumn("at", at).withColumn("label", F.col("row")).withColumn("guest", F.lit(True))).withColumn("place", F.explode("at"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return compare(pdf).assign(large=pdf["parts"].notna().any())

    links = cut(met.groupBy("group", "place").applyInPandas(first, "a long, b long, large boolean"))
    found = links.select("a", "b")
    if large.isEmpty():
        return found
    known = small(components(links.filter("large").select("a", "b")))
    labelled = dealt.filter("parts is not null").join(known, F.col("row") == F.col("node"), "left").withColumn("label", F.coalesce("root", "row")).drop("node", "root")
    labelled = cut(labelled)
    leads = small(cut(labelled.filter("row = lead").select("group", F.col("label").alias("top"))))
    labelled = labelled.join(leads, "group").withColumn("guest", F.col("label") != F.col("top"))
    lots = small(cut(labelled.filter("guest").groupBy("group").agg(parts.alias("lots"))))
    if lots.isEmpty():
        return found
    here = F.transform(upto(F.col("lots")), lambda lot: F.struct(F.col("part").alias("place"), lot.alias("lot"), F.lit(False).alias("guest")))
    own_lot = F.pmod(F.xxhash64("row", F.lit(1)), F.col("lots"))
    there = F.transform(F.filter(upto(F.col("parts")), lambda q: q != F.col("part")), lambda q: F.struct(q.alias("place"), own_lot.alias("lot"), F.lit(True).alias("guest")))
    again = labelled.join(lots, "group").withColumn("at", F.when(F.col("guest"), F.concat(here, there)).otherwise(here)).drop("guest")
    again = fill(again).withColumn("at", F.explode("at")).withColumn("guest", F.col("at.guest"))
    again = again.withColumn("place", F.col("at.place")).withColumn("lot", F.col("at.lot"))
    return found.unionByName(again.groupBy("group", "place", "lot").applyInPandas(compare, "a long, b long"))


def candidates(prints: DataFrame) -> DataFrame:
    """(a long, b long): links that connect all rows of ``prints`` (row, fp; stored) that share a key and nearly all of the other bits."""
    names = [f"c{i}" for i in range(CHECK)]
    columns = "".join(f", {c} long" for c in names)
    nibbles = key_nibbles(prints.count())

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k in range(0, len(pdf), 256):
                lot = pdf.iloc[k : k + 256]
                fp = np.frombuffer(b"".join(lot["fp"]), np.uint64).reshape(len(lot), -1)
                check = np.repeat(fp[:, BLOCKS // 4 :].view(np.int64), len(nibbles), axis=0)
                yield pd.DataFrame({"bucket": block_keys(fp, nibbles).ravel(), "row": np.repeat(lot["row"].to_numpy(), len(nibbles))} | {c: check[:, i] for i, c in enumerate(names)})

    def bits(pdf: pd.DataFrame) -> np.ndarray:
        return np.stack([pdf[c].to_numpy().view(np.uint64) for c in names], axis=1)

    def linked(row: np.ndarray, x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": np.maximum(row[x], row[y]), "b": np.minimum(row[x], row[y])})

    def handed_back(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": pdf["row"], "b": pdf["row"], "hot": pdf["bucket"].astype("Int64")} | {c: pdf[c].astype("Int64") for c in names})

    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, large = None, -1
        for pdf in itertools.chain(parts, [None]):
            if pdf is not None:
                held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if held is None or not len(held):
                continue
            bucket = held["bucket"].to_numpy()
            at = len(held) if pdf is None else int(np.searchsorted(bucket, bucket[-1]))
            if at:
                ready, b = held.iloc[:at], bucket[:at]
                edge = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                size = np.diff(np.append(edge, at))
                big = np.repeat((size > BUCKET_ROWS) | (b[edge] == large), size)
                x, y = forest(bits(ready)[~big], b[~big], MOST_BITS)
                done = linked(ready["row"].to_numpy()[~big], x, y)
                yield done.assign(**{c: pd.array([None] * len(done), "Int64") for c in ("hot", *names)})
                if big.any():
                    yield handed_back(ready[big])
                held = held.iloc[at:]
            if len(held) > BUCKET_ROWS:  # the last bucket is large already: let its rows go
                large = bucket[-1]
                yield handed_back(held)
                held = None

    def paired(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf["row"].to_numpy()
        _, at, of = np.unique(pdf["label"].to_numpy(), return_index=True, return_inverse=True)
        return linked(row, *forest(bits(pdf), np.zeros(len(row), np.int8), MOST_BITS, at[of]))

    # rows of one fingerprint are linked without a comparison, and one of them stands for them
    one = cut(prints.groupBy("fp").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), salts_seen(salt("row")).alias("salts")))
    again = one.filter("n > 1").select("fp", F.col("row").alias("b"), each_salt(F.col("salts")).alias("salt"))
    equal = prints.withColumn("salt", salt("row")).join(again, ["fp", "salt"]).filter("row != b").select(F.col("row").alias("a"), "b")
    dealt = one.select("row", "fp").mapInPandas(keyed, f"bucket long, row long{columns}").repartition("bucket").sortWithinPartitions("bucket", "row")
    found = cut(dealt.mapInPandas(compared, f"a long, b long, hot long{columns}"))
    links = found.filter("hot is null").select("a", "b")
    hot = found.filter("hot is not null").select(F.col("hot").alias("group"), F.col("a").alias("row"), F.lit(1).alias("n"), *names)
    if not hot.isEmpty():
        links = links.unionByName(in_parts(hot, BUCKET_ROWS, BUCKET_ROWS, paired))
    # a row has one link for each of its buckets at most: what it links to is linked to the least of that instead
    ends = links.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("ends"))
    return ends.select("m", F.explode(F.array_append("ends", F.col("a"))).alias("a")).filter("a != m").select("a", F.col("m").alias("b")).unionByName(equal).distinct()


def verified(rows: np.ndarray, sets: list[np.ndarray], similarity: float, label: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that connect what pairs of ``sets`` with a Jaccard similarity of ``similarity`` and more connect.

    Rows of one ``label`` are connected already; pairs without a ``guest`` need no look.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    edges, owner = np.append(0, np.cumsum(sizes)), np.repeat(np.arange(n), sizes)
    top, has = np.unique(label, return_inverse=True)[1], np.zeros(len(ids), bool)
    a, b = [], []
    for i in np.flatnonzero(guest):
        if (top == top[i]).all():
            break
        mine = at[edges[i] : edges[i + 1]]
        has[mine] = True
        both = np.bincount(owner[has[at]], minlength=n)
        has[mine] = False
        like = (both >= similarity * (sizes[i] + sizes - both) - 1e-9) & (top != top[i])
        found = np.flatnonzero(like)
        for j in found[np.unique(top[found], return_index=True)[1]]:
            a.append(rows[i])
            b.append(rows[j])
        if len(found):
            tops = np.append(top[found], top[i])
            top[np.isin(top, tops)] = tops.min()
    return np.array(a, np.int64), np.array(b, np.int64)


def near_groups(docs: DataFrame, row: str, text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row, root): the rows of ``docs`` that links of ``similarity`` and more connect with another; root is the least of them.

    ``row`` is a long that no two rows share. Similarity is the Jaccard one of the sets of word shingles; texts without a word,
    null ones too, are equal. SimHash only fetches: rows that share one of the keys and differ in MOST_BITS of
    the other bits at most come into one group, and inside a group every pair of rows that isn't connected yet is verified.
    """

    def print_of(t: str) -> tuple[bytes, int]:
        s = shingle_set(t, words)
        return long_fingerprint(s).tobytes(), len(s)

    printed = over_texts("fp binary, n int", lambda: lambda texts: list(map(print_of, texts)))
    shingled = over_texts("array<long>", lambda: lambda texts: [shingle_set(t, words).view(np.int64) for t in texts])

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, np.int64) for s in pdf["shingles"]]
        a, b = verified(pdf["row"].to_numpy(), sets, similarity, pdf["label"].to_numpy(), pdf["guest"].to_numpy(bool))
        return pd.DataFrame({"a": a, "b": b})

    def with_sets(members: DataFrame) -> DataFrame:
        members = members.withColumnRenamed("row", "_member")
        members = F.broadcast(members) if few else members
        texts = docs.select(F.col(row).alias("row"), whole(text).alias("_text")).join(members, F.col("row") == F.col("_member"))
        return texts.withColumn("shingles", shingled("_text")).drop("_text", "_member")

    prints = cut(docs.select(F.col(row).alias("row"), printed(whole(text)).alias("p")).select("row", "p.fp", "p.n"))
    groups = components(candidates(prints.select("row", "fp")))
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sized = cut(groups.join(prints.select("row", "n"), groups["node"] == F.col("row")).select("row", F.col("root").alias("group"), "n"))
    few = sized.count() <= MOST_BROADCAST
    found = components(in_parts(sized, PART_SHINGLES, PART_TEXTS, linked, with_sets))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias(row), "root")
