"""Exact deduplication against immutable snapshots with static binary-fuse filters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import cut, each_salt, salt, salts_seen, whole


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row key, digest binary of 32 bytes, probe long, salt int): what moves in place of texts."""
    return docs.select(F.col(key), F.unhex(F.sha2(whole(text), 256)).alias("digest"), F.xxhash64(whole(text)).alias("probe"), salt(key).alias("salt"))


def group_batch(light: DataFrame, key: str = "doc_id") -> DataFrame:
    """The duplicates inside one new batch: (digest, probe, keep, n, salts), combined before the shuffle."""
    return light.groupBy("digest", "probe").agg(F.max(key).alias("keep"), F.count(F.lit(1)).alias("n"), salts_seen(F.col("salt")).alias("salts"))


def screen(incoming: DataFrame, n_incoming: int, filters: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``incoming`` (digest, probe, ...) that a snapshot's filters let through.

    Filter and digests meet by bucket. A bucket's digests are dealt to slots so that a batch
    larger than its snapshot gives groups of bounded size.
    """
    slots = max(1, -(-n_incoming // (buckets * fuse.BUCKET)))
    names = incoming.columns
    keyed = incoming.withColumns({"bucket": F.pmod("probe", F.lit(buckets)).cast("int"), "slot": F.pmod(F.xxhash64("digest"), F.lit(slots)).cast("int")})
    copies = filters.select("bucket", "filter", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))

    def passed(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(rows):
            return rows[names].iloc[:0]
        return rows[names][fuse.contains(bytes(held["filter"].iloc[0]), rows["probe"].to_numpy())]

    return keyed.groupBy("bucket", "slot").cogroup(copies.groupBy("bucket", "slot")).applyInPandas(passed, incoming.schema)


def matching_texts(docs: DataFrame, wanted: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row key, digest, probe, salt, text) of the rows whose digest may be among the n ``wanted`` ones.

    Up to fuse.BROADCAST_BYTES of filters the rows are screened where they are read, so that only
    the texts of likely duplicates move; beyond that the digests are joined.
    """
    rows = docs.select(F.col(key), F.unhex(F.sha2(whole(text), 256)).alias("digest"), F.xxhash64(whole(text)).alias("probe"), salt(key).alias("salt"), whole(text).alias("text"))
    if not fuse.fits(n):
        return rows.join(wanted.select("digest", "probe"), ["digest", "probe"], "left_semi")
    filters = fuse.broadcast_filters(wanted, "probe", n)

    @F.pandas_udf("boolean")
    def likely(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for probes in parts:
            yield pd.Series(filters.value.contains(probes.to_numpy()))

    return rows.filter(likely("probe"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 2) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size long, kept boolean, text_sha256.

    The rows come in as ``batches`` ranges of descending keys, so that an earlier snapshot holds
    the row to stay. Each batch groups its own duplicates, its digests are screened by the filters
    of every earlier snapshot, and positives meet the snapshot's exact buckets. All groups of two
    and more are then formed again on (digest, text), byte for byte.

    Keys are whole numbers. Null texts count as empty; a null key is the smallest. Rows equal in key and text are
    counted in group_size and stay or go together. Other columns of ``docs`` are ignored. An empty
    table gives no rows.
    """
    light = digests(docs, key, text)
    low, high = light.agg(F.min(key), F.max(key)).first()
    low, high = (0, 0) if low is None else (low, high)
    edges = [high + 1 - (high + 1 - low) * (i + 1) // batches for i in range(batches - 1)]
    batch = F.lit(batches - 1)
    for i in reversed(range(batches - 1)):
        batch = F.when(F.col(key) >= edges[i], i).otherwise(batch)
    light = cut(light.withColumn("batch", batch))

    repeated: list[DataFrame] = []
    snapshots: list[tuple[DataFrame, DataFrame, int]] = []
    for i in range(batches):
        groups = cut(group_batch(light.filter(F.col("batch") == i), key))
        n = groups.count()
        for snapshot, filters, buckets in snapshots:
            positives = screen(groups, n, filters, buckets)
            repeated.append(snapshot.select("digest", "probe").join(positives.select("digest", "probe"), ["digest", "probe"]))
        repeated.append(groups.filter("n > 1").select("digest", "probe"))
        buckets = fuse.buckets_for(n)
        if i < batches - 1:
            snapshots.append((groups, cut(fuse.build_filters(groups, "probe", buckets)), buckets))
    multiple = cut(reduce(DataFrame.unionByName, repeated).distinct())

    texts = matching_texts(docs, multiple, multiple.count(), key, text)
    equal = texts.groupBy("digest", "probe", "text").agg(F.max(key).alias("keep"), F.count(F.lit(1)).alias("n"), salts_seen(F.col("salt")).alias("salts"))
    equal = equal.filter("n > 1").select("digest", "probe", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), each_salt(F.col("salts")).alias("salt"))
    return light.join(equal, ["digest", "probe", "salt"], "left").select(
        F.col(key),
        F.coalesce("keep_id", key).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col(key).eqNullSafe(F.col("keep_id")) | F.col("group_size").isNull(), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
