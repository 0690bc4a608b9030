"""Exact deduplication of batches that arrive one after the other: each leaves an immutable snapshot with its static filters.

A snapshot is a folder with ``rows`` (key, digest, probe, text) and ``filters`` (bucket, buckets, filter), which
are written last: without them a snapshot isn't one yet and may be written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fuse
from .common import cut, each_salt, salts_seen, small, whole
from .exact_dedup import digests, group_batch, matching_texts, screen


def names(spark: SparkSession, folder: str) -> list[str]:
    """The complete snapshots in a folder, by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "filters/_SUCCESS"))
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if done(s.getPath()))


def write(rows: DataFrame, place: str, key: str, text: str) -> None:
    """Write the rows of a batch that stay, then the filters of their digests."""
    spark = rows.sparkSession
    light = rows.select(F.col(key).alias("key"), F.unhex(F.sha2(whole(text), 256)).alias("digest"), F.xxhash64(whole(text)).alias("probe"), whole(text).alias("text"))
    light.write.mode("overwrite").parquet(f"{place}/rows")
    probes = spark.read.parquet(f"{place}/rows").select("probe").distinct()
    buckets = fuse.buckets_for(spark.read.parquet(f"{place}/rows").count())
    fuse.build_filters(probes, "probe", buckets).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{place}/filters")


def ingest(docs: DataFrame, folder: str, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size long (in the batch), known boolean, kept boolean, text_sha256.

    The batch's digests are screened by the filters of every snapshot in ``folder``; what they let through meets the snapshot's rows, and texts decide, byte for
    byte. ``known`` rows are in a snapshot already, with keep_id there. Of the others, equal ones are grouped inside the batch, and that with the largest key
    stays. Rows that stay become the snapshot ``name``, which never changes: a complete one of that name is refused, one that was cut off is written again.

    Keys are whole numbers; a null key is the smallest. Null texts count as empty. Rows equal in key and text stay or go together. Other columns are
    ignored. An empty batch gives no rows and a snapshot that lets nothing through.
    """
    spark = docs.sparkSession
    earlier = names(spark, folder)
    if name in earlier:
        raise ValueError(f"snapshot {name} is complete and doesn't change")
    light = cut(digests(docs, key, text))
    groups = cut(group_batch(light, key))
    n = groups.count()
    wanted, stored = [groups.filter("n > 1").select("digest", "probe")], []
    for other in earlier:
        filters = spark.read.parquet(f"{folder}/{other}/filters")
        first = filters.select("buckets").first()
        if first is None:
            continue
        positives = cut(screen(groups.select("digest", "probe"), n, filters.select("bucket", "filter"), first["buckets"]))
        met = spark.read.parquet(f"{folder}/{other}/rows").join(small(positives), ["digest", "probe"])
        stored.append(cut(met.groupBy("digest", "probe", "text").agg(F.max("key").alias("there"))))
        wanted.append(stored[-1].select("digest", "probe"))
    multiple = cut(reduce(DataFrame.unionByName, wanted).distinct())
    texts = matching_texts(docs, multiple, multiple.count(), key, text)
    equal = texts.groupBy("digest", "probe", "text").agg(F.max(key).alias("keep"), F.count(F.lit(1)).alias("n"), salts_seen(F.col("salt")).alias("salts"))
    if stored:
        there = reduce(DataFrame.unionByName, stored).groupBy("digest", "probe", "text").agg(F.max("there").alias("there"), F.lit(True).alias("known"))
        equal = equal.join(there, ["digest", "probe", "text"], "left")
    else:
        equal = equal.withColumns({"there": F.lit(None).cast("long"), "known": F.lit(None).cast("boolean")})
    equal = equal.filter("n > 1 or known").select("digest", "probe", "keep", "n", "there", "known", each_salt(F.col("salts")).alias("salt"))
    known = F.coalesce("known", F.lit(False))
    result = cut(light.join(equal, ["digest", "probe", "salt"], "left").select(
        F.col(key),
        F.when(known, F.col("there")).otherwise(F.coalesce("keep", key)).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        known.alias("known"),
        (~known & (F.col("n").isNull() | F.col(key).eqNullSafe(F.col("keep")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ))
    dropped = small(cut(result.filter("not kept").select(F.col(key).alias("_key"), F.col("text_sha256").alias("_sha")).distinct()))
    stay = docs.select(F.col(key), F.col(text)).join(dropped, F.col(key).eqNullSafe(F.col("_key")) & (F.sha2(whole(text), 256) == F.col("_sha")), "left_anti")
    write(stay, f"{folder}/{name}", key, text)
    return result
