"""Keeping a catalog of languages, recordings, entries and segments: upserts, replacement, audits.

Each function returns the new table; ``sources.sinks.swap`` writes one to a new version folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import places, small


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key; columns that ``new`` has are replaced, nulls too, and others stay.

    Of several new rows with one key the greatest stays.
    """
    supplied = [c for c in new.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*supplied)).alias("_new")) if supplied else new.distinct().withColumn("_new", F.lit(True))
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("_old"))
    both = o.join(new, keys, "full")
    value = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) if c in supplied else F.col(f"_old.{c}")
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def upsert_recordings(old: DataFrame, new: DataFrame, id_: str = "recording_id", known: DataFrame | None = None) -> DataFrame:
    """As upsert by (language_code, audio_filename); known rows keep their id, new ones get ids after the largest.

    ``known`` has all ids where ``old`` is only a part of the table. The new rows are numbered by language and file, without a task that orders them all.
    """
    done = upsert(old, new, ["language_code", "audio_filename"])
    top = (old if known is None else known).agg(F.coalesce(F.max(id_), F.lit(0)).alias("_top"))
    fresh = places(done.filter(F.col(id_).isNull()), [], ["language_code", "audio_filename"], "_n")
    fresh = fresh.crossJoin(F.broadcast(top)).withColumn(id_, F.col("_top") + F.col("_n")).drop("_top", "_n", "_size")
    return done.filter(F.col(id_).isNotNull()).unionByName(fresh)


def replace_of(old: DataFrame, new: DataFrame, owner: str = "recording_id") -> DataFrame:
    """``old`` less all rows of the owners in ``new``, and ``new``; an owner without new rows keeps its old ones."""
    return old.join(small(new.select(owner).distinct()), owner, "left_anti").unionByName(new, allowMissingColumns=True)


def mark_downloaded(recordings: DataFrame, remote: DataFrame, local: DataFrame) -> DataFrame:
    """``recordings`` with downloaded where the local file (audio_filename, size) is at least as large as the remote one."""
    sizes = remote.select("audio_filename", F.col("size").alias("_remote")).join(local.select("audio_filename", F.col("size").alias("_local")), "audio_filename")
    complete = (F.col("_remote") > 0) & (F.col("_local") >= F.col("_remote"))
    return recordings.join(sizes, "audio_filename", "left").withColumn("downloaded", F.col("downloaded") | F.coalesce(complete, F.lit(False))).drop("_remote", "_local")


def audit(tables: dict[str, DataFrame], unique: list[tuple[str, list[str]]], references: list[tuple[str, str, str, str]], required: list[tuple[str, str]]) -> DataFrame:
    """(kind, table, columns, violations): repeated keys, orphans and nulls; zeros too.

    References are counted by key before they are joined, so that each key moves once from each task however many rows refer to it.
    """
    row = lambda kind, table, columns: [F.lit(kind).alias("kind"), F.lit(table).alias("table"), F.lit(columns).alias("columns")]
    found = []
    for t, keys in unique:
        twice = tables[t].groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        found.append(twice.agg(F.count_if(F.col("n") > 1).alias("violations")).select(*row("unique", t, ",".join(keys)), "violations"))
    for t, column, other, key in references:
        referring = tables[t].filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        orphans = referring.join(tables[other].select(F.col(key).alias(column)), column, "left_anti")
        found.append(orphans.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("violations")).select(*row("reference", t, column), "violations"))
    for t, column in required:
        found.append(tables[t].agg(F.count_if(F.col(column).isNull()).alias("violations")).select(*row("required", t, column), "violations"))
    return reduce(DataFrame.unionByName, found)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table"), "n") for t, df in tables.items()])


def pending_downloads(recordings: DataFrame) -> DataFrame:
    return recordings.filter(F.col("wav_url").isNotNull() & ~F.coalesce("downloaded", F.lit(False))).orderBy("language_code", "audio_filename")


def pending_segmentation(recordings: DataFrame, segments: DataFrame, force: bool = False) -> DataFrame:
    """Downloaded word-list recordings without segments, or all of them if ``force``."""
    ready = recordings.filter((F.col("recording_type") == "word-list") & F.col("downloaded"))
    return ready if force else ready.join(segments.select("recording_id").distinct(), "recording_id", "left_anti")


def skipped_segments(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: how many segments the ready recordings have already."""
    ready = recordings.filter((F.col("recording_type") == "word-list") & F.col("downloaded")).select("recording_id")
    return segments.join(ready, "recording_id", "left_semi").agg(F.count(F.lit(1)).alias("skipped"))


def missing_entries(recordings: DataFrame, entries: DataFrame, languages: DataFrame) -> DataFrame:
    """(recording_id, language_code, audio_filename, page_url, expected_url, reason) of recordings without entries."""
    empty = recordings.join(entries.select("recording_id").distinct(), "recording_id", "left_anti")
    empty = empty.join(languages.select(F.col("code").alias("language_code"), "url"), "language_code", "left")
    page = F.regexp_replace("wordlist_url", "#.*$", "")
    expected = F.concat(F.regexp_replace("url", "/[^/]*$", ""), F.lit("/"), "audio_filename", F.lit(".html"))
    reason = F.when(F.col("wordlist_url").isNull(), "no word list").when(~page.contains("word-list"), "not a word list").otherwise("no rows parsed")
    return empty.select("recording_id", "language_code", "audio_filename", page.alias("page_url"), expected.alias("expected_url"), reason.alias("reason"))


def read_languages(languages: DataFrame, code: str | None = None) -> DataFrame:
    """One language by its code, or all by name."""
    return languages.filter(F.col("code") == code.upper()) if code else languages.orderBy("name")


def read_recordings(recordings: DataFrame, language: str | None = None, recording_type: str | None = None, downloaded: bool | None = None) -> DataFrame:
    """Recordings by what is given; an empty language or type is no filter, downloaded=False is one."""
    if language:
        recordings = recordings.filter(F.col("language_code") == language.upper())
    if recording_type:
        recordings = recordings.filter(F.col("recording_type") == recording_type)
    return recordings if downloaded is None else recordings.filter(F.col("downloaded") == downloaded)


def read_entries(entries: DataFrame, recording_id: int | None = None, language: str | None = None) -> DataFrame:
    """Entries in order of their numbers, those without one first."""
    if recording_id:
        entries = entries.filter(F.col("recording_id") == recording_id)
    if language:
        entries = entries.filter(F.col("language_code") == language.upper())
    return entries.orderBy(F.col("entry_number").asc_nulls_first())
