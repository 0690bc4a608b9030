"""Joins that make manifests out of the catalog, clips and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ipa
from ..sources import sinks
from . import filters, splits, stats, vocab


def export(entries: DataFrame, recordings: DataFrame, languages: DataFrame, segments: DataFrame, language: str | None = None) -> DataFrame:
    """One row per transcribed entry: id, language_code, language_name, ipa, english, audio_path, start_ms, end_ms, orthography.

    The path is the segment's file, else the recording's; ids may be equal across recordings, and
    an empty orthography is null.
    """
    rows = entries.filter(filters.transcribed())
    if language:
        rows = rows.filter(F.col("language_code") == language.upper())
    rows = rows.join(recordings.select("recording_id", "audio_filename"), "recording_id")
    rows = rows.join(languages.select(F.col("code").alias("language_code"), "name"), "language_code")
    rows = rows.join(segments.select("entry_id", "segment_file", "start_ms", "end_ms"), "entry_id", "left")
    return rows.select(
        ipa.entry_id(F.col("language_code"), F.col("entry_number")).alias("id"), "language_code", F.col("name").alias("language_name"), "entry_id", "entry_number", "ipa", "english",
        F.coalesce("segment_file", F.concat(F.lit("data/audio/"), "language_code", F.lit("/"), "audio_filename", F.lit(".wav"))).alias("audio_path"),
        "start_ms", "end_ms", F.when(F.col("orthography") != "", F.col("orthography")).alias("orthography"),
    )


def training_segments(segments: DataFrame, entries: DataFrame, recordings: DataFrame) -> DataFrame:
    """(segment_key, language_code, segment_file, ipa) of transcribed segments; of equal keys the last by language, file and entry stays."""
    rows = segments.filter("segment_file is not null").select("entry_id", "segment_file").join(entries.filter(filters.transcribed()), "entry_id").join(recordings.select("recording_id", "audio_filename"), "recording_id")
    rows = rows.withColumn("segment_key", ipa.segment_key(F.col("audio_filename"), F.coalesce("entry_number", F.lit(0))))
    last = F.max_by(F.struct("language_code", "segment_file", "ipa"), F.struct("language_code", "audio_filename", "entry_number", "entry_id"))
    return rows.groupBy("segment_key").agg(last.alias("x")).select("segment_key", "x.*")


def kept(rows: DataFrame, clips: DataFrame, key: str) -> DataFrame:
    """The rows whose clip passed."""
    return rows.join(clips.select(key).distinct(), key, "left_semi")


def zip_ordinal(regions: DataFrame, entries: DataFrame, group: str, region_order: str, entry_order: str) -> DataFrame:
    """The i-th region of a group beside its i-th entry (nulls first); what is over on either side has no row.

    Equal places in the order are told apart by the other columns that have an order, so that the result doesn't depend on how rows arrive.
    """
    ties = lambda df, first: [F.col(first).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c, kind in df.dtypes if c not in (group, first) and "map" not in kind]]
    r = regions.withColumn("ordinal", F.row_number().over(W.Window.partitionBy(group).orderBy(*ties(regions, region_order))))
    e = entries.withColumn("ordinal", F.row_number().over(W.Window.partitionBy(group).orderBy(*ties(entries, entry_order))))
    return r.join(e, [group, "ordinal"])


def resolve_audio(clips: DataFrame, listing: DataFrame) -> DataFrame:
    """``clips`` (locale, audio_file, ...) with the first path under a folder that ends in -locale; others are dropped."""
    files = listing.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("audio_file"), F.regexp_extract("path", r"([^/]+)/audios/[^/]+$", 1).alias("_dir"))
    files = files.withColumn("_suffix", F.explode(F.transform(F.sequence(F.lit(2), F.size(F.split("_dir", "-"))), lambda i: F.array_join(F.slice(F.split("_dir", "-"), i, F.size(F.split("_dir", "-"))), "-"))))
    first = files.groupBy("audio_file", F.col("_suffix").alias("locale")).agg(F.min("path").alias("path"))
    return clips.join(first, ["locale", "audio_file"])


def combined_corpus(first: DataFrame, second: DataFrame, min_count: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, vocabulary, speakers) of two corpora of (audio_file, text, speaker_name, ...) as one.

    The vocabulary is that of all texts and speakers together, and so are the speakers' numbers.
    """
    both = combine(first, second)
    codes = both.select(F.upper("speaker_name").alias("code"))
    return both, vocab.build_vocabulary(stats.token_counts(both, text="text"), codes, min_count), vocab.speaker_map(codes)


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two manifests under one another; columns that one lacks are null."""
    return first.unionByName(second, allowMissingColumns=True)


def generate(rows: DataFrame, clips: DataFrame, key: str = "segment_key", text: str = "ipa", language: str = "language_code") -> DataFrame:
    """(audio_file, text, speaker_name, split): kept clips with tokens, normalised and split by language."""
    good = kept(rows, clips, key).withColumn("text", ipa.normalize_ipa(F.col(text)))
    good = good.filter(filters.has_tokens(ipa.tokenize(F.col("text"), normalize=False)))
    done = splits.stratified(sinks.stored(good), language, key)
    return done.select(F.concat(F.lit("wavs/"), key, F.lit(".wav")).alias("audio_file"), "text", F.col(language).alias("speaker_name"), "split")


def _corpus_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", ipa.normalize_ipa(ipa.join_phones(F.col("ipa_audio_universal")))).withColumn("split", splits.by_column(F.col("split")))


def _corpus_named(made: DataFrame) -> DataFrame:
    made = made.filter("split is not null").filter(_spoken())
    return made.select(F.format_string("wavs/cv_%s_%s.wav", "locale", "audio_id").alias("audio_file"), "text", F.upper("locale").alias("speaker_name"), "split")


def _spoken() -> Column:
    return filters.has_tokens(ipa.tokenize(F.col("text"), normalize=False))


def corpus_manifest(rows: DataFrame) -> DataFrame:
    """(audio_file, text, speaker_name, split) of a corpus table with its own splits."""
    return _corpus_named(_corpus_texts(rows))


def write_corpus_manifest(rows: DataFrame, path: str) -> DataFrame:
    """Write ``corpus_manifest``; one row with loaded, in_split, train and val, counted by the same job."""
    good = F.col("split").isNotNull() & _spoken()
    made, seen = sinks.observed(_corpus_texts(rows), loaded=F.count(F.lit(1)), in_split=F.count_if(F.col("split").isNotNull()), train=F.count_if(good & (F.col("split") == "train")), val=F.count_if(good & (F.col("split") == "val")))
    return sinks.written(_corpus_named(made), path, seen)
