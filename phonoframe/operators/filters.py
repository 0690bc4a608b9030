"""Filters on entries and clips, and what became of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ipa
from ..sources import sinks

#: Clip lengths in seconds and the least text length.
LEAST_SECONDS, MOST_SECONDS, LEAST_TEXT = 0.3, 15.0, 3


def transcribed(column: str = "ipa") -> Column:
    """Neither null nor empty."""
    return F.col(column).isNotNull() & (F.col(column) != "")


def in_splits(splits: list[str] | None, column: str = "split") -> Column:
    """One of the splits; all rows for None."""
    return F.lit(True) if splits is None else F.coalesce(F.col(column).isin(splits), F.lit(False))


def seconds(column: str = "duration_ms") -> Column:
    """Milliseconds, which may be text, as seconds: 0 for missing ones, null for what is no number."""
    return F.coalesce(F.col(column).cast("string"), F.lit("0")).try_cast("double") / 1000.0


def in_duration(column: str = "duration_ms", least: float = LEAST_SECONDS, most: float = MOST_SECONDS) -> Column:
    return F.coalesce(seconds(column).between(least, most), F.lit(False))


def long_enough(column: str = "text", least: int = LEAST_TEXT) -> Column:
    return F.length(column) >= least


def has_tokens(tokens: Column) -> Column:
    return F.coalesce(F.size(tokens) > 0, F.lit(False))


def with_tokens(rows: DataFrame, column: str = "text") -> DataFrame:
    """Rows with at least one token, and their tokens."""
    return rows.withColumn("tokens", ipa.tokenize(F.col(column))).filter(has_tokens(F.col("tokens")))


def plausibility(duration_ms: Column, text: Column, least_ms: float, most_ms: float, least_text: int = LEAST_TEXT) -> Column:
    """The first thing wrong with a clip, by its milliseconds for each character: null if nothing is."""
    n = F.length(text)
    return F.when(duration_ms.isNull(), "audio_error").when(n < least_text, "ipa_too_short").when(duration_ms < n * least_ms, "too_short").when(duration_ms > n * most_ms, "too_long")


def _corpus_steps(splits: list[str] | None) -> tuple[Column, dict[str, Column]]:
    """What makes a row usable, and how many rows are left after each step."""
    s, t, d = in_splits(splits), F.coalesce(transcribed("ipa_audio_universal"), F.lit(False)), in_duration()
    return s & t & d, {"loaded": F.count(F.lit(1)), "in_split": F.count_if(s), "transcribed": F.count_if(s & t), "in_duration": F.count_if(s & t & d)}


def load_corpus(rows: DataFrame, splits: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The usable rows of a corpus table, and one row with how many were left after each step."""
    usable, counts = _corpus_steps(splits)
    return rows.filter(usable), rows.agg(*[c.alias(name) for name, c in counts.items()])


def write_corpus(rows: DataFrame, splits: list[str] | None, path: str) -> DataFrame:
    """Write the usable rows of a corpus table; one row with how many were left after each step, counted by the same job."""
    usable, counts = _corpus_steps(splits)
    rows, seen = sinks.observed(rows, **counts)
    return sinks.written(rows.filter(usable), path, seen)
