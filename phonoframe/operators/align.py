"""Alignment durations: label intervals, frames, attaching and checking them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from .ranking import quantiles, small

#: The sample rate and hop that frames are counted by.
SAMPLE_RATE, HOP = 22050, 256


def intervals(files: DataFrame, key: str = "audio_id", content: str = "content") -> DataFrame:
    """(key, pos, start, end, label): the labelled intervals of each file's words tier, else of its phones tier.

    Files without either give no row. Empty labels are skipped.
    """
    tier = lambda name: F.regexp_extract(content, rf'(?s)name = "{name}"(.*?)(?:item \[\d+\]:|\z)', 1)
    body = F.when(tier("words") != "", tier("words")).otherwise(tier("phones"))
    interval = r'xmin = (\S+)\s+xmax = (\S+)\s+text = "((?:[^"]|"")*+)"'
    each = files.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(interval), F.lit(0))).alias("pos", "i"))
    part = lambda g: F.regexp_extract("i", f"(?s)^{interval}", g)
    each = each.select(key, "pos", part(1).try_cast("double").alias("start"), part(2).try_cast("double").alias("end"), F.replace(part(3), F.lit('""'), F.lit('"')).alias("label"))
    return each.filter(F.trim("label") != "")


def one_file_each(files: DataFrame, key: str = "audio_id", path: str = "path") -> DataFrame:
    """``files`` with one row for each key, that of the last path; contents move only where a key is repeated."""
    seen = files.groupBy(key).agg(F.max(path).alias("_last"), F.count(F.lit(1)).alias("_n"))
    chosen = small(seen.filter("_n > 1").select(F.col(key).alias("_key"), "_last"))
    kept = files.join(chosen, F.col(key) == F.col("_key"), "left").filter(F.col("_last").isNull() | (F.col("_last") == F.col(path)))
    return kept.drop("_key", "_last")


def frames(start: Column, end: Column, sample_rate: int = SAMPLE_RATE, hop: int = HOP) -> Column:
    """Whole frames of an interval in seconds, one at least."""
    return F.greatest(F.lit(1), ((end - start) * sample_rate / hop).cast("int"))


def clip_durations(labels: DataFrame, key: str = "audio_id") -> DataFrame:
    """(key, phones array, durations array, total_frames) from (key, pos, start, end, label)."""
    rows = labels.withColumn("frames", frames(F.col("start"), F.col("end")))
    x = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "label", "frames"))).alias("x"))
    return x.select(key, F.transform("x", lambda i: i["label"]).alias("phones"), F.transform("x", lambda i: i["frames"]).alias("durations"), F.aggregate("x", F.lit(0).cast("long"), lambda a, i: a + i["frames"]).alias("total_frames"))


def duration_counts(files: DataFrame, clips: DataFrame, key: str = "audio_id") -> DataFrame:
    """One row: files found, clips with durations, ids without; of files with one id only one counts as a clip, see ``one_file_each``."""
    n, ok = files.agg(F.count(F.lit(1)).alias("found"), F.countDistinct(key).alias("_ids")), clips.agg(F.count(F.lit(1)).alias("ok"))
    return n.crossJoin(ok).select("found", "ok", (F.col("_ids") - F.col("ok")).alias("failed"))


def attach_durations(manifest: DataFrame, clips: DataFrame, key: str = "audio_id") -> DataFrame:
    """``manifest`` with durations as a JSON array, empty where there are none; an old value is replaced."""
    found = clips.select(key, F.to_json("durations").alias("_d"))
    return manifest.drop("durations").join(found, key, "left").withColumn("durations", F.coalesce("_d", F.lit(""))).drop("_d")


def write_with_durations(manifest: DataFrame, clips: DataFrame, path: str, key: str = "audio_id") -> DataFrame:
    """Write ``attach_durations``; one row with total and updated, counted by the same job."""
    rows, seen = sinks.observed(attach_durations(manifest, clips, key), total=F.count(F.lit(1)), updated=F.count_if(F.col("durations") != ""))
    return sinks.written(rows, path, seen)


def check_durations(manifest: DataFrame, clips: DataFrame, key: str = "audio_id", tokens: str = "tokens") -> DataFrame:
    """(key, expected, actual, matched) of the clips that have durations."""
    both = manifest.join(clips.select(key, "phones"), key)
    return both.select(key, F.size(tokens).alias("expected"), F.size("phones").alias("actual")).withColumn("matched", F.col("expected") == F.col("actual"))


def check_totals(checked: DataFrame, order: list[str], examples: int = 10) -> DataFrame:
    """One row: matched, mismatched, and the first mismatches in order as an array of (key ..., expected, actual)."""
    wrong = checked.filter(~F.col("matched")).drop("matched")
    first = wrong.orderBy(*order).limit(examples)
    listed = first.agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in wrong.columns if c not in order]))).alias("examples"))
    return checked.agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("mismatched")).crossJoin(listed)


def duration_job(manifest: DataFrame, files: DataFrame, key: str = "audio_id", tokens: str = "tokens", update: bool = True, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(manifest, report): the manifest with durations of the alignment files, and one row a split.

    ``manifest`` has split, key and tokens; ``files`` (key, content), and path where ids may be repeated. Without ``update`` the manifest stays as it is and updated is null; without
    ``validate`` matched and mismatched are null.
    """
    files = one_file_each(files, key) if "path" in files.columns else files
    clips = clip_durations(intervals(files, key), key)
    done = attach_durations(manifest, clips, key) if update else manifest
    updated = F.count_if(F.col("durations") != "") if update else F.lit(None).cast("long")
    report = done.groupBy("split").agg(F.count(F.lit(1)).alias("total"), updated.alias("updated"))
    if not validate:
        return done, report.withColumns({"matched": F.lit(None).cast("long"), "mismatched": F.lit(None).cast("long")})
    checked = check_durations(manifest, clips, key, tokens).join(manifest.select(key, "split"), key)
    found = checked.groupBy(F.col("split").alias("_split")).agg(F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("mismatched"))
    return done, report.join(found, F.col("split").eqNullSafe(F.col("_split")), "left").drop("_split").fillna(0, ["matched", "mismatched"])


def looked_up(embedded: Column, recorded: Column, tokens: Column) -> Column:
    """Durations in a manifest's JSON if they can be read, else the record's, else ones."""
    parsed = F.from_json(embedded, "array<int>")
    return F.coalesce(F.when(F.size(parsed) >= 0, parsed), recorded, F.array_repeat(F.lit(1), F.size(tokens)))


def log_differences(a: Column, b: Column, mask: Column | None = None) -> Column:
    """A struct (total, weight) of two arrays and a mask: squared differences of log durations and places, each times its mask, up to the shortest.

    Without a mask each place counts once. A null place of the mask counts as 0.
    """
    mask = F.transform(a, lambda _: F.lit(1.0)) if mask is None else F.transform(mask, lambda m: F.coalesce(m.cast("double"), F.lit(0.0)))
    n = F.least(F.size(a), F.size(b), F.size(mask))
    ln = lambda x: F.log(x.cast("double") + 1e-6)
    first = lambda x: F.slice(x, F.lit(1), n)
    squares = F.zip_with(first(a), first(b), lambda x, y: F.pow(ln(x) - ln(y), 2))
    sum_of = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.struct(sum_of(F.zip_with(squares, first(mask), lambda s, m: F.when(m == 0, 0.0).otherwise(s * m))).alias("total"), sum_of(first(mask)).alias("weight"))


def log_agreement(a: Column, b: Column, alpha: float = 1.0, mask: Column | None = None) -> Column:
    """Mean squared difference of log durations over the shorter of two arrays, where the mask is, if there is one."""
    d = log_differences(a, b, mask)
    return alpha * d["total"] / (d["weight"] + 1e-6)


def corpus_agreement(rows: DataFrame, a: str, b: str, mask: str | None = None, alpha: float = 1.0) -> DataFrame:
    """One row: clips, and loss, the value over all places of all clips together, not the mean of the clips' values."""
    d = rows.select(log_differences(F.col(a), F.col(b), None if mask is None else F.col(mask)).alias("d"))
    total, weight = F.coalesce(F.sum("d.total"), F.lit(0.0)), F.coalesce(F.sum("d.weight"), F.lit(0.0))
    return d.agg(F.count(F.lit(1)).alias("clips"), (alpha * total / (weight + 1e-6)).alias("loss"))


def frame_statistics(rows: DataFrame, column: str = "frames", sample_rate: int = SAMPLE_RATE, hop: int = HOP) -> DataFrame:
    """One row: n, mean, median, std, least, most and mean_ms of the frames; nulls don't count."""
    c = F.col(column)
    middle = quantiles(rows.select(c.cast("double").alias("_v")), [], "_v", {"median": 0.5})
    one = rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), (F.avg(c) * 1000 * hop / sample_rate).alias("mean_ms"))
    return one.crossJoin(F.broadcast(middle)).select("n", "mean", "median", "std", "least", "most", "mean_ms")
