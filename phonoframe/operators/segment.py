"""Segmenting time series by silence, and work on single clips.

Frames are rows (key, frame_idx, t_ms, mean_sq); a key is one recording, which may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import catalog
from .ranking import quantiles

# The grid of thresholds (dBFS) and least silences (ms) in order of trial, and the rest.
THRESHOLDS, LEAST_SILENCES = [-45, -40, -35, -30], [300, 200, 150]
NEAR_ENOUGH, PAD_MS, TRIM_DB, PEAK_DB = 2, 100, 30, -3.0


#: Frames that a task orders at once.
CHUNK = 4096


def level_db(mean_square: Column) -> Column:
    """Null for digital silence."""
    return F.when(mean_square > 0, 10 * F.log10(mean_square))


def united(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Both under one another, dealt by keys anew.

    Spark 4.1 takes a union of two tables that are dealt alike for one that is dealt so, which isn't true where it reads one of them in fewer parts;
    what groups by the keys after that would find a key twice.
    """
    return one.unionByName(other, allowMissingColumns=True).repartition(*keys)


def silent_runs(frames: DataFrame, keys: list[str], silent: list[Column], frame_ms: int = 10) -> DataFrame:
    """(keys, t, start, end): the runs of frames for which the t-th of ``silent`` holds, frames that follow each other in order being neighbours.

    A recording is cut to chunks of CHUNK frames, which are looked at alone. Runs inside a chunk are whole; those that touch its first or last frame,
    two at most, are put together where they meet the next chunk's. So a task orders one chunk, or two rows of each chunk of a recording.
    """
    chunk = F.floor(F.col("frame_idx") / CHUNK).alias("_chunk")
    w = W.Window.partitionBy(*keys, "_chunk")
    o = w.orderBy("frame_idx")
    rows = frames.select(*keys, chunk, "frame_idx", "t_ms", *[F.coalesce(s, F.lit(False)).cast("int").alias(f"_s{i}") for i, s in enumerate(silent)])
    # a run: place among all frames of the chunk less place among its silent ones
    rows = rows.select(*keys, "_chunk", "t_ms", F.row_number().over(o).alias("_n"), F.count(F.lit(1)).over(w).alias("_all"), *[f"_s{i}" for i in range(len(silent))], *[F.sum(f"_s{i}").over(o.rowsBetween(W.Window.unboundedPreceding, 0)).alias(f"_c{i}") for i in range(len(silent))])
    at = F.array(*[F.when(F.col(f"_s{i}") == 1, F.struct(F.lit(i).alias("t"), (F.col("_n") - F.col(f"_c{i}")).alias("island"))) for i in range(len(silent))])
    each = rows.select(*keys, "_chunk", "t_ms", "_n", "_all", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("x"))
    runs = each.groupBy(*keys, "_chunk", F.col("x.t").alias("t"), F.col("x.island").alias("_island")).agg(F.min("t_ms").alias("start"), (F.max("t_ms") + frame_ms).alias("end"), (F.min("_n") == 1).alias("_leads"), (F.max("_n") == F.max("_all")).alias("_trails")).drop("_island")
    inside = runs.filter(~F.col("_leads") & ~F.col("_trails")).select(*keys, "t", "start", "end")
    # every chunk has a row here, so that a chunk without silence at its edges lies between those beside it
    chunks = frames.select(*keys, chunk).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(silent) - 1))))
    own = W.Window.partitionBy(*keys, "t")
    edges = united(runs.filter(F.col("_leads") | F.col("_trails")), chunks, [*keys, "t"]).withColumn("_c", F.dense_rank().over(own.orderBy("_chunk"))).filter("start is not null")
    o = own.orderBy("_c", "start")
    goes_on = F.col("_leads") & F.lag("_trails").over(o) & (F.lag("_c").over(o) == F.col("_c") - 1)
    edges = edges.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    edges = edges.withColumn("_run", F.sum("_new").over(o.rowsBetween(W.Window.unboundedPreceding, 0)))
    joined = edges.groupBy(*keys, "t", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
    return united(inside, joined, keys)


def silences(frames: DataFrame, key: str, threshold: Column, least_ms: int, frame_ms: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``by``, start, end): runs of frames at or under the threshold, of at least ``least_ms``."""
    level = level_db(F.col("mean_sq"))
    runs = silent_runs(frames, [key, *by], [level.isNull() | (level <= threshold)], frame_ms)
    return runs.filter(F.col("end") - F.col("start") >= least_ms).drop("t")


def regions(silent: DataFrame, durations: DataFrame, key: str, by: tuple[str, ...] = (), unterminated: str = "ref") -> DataFrame:
    """(key, ``by``, start, end): what lies between the silences (key, ``by``, start, end).

    ``durations`` is (key, ``by``, duration). A last silence without an end leaves the tail where the one before ended ("ref") or has none ("silent").
    """
    w = W.Window.partitionBy(key, *by).orderBy("start")
    before = F.coalesce(F.last("end", ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    inner = silent.select(key, *by, before.alias("_from"), F.col("start").alias("_to"))
    tails = silent.groupBy(key, *by).agg(F.max("end").alias("_last"), F.count_if(F.col("end").isNull()).alias("_open"))
    tails = durations.join(tails, [key, *by], "left")
    if unterminated == "silent":
        tails = tails.filter(F.coalesce("_open", F.lit(0)) == 0)
    tail = tails.select(key, *by, F.coalesce("_last", F.lit(0)).alias("_from"), F.col("duration").alias("_to"))
    return united(inner.filter("_to > _from"), tail.filter("_to > _from"), [key, *by]).select(key, *by, F.col("_from").alias("start"), F.col("_to").alias("end"))


def grid_regions(frames: DataFrame, key: str, frame_ms: int = 10) -> DataFrame:
    """(key, idx, start, end): the regions at every grid point, from one sort of each chunk of frames.

    All thresholds are counted in one window; the least silences are applied to the silent runs, not to frames.
    """
    level = level_db(F.col("mean_sq"))
    runs = silent_runs(frames, [key], [level.isNull() | (level <= db) for db in THRESHOLDS], frame_ms)
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.lit(ms).alias("least")) for i, ms in enumerate(LEAST_SILENCES)]))
    idx = F.col("t") * len(LEAST_SILENCES) + F.col("_p.m")
    runs = runs.withColumn("_p", points).filter(F.col("end") - F.col("start") >= F.col("_p.least")).select(key, idx.alias("idx"), "start", "end")
    length = frames.groupBy(key).agg((F.max("t_ms") + frame_ms).alias("duration"))
    n = len(THRESHOLDS) * len(LEAST_SILENCES)
    length = length.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return regions(runs, length, key, ("idx",))


def choose(found: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, idx, n, target): the first grid point with about as many regions as wanted, else the nearest, the earliest of equals.

    ``found`` is (key, idx, n), with regions too if wanted, and ``targets`` (key, target).
    """
    carried = ["regions"] if "regions" in found.columns else []
    rows = found.join(targets, key).withColumn("_d", F.abs(F.col("n") - F.col("target")))
    near = F.col("_d") <= NEAR_ENOUGH
    order = F.struct((~near).alias("a"), F.when(near, F.lit(0)).otherwise(F.col("_d")).alias("b"), F.col("idx").alias("c"))
    return rows.groupBy(key).agg(F.min_by(F.struct("idx", "n", "target", *carried), order).alias("x")).select(key, "x.*")


def padded(start: Column, end: Column, length: Column, pad: int = PAD_MS, clamp_end: bool = True) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), start - pad), F.least(length, end + pad) if clamp_end else end + pad


def counts_differ(n: Column, target: Column) -> Column:
    return F.abs(n - target) > F.greatest(F.lit(3.0), 0.3 * target)


def segment_all(frames: DataFrame, entries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(segments, status): the chosen regions beside entries in their order, and one row a recording.

    ``entries`` is (key, entry_id, entry_number). status is (key, n, target, mismatch, status): the
    number of segments, 0 without entries, -1 without a readable frame.
    """
    readable = frames.filter("frame_idx >= 0")
    targets = entries.groupBy(key).agg(F.count(F.lit(1)).alias("target"))
    # a grid point's regions travel with it, so that the frames are looked at once
    points = grid_regions(readable, key).groupBy(key, "idx").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("start", "end")).alias("regions"))
    best = choose(points, targets, key)
    length = readable.groupBy(key).agg((F.max("t_ms") + 10).alias("duration"))
    chosen = best.select(key, F.explode("regions").alias("r")).select(key, "r.start", "r.end").join(length, key)
    start, end = padded(F.col("start"), F.col("end"), F.col("duration"))
    r = chosen.withColumn("ordinal", F.row_number().over(W.Window.partitionBy(key).orderBy("start", "end"))).withColumns({"start_ms": start, "end_ms": end})
    e = entries.withColumn("ordinal", F.row_number().over(W.Window.partitionBy(key).orderBy(F.col("entry_number").asc_nulls_first(), "entry_id")))
    made = r.join(e, [key, "ordinal"]).select(key, "entry_id", "ordinal", "start_ms", "end_ms")
    known = frames.select(key).distinct().join(best, key, "left").join(readable.select(key, F.lit(True).alias("_r")).distinct(), key, "left")
    status = F.when(F.col("_r").isNull(), -1).when(F.col("target").isNull(), 0).otherwise(F.least("n", "target"))
    return made, known.drop("regions").select(key, "n", "target", counts_differ(F.col("n"), F.col("target")).alias("mismatch"), status.cast("long").alias("status"))


def segment_catalog(recordings: DataFrame, segments: DataFrame, entries: DataFrame, frames: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segments, status, totals): the pending recordings of a catalog segmented, and its segments with theirs in place of old ones.

    Pending are downloaded word lists without segments, or all of them if ``force``. ``segments`` is (recording_id, entry_id, start_ms,
    end_ms, ...), ``entries`` (recording_id, entry_id, entry_number), ``frames`` as for ``grid_regions``. status is as in ``segment_all``, with -1 for
    pending recordings without a frame. totals is one row: recordings done, new and pre-existing segments, recordings by their status.
    """
    pending = catalog.pending_segmentation(recordings, segments, force).select("recording_id")
    own = lambda df: df.join(pending, "recording_id", "left_semi")
    made, status = segment_all(own(frames), own(entries), "recording_id")
    status = pending.join(status, "recording_id", "left").withColumn("status", F.coalesce("status", F.lit(-1).cast("long")))
    new = made.select("recording_id", "entry_id", "start_ms", "end_ms")
    ended = status.agg(F.count(F.lit(1)).alias("recordings"), F.count_if(F.col("status") > 0).alias("segmented"), F.count_if(F.col("status") == 0).alias("without_segments"), F.count_if(F.col("status") < 0).alias("unreadable"))
    totals = ended.crossJoin(new.agg(F.count(F.lit(1)).alias("new"))).crossJoin(catalog.skipped_segments(recordings, segments).withColumnRenamed("skipped", "pre_existing"))
    return catalog.replace_of(segments, new), status, totals


def trim_edges(frames: DataFrame, key: str, db: float = TRIM_DB) -> DataFrame:
    """(key, first, last): the outermost frames less than ``db`` below the clip's loudest; silent clips have no row."""
    peak = F.max("mean_sq").over(W.Window.partitionBy(key))
    loud = frames.withColumn("_p", peak).filter((F.col("mean_sq") > 0) & (F.col("mean_sq") > F.col("_p") * 10 ** (-db / 10)))
    return loud.groupBy(key).agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"))


def peak_normalized(samples: Column, db: float | None = None) -> Column:
    """Samples divided by their largest size, or scaled so that it is at ``db``; silence stays."""
    peak = F.array_max(F.transform(samples, F.abs))
    scale = F.when(peak > 0, (1.0 if db is None else 10 ** (db / 20)) / peak).otherwise(1.0)
    return F.transform(samples, lambda v: v * scale)


def clip_report(clips: DataFrame, seconds: Column, kept: Column) -> DataFrame:
    """One row: total, kept, filtered, hours, and the mean, median, deviation and range of kept seconds."""
    s = F.when(kept, seconds)
    middle = quantiles(clips.select(s.cast("double").alias("_s")), [], "_s", {"median": 0.5})
    one = clips.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("filtered"), (F.sum(s) / 3600).alias("hours"),
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"),
    )
    return one.crossJoin(F.broadcast(middle))
