"""Following training logs that grow: what each batch says of a run is kept, nothing is read twice."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import trainlog

METRICS = "map<string,double>"
#: What a batch says of a run: whether it opens records and the step of the last, the metrics before its first one (of the record that was open), those of the last record, the last one
#: before that with any, the last values of the watched metric in records that were closed and how many there were.
PART = f"run string, opened boolean, step long, head {METRICS}, open {METRICS}, last struct<step:long,metrics:{METRICS}>, recent array<double>, n long"
#: Every so many batches, one holds all that came before it too.
FOLDED = 32


def told(lines: DataFrame) -> DataFrame:
    """(run, line_no, step, name, value) of the lines (run, line_no, line) that open a record or have a metric."""
    step, name, value = trainlog.parsed("line")
    return lines.select(F.col("run").cast("string").alias("run"), "line_no", step.alias("step"), name.alias("name"), value.alias("value")).filter("step is not null or name <> ''")


def flat(values: list[float], n: int, window: int, threshold: float) -> bool:
    """Whether the last ``window`` of n values are hardly below those before them; ``values`` are the last 2 windows of them at most."""
    if n < window:
        return False
    recent = values[-window:]
    older = values[-2 * window : -window] if n >= 2 * window else values[:window]
    was = sum(older) / window
    return (was - sum(recent) / window) / was < threshold if was > 0 else 0 < threshold


def _last_of(values: Column, most: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - (most - 1)), F.lit(most))


def _flat(values: Column, n: Column, window: int, threshold: float) -> Column:
    """As ``flat``; ``values`` are 2 windows at most."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / window
    was, now = mean(F.slice(values, 1, window)), mean(_last_of(values, window))
    return (n >= window) & F.when(was > 0, (was - now) / was < threshold).otherwise(0 < threshold)


def parts(lines: DataFrame, name: str = "loss_mel", window: int = trainlog.WINDOW) -> DataFrame:
    """PART of each run of a batch of lines (run, line_no, line), whatever came before them; inside a batch lines may be in any order."""
    w = W.Window.partitionBy("run")
    so_far = w.orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = told(lines).select("run", "line_no", F.count("step").over(so_far).alias("k"), F.last("step", ignorenulls=True).over(so_far).alias("step"), F.when(F.col("step").isNull(), F.col("name")).alias("name"), "value")
    each = rows.groupBy("run", "k", "step", "name").agg(F.max_by("value", "line_no").alias("value"))
    listed = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
    records = each.groupBy("run", "k", "step").agg(F.map_from_entries(listed).alias("metrics")).withColumn("_end", F.max("k").over(w))
    closed = (F.col("k") > 0) & (F.col("k") < F.col("_end"))
    records = records.withColumn("_v", F.when(closed, F.try_element_at("metrics", F.lit(name))))
    records = records.withColumn("_back", F.count("_v").over(w.orderBy(F.desc("k")).rowsBetween(W.Window.unboundedPreceding, 0)))
    empty = F.create_map().cast(METRICS)
    one = lambda test: F.coalesce(F.first(F.when(test, F.col("metrics")), ignorenulls=True), empty)
    recent = F.array_sort(F.collect_list(F.when(F.col("_v").isNotNull() & (F.col("_back") <= 2 * window), F.struct("k", "_v"))))
    return records.groupBy("run").agg(
        (F.max("k") > 0).alias("opened"), F.max_by("step", "k").alias("step"), one(F.col("k") == 0).alias("head"), one((F.col("k") > 0) & (F.col("k") == F.col("_end"))).alias("open"),
        F.max_by(F.struct("step", "metrics"), F.when(closed & (F.size("metrics") > 0), F.col("k"))).alias("last"), F.transform(recent, lambda x: x["_v"]).alias("recent"), F.count("_v").alias("n"),
    )


def together(kept: DataFrame, name: str = "loss_mel", window: int = trainlog.WINDOW) -> DataFrame:
    """PART of each run for all batches of ``kept`` (PART, batch), one after the other; what comes before the first step is lost."""
    state = F.struct("opened", "step", "head", "open", "last", "recent", "n")
    start = F.from_json(F.lit('{"opened": false, "head": {}, "open": {}, "recent": [], "n": 0}'), PART.removeprefix("run string, "))

    def after(s: Column, x: Column) -> Column:
        part = x["part"]
        now = F.when(s["opened"], F.map_concat(F.map_filter(s["open"], lambda k, _: ~F.map_contains_key(part["head"], k)), part["head"])).otherwise(s["open"])
        value = F.try_element_at(now, F.lit(name))
        last = F.coalesce(part["last"], F.when(F.size(now) > 0, F.struct(s["step"].alias("step"), now.alias("metrics"))), s["last"])
        recent = _last_of(F.concat(s["recent"], F.filter(F.array(value), lambda v: v.isNotNull()), part["recent"]), 2 * window)
        n = s["n"] + part["n"] + F.when(value.isNull(), 0).otherwise(1)
        closed = F.struct(F.lit(True).alias("opened"), part["step"].alias("step"), s["head"].alias("head"), part["open"].alias("open"), last.alias("last"), recent.alias("recent"), n.alias("n"))
        going = F.struct(s["opened"].alias("opened"), s["step"].alias("step"), s["head"].alias("head"), now.alias("open"), s["last"].alias("last"), s["recent"].alias("recent"), s["n"].alias("n"))
        return F.when(part["opened"], closed).otherwise(going)

    # maps have no order, so that batches are sorted by their numbers alone
    ordered = F.array_sort(F.collect_list(F.struct("batch", state.alias("part"))), lambda a, b: F.when(a["batch"] < b["batch"], -1).otherwise(1))
    return kept.groupBy("run").agg(F.aggregate(ordered, start, after).alias("x")).select("run", "x.*")


def run(spark: SparkSession, lines_dir: str, top: str, files_per_batch: int = 16, name: str = "loss_mel", window: int = trainlog.WINDOW, threshold: float = trainlog.IMPROVEMENT) -> DataFrame:
    """Take in the line files (run, line_no, line) that are new below ``lines_dir``, in order of their time, and return ``latest`` of ``top``.

    Lines come in order from batch to batch. A batch's parts are a folder of its own number, so that a batch which runs again changes nothing. Where a log is cut
    into batches doesn't matter. What is kept of a run doesn't grow with its log: FOLDED parts at most are read, each of three records and 2 windows of values.
    """

    def store(lines: DataFrame, number: int) -> None:
        news = parts(lines, name, window)
        if number and number % FOLDED == 0:
            before = _kept(lines.sparkSession, top, number - FOLDED).filter(F.col("batch") < number)
            news = together(before.unionByName(news.withColumn("batch", F.lit(number).cast("long"))), name, window)
        news.write.mode("overwrite").parquet(f"{top}/parts/batch={number}")

    stream = spark.readStream.schema(spark.read.parquet(lines_dir).schema).option("maxFilesPerTrigger", files_per_batch).parquet(lines_dir)
    query = stream.writeStream.foreachBatch(store)
    query.option("checkpointLocation", f"{top}/offsets").trigger(availableNow=True).start().awaitTermination()
    return latest(spark, top, name, window, threshold)


def _kept(spark: SparkSession, top: str, first: int = 0) -> DataFrame:
    """The stored parts from batch ``first`` on: (PART, batch)."""
    schema = f"{PART}, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{top}/parts").filter(F.col("batch") >= first)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def latest(spark: SparkSession, top: str, name: str = "loss_mel", window: int = trainlog.WINDOW, threshold: float = trainlog.IMPROVEMENT) -> DataFrame:
    """(run string, step, losses map, plateau): the last record of each run, as ``trainlog.latest`` has it; runs whose last record has no loss_ metric have no row."""
    newest = _kept(spark, top).agg(F.max("batch")).first()[0] or 0
    s = together(_kept(spark, top, newest // FOLDED * FOLDED), name, window)
    value = F.try_element_at("open", F.lit(name))
    values = _last_of(F.concat("recent", F.filter(F.array(value), lambda v: v.isNotNull())), 2 * window)
    shown = F.when(F.size("open") > 0, F.struct("step", F.col("open").alias("metrics"))).otherwise(F.col("last"))
    s = s.select("run", shown.alias("x"), _flat(values, F.col("n") + F.when(value.isNull(), 0).otherwise(1), window, threshold).alias("plateau"))
    losses = F.map_from_entries(F.array_sort(F.map_entries(F.map_filter("x.metrics", lambda k, _: k.startswith("loss_")))))
    return s.select("run", "x.step", losses.alias("losses"), "plateau").filter(F.size("losses") > 0)
