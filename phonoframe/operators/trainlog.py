"""Training logs as records of metrics, and what they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ipa
from .ranking import quantiles

#: Points of a plot, the widest moving average, the plateau's window and threshold.
POINTS, WIDEST, WINDOW, IMPROVEMENT = 1000, 50, 1000, 0.01


# Fixed values in what follows: how a log writes steps and metrics.


def parsed(line: str, average: bool = True) -> tuple[Column, Column, Column]:
    """The step that a line opens, or null; the name of its metric, or nothing; its value."""
    step = F.regexp_extract(line, r"GLOBAL_STEP:\s*(\d+)", 1)
    name = r"\| > ((?:avg_)?loss_\w+):\s*([\d.]+)" if average else r"\| > (loss_\w+):\s*([\d.]+)"
    return F.when(step != "", step.cast("long")), F.regexp_extract(line, name, 1), F.regexp_extract(line, name, 2).try_cast("double")


def records(lines: DataFrame, average: bool = True) -> DataFrame:
    """(run, rec, step, name, value) of (run, line_no, line).

    A GLOBAL_STEP line opens a record; of its lines ``| > name: value`` with loss_ names (avg_loss_ ones too if ``average``) the last of a name counts. What
    comes before the first step is lost, and an exponent is cut off.
    """
    step, name, value = parsed("line", average)
    w = W.Window.partitionBy("run").orderBy("line_no").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = lines.select("run", "line_no", step.alias("_step"), name.alias("name"), value.alias("value")).filter("_step is not null or name <> ''")
    rows = rows.withColumns({"rec": F.count("_step").over(w), "step": F.last("_step", ignorenulls=True).over(w)}).filter("rec > 0 and _step is null")
    return rows.groupBy("run", "rec", "step", "name").agg(F.max_by("value", "line_no").alias("value"))


def wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row a record with a column for each of the names."""
    return rows.groupBy("run", "rec", "step").pivot("name", names).agg(F.first("value"))


def evaluations(rows: DataFrame, names: list[str], marker: str = "avg_loss_mel") -> DataFrame:
    """Records that have the marker; other metrics they lack are 0."""
    return wide(rows, names).filter(F.col(marker).isNotNull()).fillna(0, names)


def improvement(rows: DataFrame, name: str) -> DataFrame:
    """(run, pct): from the first to the last value of a metric; null for fewer than two or a first one not over 0."""
    x = rows.filter((F.col("name") == name) & F.col("value").isNotNull()).groupBy("run").agg(F.min_by("value", "rec").alias("a"), F.max_by("value", "rec").alias("b"), F.count(F.lit(1)).alias("n"))
    return x.select("run", F.when((F.col("n") >= 2) & (F.col("a") > 0), (F.col("a") - F.col("b")) / F.col("a") * 100).alias("pct"))


def subsample(rows: DataFrame, points: int = POINTS) -> DataFrame:
    """(run, name, k, rec, value): of longer series ``points`` evenly spaced ones, first and last included."""
    w = W.Window.partitionBy("run", "name")
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy("rec")) - 1, "_n": F.count(F.lit(1)).over(w)})
    spacing = (F.col("_n") - 1) / float(points - 1)
    # the least k whose point isn't before i, and whether it is i itself
    k = F.when(F.col("_n") <= points, F.col("_i")).otherwise(F.ceil(F.col("_i") / spacing))
    near = F.explode(F.filter(F.array(*[(k + d).cast("long") for d in (-1, 0, 1)]), lambda c: (c >= 0) & (c < points)))
    at = F.when(F.col("k") == points - 1, F.col("_n") - 1).otherwise((F.col("k") * spacing).cast("long"))
    short = placed.filter(F.col("_n") <= points).withColumn("k", F.col("_i").cast("long"))
    long_ = placed.filter(F.col("_n") > points).withColumn("k", near).filter(at == F.col("_i"))
    return short.unionByName(long_).select("run", "name", "k", "rec", "value")


def moving_average(series: DataFrame, widest: int = WIDEST) -> DataFrame:
    """(run, name, k, value): trailing means over min(widest, n div 5) points of series of over 20, without the first ones."""
    w = W.Window.partitionBy("run", "name")
    value = F.coalesce("value", F.lit(0.0))
    # widths are 1, 4 and up to the widest; a long series has the widest, a frame of the window's own, and short ones look into a list of their few points
    s = series.withColumn("_n", F.count(F.lit(1)).over(w))
    width = F.when(F.col("_n") > 20, F.least(F.lit(widest), F.floor(F.col("_n") / 5))).otherwise(1).cast("int")
    s = s.withColumns({"_w": width, "_v": value})
    full = s.filter(F.col("_w") == widest).withColumn("_m", F.sum("_v").over(w.orderBy("k").rowsBetween(1 - widest, 0)))
    few = s.filter(F.col("_w") < widest).withColumn("_last", F.collect_list("_v").over(w.orderBy("k").rowsBetween(2 - widest, 0)))
    few = few.withColumn("_m", F.aggregate(F.slice("_last", F.greatest(F.lit(1), F.size("_last") - F.col("_w") + 1), F.col("_w")), F.lit(0.0), lambda a, v: a + v))
    both = full.unionByName(few.drop("_last")).filter(F.col("k") >= F.col("_w") - 1)
    return both.select("run", "name", "k", (F.col("_m") / F.col("_w")).alias("value"))


def axis_limits(series: DataFrame) -> DataFrame:
    """(run, name, low, high): the 5th and 95th percentiles with a margin, low not under 0."""
    p = quantiles(series, ["run", "name"], "value", {"a": 0.05, "b": 0.95})
    margin = 0.3 * (F.col("b") - F.col("a"))
    return p.select("run", "name", F.greatest(F.lit(0.0), F.col("a") - margin).alias("low"), (F.col("b") + margin).alias("high"))


def plateaus(rows: DataFrame, name: str = "loss_mel", window: int = WINDOW, threshold: float = IMPROVEMENT) -> DataFrame:
    """(run, plateau): whether the last ``window`` values are hardly below those before them."""
    w = W.Window.partitionBy("run")
    s = rows.filter((F.col("name") == name) & F.col("value").isNotNull()).withColumns({"_back": F.row_number().over(w.orderBy(F.desc("rec"))), "_n": F.count(F.lit(1)).over(w)})
    recent = F.col("_back") <= window
    older = F.when(F.col("_n") >= 2 * window, F.col("_back").between(window + 1, 2 * window)).otherwise(F.col("_back") > F.col("_n") - window)
    m = s.groupBy("run").agg(F.max("_n").alias("n"), F.avg(F.when(recent, F.col("value"))).alias("r"), F.avg(F.when(older, F.col("value"))).alias("o"))
    gain = F.when(F.col("o") > 0, (F.col("o") - F.col("r")) / F.col("o")).otherwise(0)
    return m.select("run", F.when(F.col("n") < window, False).otherwise(gain < threshold).alias("plateau"))


def step_report(last: DataFrame, samples: DataFrame, at: Column) -> DataFrame:
    """(run, report): a run's last record as JSON: timestamp, step, losses, plateau, names of its samples in order.

    ``last`` is as from ``latest``, ``samples`` (run, name).
    """
    names = samples.groupBy("run").agg(F.array_sort(F.collect_set("name")).alias("samples"))
    rows = last.join(names, "run", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return rows.select("run", F.to_json(F.struct(at.alias("timestamp"), "step", "losses", "plateau", "samples")).alias("report"))


def latest_artefact(paths: DataFrame) -> DataFrame:
    """(run, step, path): of each run's files the one of the largest step, of equals the last by name."""
    step = ipa.artefact_step(F.col("path"))
    return paths.groupBy("run").agg(F.max(step).alias("step"), F.max_by("path", F.struct(step, "path")).alias("path"))


def latest_run(paths: DataFrame) -> DataFrame:
    """One row: the last run by name."""
    return paths.agg(F.max("run").alias("run"))


def latest(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """(run, step, losses map, plateau): the last record of each run."""
    last = rows.groupBy("run").agg(F.max("rec").alias("rec"))
    now = rows.join(last, ["run", "rec"]).filter(F.col("name").startswith("loss_"))
    made = now.groupBy("run", "step").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("losses"))
    return made.join(flags, "run", "left").withColumn("plateau", F.coalesce("plateau", F.lit(False)))
