"""Following logs that grow: wherever a log is cut, the result is that of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from phonoframe.operators import trainlog
from phonoframe.streaming import logs

SCHEMA = "run string, line_no long, line string"


def log(run, seed, n):
    r = random.Random(seed)
    lines, step = [], 0
    for i in range(n):
        step += r.randrange(3)
        kind = r.randrange(6)
        text = f" > GLOBAL_STEP: {step}" if kind == 0 else f"   | > loss_mel: {r.choice([str(round(r.random(), 3)), '1.2.3', '5e-05', '7'])}" if kind < 3 else f"   | > {r.choice(['loss_kl', 'avg_loss_mel', 'other'])}: {r.random():.2f}" if kind < 5 else "noise"
        lines.append((run, i, text))
    return lines


def whole(spark, lines, window):
    r = trainlog.records(spark.createDataFrame(lines, SCHEMA))
    return shown(trainlog.latest(r, trainlog.plateaus(r, window=window)))


def shown(df):
    return {x["run"]: (x["step"], x["losses"], x["plateau"]) for x in df.collect()}


@pytest.mark.parametrize("window", [2, 5])
def test_any_cut_gives_the_whole(spark, tmp_path, window):
    runs = [log("a", 1, 120), log("b", 2, 60), log("c", 3, 3), [("d", 0, "noise")], [("e", i, f" > GLOBAL_STEP: {i}") for i in range(5)], log("f", 6, 200)]
    r = random.Random(window)
    cuts = {x[0][0]: sorted(r.sample(range(len(x)), min(3, len(x)))) + [len(x)] for x in runs}
    for k in range(4):
        part = [x for lines in runs for x in lines if (cuts[x[0]][k - 1] if 0 < k < len(cuts[x[0]]) + 1 else 0) <= x[1] < (cuts[x[0]][k] if k < len(cuts[x[0]]) else 0)]
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/lines")
        got = shown(logs.run(spark, f"{tmp_path}/lines", f"{tmp_path}/top", window=window))
        so_far = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/lines").collect()]
        assert got == whole(spark, so_far, window)
    assert len(so_far) == sum(map(len, runs))
    assert shown(logs.run(spark, f"{tmp_path}/lines", f"{tmp_path}/top", window=window)) == got  # nothing is new


def test_what_is_kept_does_not_grow():
    assert logs.flat([1.0] * 4, 100, 2, 0.01) and not logs.flat([4.0, 3.0, 2.0, 1.0], 4, 2, 0.01)
    assert not logs.flat([1.0], 1, 2, 0.01) and logs.flat([0.0, 0.0], 2, 2, 0.01)


def test_no_lines(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/lines")
    assert logs.run(spark, f"{tmp_path}/lines", f"{tmp_path}/top").filter(F.col("run").isNotNull()).count() == 0


def test_many_batches_are_folded(spark, tmp_path, monkeypatch):
    """Every so many batches one holds all before it; no run meets Python."""
    monkeypatch.setattr(logs, "FOLDED", 3)
    lines = [x for run, seed, n in [("a", 1, 120), ("b", 2, 60), ("f", 6, 200)] for x in log(run, seed, n)]
    for first in range(0, 200, 25):
        part = [x for x in lines if first <= x[1] < first + 25]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/lines")
        got = shown(logs.run(spark, f"{tmp_path}/lines", f"{tmp_path}/top", files_per_batch=1, window=2))
        assert got == whole(spark, [x for x in lines if x[1] < first + 25], 2)
    assert "Python" not in logs.parts(spark.read.parquet(f"{tmp_path}/lines"))._jdf.queryExecution().toString()


def test_flat_as_an_expression(spark):
    rows = [([4.0, 3.0, 2.0, 1.0], 4), ([1.0] * 4, 100), ([1.0], 1), ([0.0, 0.0], 2), ([5.0, 5.0, 5.0], 3), ([], 0), ([5.0, 4.9, 4.97], 3)]
    got = spark.createDataFrame(rows, "v array<double>, n long").select("v", "n", logs._flat(F.col("v"), F.col("n"), 2, 0.01).alias("x")).collect()
    assert [r["x"] for r in got] == [logs.flat(r["v"], r["n"], 2, 0.01) for r in got]
