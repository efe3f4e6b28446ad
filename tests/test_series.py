"""Windows over series that go in blocks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stemmata.operators import statistics
from stemmata.sources import profiles as readers


def series(spark, n, seed=3):
    """Half of all rows in one series, a null series, null values, an extra column with the operators' own name."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", None]), t, rng.choice([None, *range(20)]), t) for t in rng.sample(range(n * 3), n)]
    return spark.createDataFrame(rows, "s string, t int, x int, n int")


@pytest.mark.parametrize("by", [[], ["s"]])
@pytest.mark.parametrize("window,block", [(5, 3), (1, 1), (8, 4), (101, 7), (4, 10_000)])
def test_moving_average_in_blocks(spark, by, window, block):
    rows = series(spark, 150)
    frame = Window.partitionBy(*by).orderBy("t").rowsBetween(-(window // 2), window // 2)
    plain = {r.t: r.m for r in rows.withColumn("m", F.avg("x").over(frame)).collect()}
    found = statistics.moving_average(rows, "x", ["t"], window, by, block)
    assert found.columns == [*rows.columns, "smoothed"]
    assert sorted((r.t, r.smoothed) for r in found.collect()) == sorted(plain.items())


def test_windows_over_one_series_are_parted(spark):
    plan = statistics.moving_average(series(spark, 40), "x", ["t"], 5)._jdf.queryExecution().executedPlan().toString()
    window = [x for x in plan.splitlines() if "Window [avg" in x]
    assert window and all("__block" in x for x in window)
    assert statistics.moving_average(series(spark, 40).limit(0), "x", ["t"], 5).count() == 0


def test_downsample_by_null_and_hot_series(spark):
    rows = series(spark, 150)
    place = F.row_number().over(Window.partitionBy("s").orderBy("t")) - 1
    plain = rows.withColumn("point", F.floor(place / 7).cast("int")).groupBy("s", "point").agg(F.avg("x").alias("x"))
    key = lambda r: (r.s or "", r.point, r.x if r.x is not None else -1)
    assert sorted(map(key, statistics.downsample(rows, ["x"], ["t"], 7, ["s"]).collect())) == sorted(map(key, plain.collect()))


@pytest.mark.parametrize("block", [1, 3, 65_536])
def test_log_lines_meet_over_blocks_and_gaps(spark, monkeypatch, block):
    monkeypatch.setattr(readers, "LOG_BLOCK", block)
    texts = [(0, "Iteration 0 - Pre-process time (ms): 5"), (1, "Inference time (ms): 50"), (2, "Iteration 1 - Pre-process time (ms): 6"), (90, "Inference time (ms): 60"), (91, "Iteration 2 - Pre-process time (ms): 7, Inference time (ms): 70"), (92, "Iteration 3 - Pre-process time (ms): 8"), (93, None), (94, "Inference time (ms): 80"), (95, "Iteration 4 - Pre-process time (ms): 9")]
    lines = spark.createDataFrame([(f, o, t) for f in ("a", "b") for o, t in texts], "file string, ord bigint, value string")
    found = sorted((r.iteration, r.pre_process_ms, r.inference_ms or -1) for r in readers.parse_runtime_lines(lines).collect())
    assert found == sorted(2 * [(0, 5, 50), (1, 6, 60), (2, 7, 70), (3, 8, -1), (4, 9, -1)])
