"""Inputs that once failed: series of one row or one time, and steps that have a plainer equal form."""

import math

import pandas as pd
from pyspark.sql import functions as F

from sensorframe.operators import linear, series, transient
from sensorframe.plans import q_models
from sensorframe.plans.common import rounded
from sensorframe.sources import views
from sensorframe.streaming import monitors

SF = "/root/testdata/sf0.001"

READINGS = "k string, row_idx long, t_s double, value double"


def test_sampling_of_one_row_and_of_one_time(spark):
    rows = [("one", 1, 5.0, 1.0), ("same", 1, 5.0, 1.0), ("same", 2, 5.0, 2.0), ("same", 3, 5.0, 4.0), ("two", 1, 1.0, 1.0), ("two", 2, 3.0, 1.0)]
    got = {r.k: r for r in rounded(series.sampling_summary(spark.createDataFrame(rows, READINGS), ["k"]), 4).collect()}
    assert math.isnan(got["one"].rate_hz) and got["one"].dt_cv is None and got["one"].duration == 0
    assert got["same"].rate_hz == math.inf and math.isnan(got["same"].dt_cv)
    assert got["two"].rate_hz == 0.5 and got["two"].dt_mean == 2


def test_bootstrap_draws_alike_in_tasks_and_by_joins(spark):
    """Keys drawn from inside a task, across batches of rows, and those whose draws are joined."""
    rows = [(k, None if k == 2 else "a", i, float(i % 7) + 0.01 * i, float((i * 37 + k) % 11), 1.0 + i % 3) for k, n in ((0, 40), (1, 3), (2, 300), (3, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, s string, i int, x double, y double, w double").withColumn("s", F.coalesce("s", F.lit("b")))
    key = ["k", "s"]
    r = linear.expand(df, [linear.Model("one", ("x",), prior=(0.5, 0.1))], "y", "w", [*key, "i"])
    fits = linear.fit(r, key).localCheckpoint()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got, want, half = ([tuple(x) for x in linear.bootstrap(r, fits, key, F.floor(F.col("i") / 8), ["i"], replicates=30, together=t).orderBy("k").collect()] for t in (10**6, 0, 30))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) == len(half) == 4
    for a, b, c in zip(got, want, half, strict=True):
        assert a[:3] == b[:3] == c[:3] and all(y is None if x is None else math.isclose(x, y, rel_tol=1e-9) and math.isclose(x, z, rel_tol=1e-9) for x, y, z in zip(a[3:], b[3:], c[3:], strict=True))


def test_observations_are_dealt_once(spark):
    """Fits with validation shuffle observations by series, and exploded rows only as sums of folds."""
    plan = linear.fit_and_validate(q_models.rows(spark, SF), q_models.KEY, ["level"])._jdf.queryExecution().executedPlan().toString()
    dealt = {line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(series" in line and "place" not in line}
    assert plan.count("Exchange hashpartitioning(") <= 3 and dealt <= {"series"}


def test_matcher_waits_with_one_timer_a_key():
    class Kept:
        def __init__(self):
            self.rows = []

        def getListState(self, name, schema):
            return self

        def appendList(self, rows):
            self.rows += rows

        def registerTimer(self, at):
            self.at = [*getattr(self, "at", []), at]

    m, handle = monitors.OrderedMatcher(["k", "li", "ri", "d"], 5.0), Kept()
    m.init(handle)
    list(m.handleInputRows((1,), iter([pd.DataFrame({"side": ["l", "l", "r", "l"], "id": [1, 2, 3, 4], "x": [9.0, 7.0, 1.0, 8.0]})]), None))
    assert handle.at == [12001] and len(handle.rows) == 4


def test_conflicts_are_held_without_python(spark, tmp_path):
    spark.createDataFrame([(1, 1, 5.0, 1.0)], READINGS.replace("k string", "k long")).withColumn("ts", F.timestamp_seconds("t_s")).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    assert "Pandas" not in monitors.part_conflicts(live, ["k"], "1 hour")._jdf.queryExecution().analyzed().toString()


def test_lags_meet_in_one_pass(spark):
    rows = [(k, i, float(i), float((i * 7 + len(k)) % 5)) for k, n in (("one", 1), ("four", 4), ("thirty", 30)) for i in range(n)]
    df = spark.createDataFrame(rows + [("flat", i, float(i), 2.0) for i in range(3)], READINGS)
    out = series.lag_pairs(df, ["k"], 6)
    want = {}
    for k in ("four", "thirty"):
        v = [r[3] for r in rows if r[0] == k]
        c = [x - sum(v) / len(v) for x in v]
        want |= {(k, j): sum(a * b for a, b in zip(c, c[j:], strict=False)) / sum(x * x for x in c) for j in range(min(7, len(v)))}
    got = {(r.k, r.lag): r.acf for r in out.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in want)
    assert "sequence(" not in out._jdf.queryExecution().analyzed().toString()


def test_crossings_of_slow_curves_are_made_in_batches(spark):
    assert "sequence(" not in spark.range(1).select(F.lit(1.0).alias("tau_slow"), *(F.lit(1.0).alias(c) for c in ("tau_fast", "duration", "beta", "a_fast", "a_slow", "drift", "e_infinity"))).select(transient.time_to_fraction(0.9))._jdf.queryExecution().analyzed().toString()


def test_still_series_have_no_ratios(spark):
    df = spark.createDataFrame([("still", i, 5.0, 0.0) for i in range(3)], READINGS)
    r = series.residual_summary(df, ["k"], ["t_s", "row_idx"], "value").first()
    assert r.durbin_watson is None and r.lag1 is None and r.runs == 1 and series.regularity(df, ["k"], 0.9).first().regular is False


def test_sums_in_the_order_of_the_file(spark, tmp_path):
    """Means that lie on a limit are told by the order of addition: that of the file, whatever its splits."""
    v = [(float(i % 4), 0.01 * ((i * 7919) % 11)) for i in range(20_000)]
    spark.createDataFrame(v, "k double, v double").coalesce(1).write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        t = spark.read.parquet(str(tmp_path / "t"))
        assert t.rdd.getNumPartitions() > 3
        got = dict(views.in_order(t.select("k", "v"), ["k"]).groupBy("k").agg(F.sum("v")).collect())
        plain = dict(t.groupBy("k").agg(F.sum("v")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for k, x in v:
        want[k] = want.get(k, 0.0) + x
    assert got == want != plain
