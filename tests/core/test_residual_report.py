"""The residual report reads its rows from one shuffle, and equals its parts."""

import math
import random

from pyspark.sql import functions as F

from sensorframe.operators import jobs, series
from sensorframe.plans import q_jobs

SF = "/root/testdata/sf0.001"


def shuffles(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_residuals_are_shuffled_once_and_reported_as_by_parts(spark):
    rng = random.Random(3)
    rows = [("s", k, i, float(i // 2) if k else 7.0, rng.gauss(0, 1) if k < 5 else 0.25) for k in range(7) for i in range(1 if k == 6 else 40)]
    rows += [("s", 1, 99, 5.0, None), ("s", 2, 99, 5.0, float("nan")), (None, 2, 1, 1.0, 1.0), ("s", 3, 98, None, 0.5)]
    d = spark.createDataFrame(rows, "source string, record int, row_idx int, t_s double, r double").repartition(3).cache()
    report = jobs.residual_report(d)
    assert len(shuffles(report)) == 1
    got = {r.record: r for r in report.collect()}
    d, key = d.where("source IS NOT NULL AND r IS NOT NULL AND NOT isnan(r)"), ["source", "record"]
    want = series.residual_summary(d, key, ["t_s", "row_idx"], still=math.nan)
    want = want.join(series.ols(d.select(*key, F.col("t_s").alias("x"), F.col("r").alias("y")), key).select(*key, "slope"), key, "left")
    want = want.join(series.hampel(d.withColumnRenamed("r", "value"), key, 7, 3.0).groupBy(key).agg(F.avg(F.col("spike").cast("double")).alias("share")), key).collect()
    same = lambda a, b: (a is None and b is None) or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)))
    assert len(want) == len(got) == 7
    for w in want:
        g = got[w.record]
        assert (w.n, w.runs) == (g.n, g.runs) and all(same(x, y) for x, y in ((w.durbin_watson, g.durbin_watson), (w.lag1, g.lag1), (w.slope, g.drift), (w.share, g.spike_share)))


def test_calibrations_are_not_shuffled_exploded(spark):
    """Residuals of calibrations lie by series: the report shuffles none, and by model go only the sums of each fit."""
    _, b = q_jobs.residuals(spark, SF)
    assert len(shuffles(jobs.residual_report(b))) == len(shuffles(b))
    assert len([x for x in shuffles(b) if "hashpartitioning(series" in x and ", model" in x]) <= 1
