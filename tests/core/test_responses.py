"""Response fits: all of the grid is tried, and short and long segments are fitted alike."""

import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from sensorframe.operators import transient


def test_features_of_responses_slower_than_their_window(spark, tmp_path):
    """Time constants of 5, 2.5 and 0.3 windows lie inside the grid, which once ended at 1 and took one finer round."""
    rng, rows = np.random.default_rng(11), []
    for user, tau in ((1, 5000.0), (2, 2500.0), (3, 300.0)):
        t = np.sort(rng.uniform(1, 1000, 30)).round(3)
        rows += [(user, "error", 0.0, 1.0)] + [(user, "click", x, 10 + 50 * math.exp(-x / tau)) for x in t]
    df = pd.DataFrame(rows, columns=["user_id", "event_type", "t", "value"])
    df = df.assign(event_id=range(len(df)), ts=pd.to_datetime(1.7e9 + df.pop("t"), unit="s").astype("datetime64[us]"))
    pq.write_table(pa.Table.from_pandas(df, preserve_index=False), tmp_path / "events.parquet")
    found = entry.queries()["g13_response_features"](spark, str(tmp_path))
    single = {r.sensor_id: r for r in found.where("model = 'single'").collect()}
    span = {u: x.max() - x.min() for u, x in df.groupby("user_id")["ts"].apply(lambda x: x.astype("int64") / 1e6).groupby(level=0)}
    for user, tau in ((1, 5000.0), (2, 2500.0), (3, 300.0)):
        assert math.isclose(single[user].t63 * span[user], tau, rel_tol=0.01) and single[user].long_time_constant == (tau > span[user])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = {(r[0], r[1]): r for r in con.execute(entry.oracle_sql()["g13_response_features"]).fetchall()}
    assert len(want) == found.count() and all(math.isclose(want[u, "single"][4], r.t63, abs_tol=1e-3) for u, r in single.items())


def test_segments_in_tasks_and_by_rounds_are_fitted_alike(spark):
    """Segments of many lengths, across batches of rows; those beyond ``together`` points are exploded."""
    rng, rows = np.random.default_rng(5), []
    for k, n in enumerate((4, 5, 6, 7, 8, 9, 13, 40, 300)):
        t = np.sort(rng.uniform(0, 100, n))
        rows += [(k, "a", float(x), float(y)) for x, y in zip(t, 3 * np.exp(-t / 20) + rng.normal(size=n) * 0.3)]
    rows += [(None, "a", float(i), 1.0 * i * i) for i in range(9)] + [(20, "a", 0.0, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "k int, s string, local double, v double").repartition(3).cache()
    grid = transient.Grid(high=0.0, steps=5, betas=(0.5, 0.8), rounds=1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        want, half, none = (sorted(map(tuple, transient.fit_responses(df, ["k", "s"], grid=grid, together=n).collect())) for n in (1 << 16, 20, 0))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r[:4] for r in want] == [r[:4] for r in half] == [r[:4] for r in none] and {r[0] for r in want} == set(range(1, 9))
    for a, b, c in zip(want, half, none, strict=True):
        assert all(x == y == z or (math.isclose(x, y, rel_tol=1e-6) and math.isclose(x, z, rel_tol=1e-6)) for x, y, z in zip(a[4:], b[4:], c[4:], strict=True))


def test_short_segments_are_not_exploded(spark):
    df = spark.createDataFrame([(1, float(i), float(i % 3)) for i in range(12)], "k int, local double, v double")
    assert "explode" not in transient.fit_responses(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
