"""Means of two-digit decimals that lie exactly on a limit: both engines add them in the order of the file."""

import math
import random

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from sensorframe.operators import jobs, series

WEEK0, DAY = 2818 * 7, 86400
#: Per channel what its rows have to add up to, in cents, given the first of them: limits of 20, 1.96 * 20 and 55 are met exactly.
LIMITS = {"click": lambda first: 12 * (first + 2000), "view": lambda first: 12 * (first + 3920), "purchase": lambda first: 12 * 5500}


def tied(sensors: int) -> pd.DataFrame:
    """Twelve rows a series over three weeks."""
    rng, rows = random.Random(7), []
    for k in range(sensors):
        for channel in ("click", "view", "error", "purchase", "signup"):
            v = [rng.randrange(500, 4000) for _ in range(12)]
            if channel in LIMITS:
                v[-1] += LIMITS[channel](v[0]) - sum(v)
            rows += [(k, channel, (WEEK0 + 7 * (i // 4) + i % 4) * DAY + 60 * i + k, x / 100) for i, x in enumerate(v)]
    head = [r for i, r in enumerate(rows) if i % 12 == 0]
    rest = [r for i, r in enumerate(rows) if i % 12]
    rng.shuffle(rest)
    df = pd.DataFrame(head + rest, columns=["user_id", "event_type", "t", "value"])
    return df.assign(event_id=range(len(df)), ts=pd.to_datetime(df.pop("t"), unit="s").astype("datetime64[us]"))


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("ties"))
    pq.write_table(pa.Table.from_pandas(tied(60), preserve_index=False), f"{d}/events.parquet", row_group_size=200)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    yield d
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("name", ["d21_residual_summary", "d33_truth_errors", "e14_convergence_time", "i03_rule_operators", "i04_rules_with_trends"])
def test_ties_fall_as_in_sql(spark, ties, name):
    found = entry.queries()[name](spark, ties)
    assert spark.read.parquet(f"{ties}/events.parquet").rdd.getNumPartitions() > 3
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{ties}/events.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    key = lambda row: tuple(map(repr, row))
    assert sorted(map(key, found.select(columns).collect())) == sorted(map(key, want.fetchall()))


def test_still_residuals_have_ratios_that_are_no_numbers(spark):
    rows = [(k, i, float(i), v) for k, n, v in (("zero", 3, 0.0), ("equal", 3, 2.0), ("one", 1, 2.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, row_idx long, t_s double, r double")
    got = {r.k: r for r in series.residual_summary(df, ["k"], ["t_s", "row_idx"], still=math.nan).collect()}
    assert math.isnan(got["zero"].durbin_watson) and math.isnan(got["zero"].lag1)
    assert got["equal"].durbin_watson == 0 and math.isnan(got["equal"].lag1)
    assert got["one"].durbin_watson is None
    report = {r.record: r for r in jobs.residual_report(df.selectExpr("'s' AS source", "k AS record", "row_idx", "t_s", "r")).collect()}
    assert math.isnan(report["zero"].durbin_watson) and math.isnan(report["equal"].lag1)
