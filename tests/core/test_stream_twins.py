"""Streams of shuffled micro-batches against their batch twins."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import assess, estimation
from sensorframe.streaming import monitors
from tests.core.test_streaming import run

KEY = ["sensor_id"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Rows of three sensors in four files, out of order within half an hour, some repeated and some with conflicting values; a last row far
    ahead lets the watermark pass all others."""
    rng, rows = random.Random(8), []
    for i in range(400):
        sensor, t = rng.randrange(3), float(rng.randrange(10_000, 30_000, 10))
        rows.append((sensor, i, t, float(rng.randrange(4)), rng.choice("lr")))
    rows.sort(key=lambda r: r[2] + rng.uniform(0, 1500))
    rows += [(s, 1000 + s, 90_000.0, 0.0, "l") for s in range(3)]
    path = str(tmp_path_factory.mktemp("twins"))
    df = spark.createDataFrame(rows, "sensor_id bigint, row_idx bigint, t_s double, value double, side string").withColumn("ts", F.timestamp_seconds("t_s"))
    for lo in (0, 120, 250, 350):
        ids = [r[1] for r in rows[lo : {0: 120, 120: 250, 250: 350, 350: 403}[lo]]]
        df.where(F.col("row_idx").isin(ids)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    return path


def source(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_conflicts(spark, folder, tmp_path):
    live = run(spark, monitors.part_conflicts(source(spark, folder), KEY, "1 hour"), tmp_path, "conflicts")
    kept, bad = assess.part_conflicts(spark.read.parquet(folder).where("t_s < 80000"), KEY)
    want = {(r.row_idx, "kept") for r in kept.collect()} | {(r.row_idx, "quarantined") for r in bad.collect()}
    got = [(r.row_idx, r.fate) for r in live.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {f for _, f in want} == {"kept", "quarantined"}


def test_matcher(spark, folder, tmp_path):
    x = lambda df: df.select("sensor_id", "side", F.col("row_idx").alias("id"), F.col("t_s").alias("x"), "ts")
    live = run(spark, monitors.match_ordered(x(source(spark, folder)), KEY, 300.0, "1 hour"), tmp_path, "matches")
    rows = x(spark.read.parquet(folder)).where("x < 80000")
    batch = estimation.match_ordered(rows.where("side = 'l'"), rows.where("side = 'r'"), KEY, 300.0)
    pick = lambda df: sorted((r.sensor_id, r.li, r.ri, round(r.d, 9)) for r in df.collect())
    assert pick(live) == pick(batch) and len(pick(batch)) > 50


def test_monitor_equals_batch(spark, folder, tmp_path):
    live = run(spark, monitors.sampling_monitor(source(spark, folder), KEY, "10 minutes", "1 hour"), tmp_path, "monitored")
    w = F.floor(F.col("t_s") / 600)
    batch = spark.read.parquet(folder).where("t_s < 80000").groupBy(*KEY, w.alias("w")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), ((F.max("t_s") - F.min("t_s")) / F.greatest(F.count("*") - 1, F.lit(1))).alias("dt"))
    want = sorted((r.sensor_id, r.w, r.n, r.lo, r.hi, round(r.dt, 9)) for r in batch.collect())
    got = sorted((r.sensor_id, int(r.start.timestamp()) // 600, r.n, r.v_min, r.v_max, round(r.dt_mean, 9)) for r in live.withColumn("start", F.col("start").cast("timestamp")).collect())
    assert [g for g in got if g[1] < 130] == want
