"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import estimation, series
from sensorframe.streaming import monitors

KEY = ["sensor_id"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream"))
    r = spark.range(400).select((F.col("id") % 3).alias("sensor_id"), F.col("id").alias("row_idx"), (F.col("id") * 10.0 - F.when(F.col("id") % 50 == 49, 300.0).otherwise(0.0)).alias("t_s"), ((F.col("id") * 37) % 11 + F.when(F.col("id") % 40 == 0, 100.0).otherwise(0.0)).cast("double").alias("value"))
    r = r.withColumn("ts", F.timestamp_seconds(F.col("t_s") + 1704067200))
    for lo in (0, 150, 300):  # three files, read one per micro-batch
        r.where((F.col("row_idx") >= lo) & (F.col("row_idx") < lo + 150)).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def source(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_segments(spark, folder, tmp_path):
    batch = series.segment_resets(spark.read.parquet(folder), KEY, 200.0, 0.0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = run(spark, monitors.segment_resets(source(spark, folder), KEY, 200.0, 0.0), tmp_path, "segments")
    assert rows(live, "sensor_id", "row_idx", "segment") == rows(batch, "sensor_id", "row_idx", "segment")


def test_filter(spark, folder, tmp_path):
    ordered = spark.read.parquet(folder).withColumn("t_s", F.col("row_idx") * 10.0)
    batch = estimation.scalar_filter(ordered, KEY, 0.01, 4.0)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = run(spark, monitors.scalar_filter(source(spark, folder).withColumn("t_s", F.col("row_idx") * 10.0), KEY, 0.01, 4.0), tmp_path, "filtered")
    pick = ("sensor_id", "row_idx", "status", F.round("estimate", 9))
    assert rows(live, *pick) == rows(batch, *pick) and live.where("status = 'rejected'").count() > 0


def test_hampel_flags_spikes(spark, folder, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    live = run(spark, monitors.hampel(source(spark, folder), KEY, 9, 6.0), tmp_path, "spikes")
    flagged = {r.row_idx for r in live.where("spike").collect()}
    assert flagged >= {i for i in range(40, 400, 40)} and len(flagged) < 40


def test_monitor_and_duplicates(spark, folder, tmp_path):
    live = run(spark, monitors.sampling_monitor(source(spark, folder), KEY, "10 minutes", "1 minute"), tmp_path, "monitor")
    assert live.where("n <= 0").count() == 0 < live.count()
    again = source(spark, folder).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    once = run(spark, monitors.drop_late_duplicates(again, KEY, "1 hour"), tmp_path, "once")
    assert spark.read.parquet(folder).join(once, "row_idx", "left_anti").collect() == [] and once.count() == 400


def test_latest_event(spark, folder, tmp_path):
    """Readings before the first event stay with nulls, and the last event reigns for good."""
    years = 2 * 365 * 86400.0
    events = [(0, 100.0, 1.0), (0, 900.0, 2.0), (1, -years, 3.0)]
    stream = source(spark, folder).withColumn("t_s", F.when(F.col("row_idx") % 50 == 49, F.col("t_s") + years).otherwise(F.col("t_s")))
    live = run(spark, monitors.latest_event(stream, spark.createDataFrame(events, "sensor_id bigint, t_s double, value double"), KEY), tmp_path, "events")
    want = {}
    for r in spark.read.parquet(folder).collect():
        t = r.t_s + years * (r.row_idx % 50 == 49)
        want[r.row_idx] = max(((e, v) for s, e, v in events if s == r.sensor_id and e <= t), default=(None, None))
    assert {r.row_idx: (r.event_t, r.event_value) for r in live.collect()} == want and live.count() == 400
