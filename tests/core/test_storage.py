"""Stored intermediate tables."""

from __future__ import annotations

from sensorframe.sources.storage import shared_dir, written


def test_written_tables_come_back(spark):
    rows = [(1, "a", [1, 2]), (None, None, None), (2, "", []), (1, "a", [1, 2])]
    df = spark.createDataFrame(rows, "id bigint, text string, list array<int>")
    back = written(df, "storage-test")
    assert back.columns == df.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert all(f.startswith(shared_dir(spark)) or shared_dir(spark).removeprefix("file://") in f for f in back.inputFiles())


def test_written_empty_table_keeps_its_columns(spark):
    df = spark.createDataFrame([], "id bigint, value double")
    back = written(df, "storage-test")
    assert back.dtypes == df.dtypes and back.count() == 0


def test_aggregates_come_with_the_write(spark, tmp_path):
    """Counts and sums of a written table need no job of their own, also of an empty one."""
    from pyspark.sql import functions as F

    from sensorframe.sources.storage import told

    metrics = (F.count(F.lit(1)).alias("rows"), F.sum("id").alias("total"))
    out, seen = told(spark.range(10).repartition(3, "id").distinct(), "told", *metrics)
    assert (seen.rows, seen.total, out.count()) == (10, 45, 10)
    out, seen = told(spark.range(10).where("id > 99").distinct(), "told", *metrics)
    assert (seen.rows, seen.total, out.count()) == (0, None, 0)
