"""Sensor-shaped views over the star-schema tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES = ["sensor_id", "channel"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_order(df: DataFrame, key: list[str]) -> DataFrame:
    """The rows of a stored table (files, or selections of them) dealt by ``key`` and sorted as they stand in its files, so that sums over
    ``key`` or more add up in that order, however the files were split: their last bits decide ties with a limit."""
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return at.repartition(*key).sortWithinPartitions("_file", "_row").drop("_file", "_row")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sensor_id, channel, row_idx, t_s, value); time in seconds, whatever the session's time zone."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1e6")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sensor_id"), F.col("event_type").alias("channel"), F.col("event_id").alias("row_idx"), t.alias("t_s"), "value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration observations per supplier: (series, seq, x = log10 activity, y = potential in V, level, branch_hint)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("series"), F.log10(F.col("l_quantity") / 1000).alias("x"), (F.col("l_extendedprice") / 1e5).alias("y"),
        F.col("l_quantity").alias("level"), F.col("l_returnflag").alias("branch"), F.col("l_shipdate").alias("d"), F.col("l_orderkey").alias("o"),
        F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_discount").alias("w0"), F.col("l_tax").alias("c0"),
    )


def spectra(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """One spectrum per supplier: (spectrum_id, level, freq_hz, z_re, z_im), a point per quantity. ``ordered`` takes the means in the order of
    the file, for what compares them with a limit or each other; it shuffles the lines instead of their partial sums."""
    li = table(spark, sf_dir, "lineitem")
    li = in_order(li.select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount"), ["l_suppkey", "l_quantity"]) if ordered else li
    points = li.groupBy(F.col("l_suppkey").alias("spectrum_id"), F.col("l_quantity").alias("level"))
    points = points.agg(F.avg("l_extendedprice").alias("z_re"), (-1e3 * F.avg("l_discount")).alias("z_im"))
    return points.withColumn("freq_hz", F.pow(F.lit(10.0), (F.col("level") - 1) / 10))
