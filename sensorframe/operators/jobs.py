"""Composite jobs: reports that join several operators over the same series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators import series as S


def warnings(readings: DataFrame, key: list[str], *, irregular: float = 0.5, missing: float = 0.2, short: int = 16, gap_s: float = 432000.0) -> DataFrame:
    """Per series the names of what is wrong with its sampling, comma separated: irregular, missing, short, gap."""
    s = S.sampling_summary(readings, key)
    told = F.array(F.when(F.col("dt_cv") > irregular, "irregular"), F.when(F.col("missing_share") > missing, "missing"), F.when(F.col("n") < short, "short"), F.when(F.col("dt_max") > gap_s, "gap"))
    return s.select(*key, F.array_join(F.array_compact(told), ",").alias("warnings"))


def compare_series(readings: DataFrame, manifest: DataFrame, key: list[str], *, window: int = 7, threshold: float = 3.0) -> DataFrame:
    """One row a record of a manifest (record, category and the ``key`` of its series): n, mean, sd, robust_sd, drift (least-squares slope per
    second), spike_share, warnings, and z, the record's mean against the means of its category (null for one record or no spread).

    ``readings`` is read by each part: give a written table. Records of unknown series have nulls and n = 0; series that no record names are
    left out; a series may serve several records."""
    wanted = readings.join(manifest.select(key).distinct(), key, "left_semi")
    d = S.describe(wanted, key).select(*key, "n", "mean", "sd", "robust_sd")
    first = wanted.groupBy(key).agg(F.min("t_s").alias("_t0"))
    line = wanted.join(first, key).select(*key, (F.col("t_s") - F.col("_t0")).alias("x"), F.col("value").alias("y")).where("y IS NOT NULL")
    drift = S.ols(line, key).select(*key, F.col("slope").alias("drift"))
    spikes = S.hampel(wanted.where("value IS NOT NULL"), key, window, threshold).groupBy(key).agg(F.avg(F.col("spike").cast("double")).alias("spike_share"))
    rows = d.join(drift, key, "left").join(spikes, key, "left").join(warnings(wanted, key), key, "left")
    out = manifest.join(rows, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of = out.groupBy("category").agg(F.avg("mean").alias("_of_mean"), F.stddev_samp("mean").alias("_of_sd"))
    out = out.join(of, "category").withColumn("z", F.when(F.col("_of_sd") > 0, (F.col("mean") - F.col("_of_mean")) / F.col("_of_sd")))
    return out.drop("_of_mean", "_of_sd")


def residual_report(residuals: DataFrame, *, window: int = 7, threshold: float = 3.0) -> DataFrame:
    """Per (source, record): n, durbin_watson, lag1, runs, rms, largest, drift (slope over t_s), spike_share. ``residuals`` is long, from any
    fits: source, record, row_idx, t_s and r; null residuals and keys are left out. Rows are ordered by t_s and row_idx. Ratios of residuals that are all zero, or all equal, are no numbers.

    All of it is read from one sort of the rows by source, record and time: they are shuffled once, or not at all where they lie by record already."""
    key, both = ["source", "record"], S.finite("t_s").isNotNull() & S.finite("value").isNotNull()
    d = residuals.where(F.col("r").isNotNull() & ~F.isnan("r") & F.col("source").isNotNull() & F.col("record").isNotNull()).withColumnRenamed("r", "value")
    d = S.hampel(d.select(*key, "row_idx", "t_s", "value"), key, window, threshold).drop("z")
    d = d.withColumns({"_x": F.when(both, F.col("t_s")), "_y": F.when(both, F.col("value"))})
    d = d.withColumns({m: F.avg(c).over(W.partitionBy(key)) for m, c in (("_mean", "value"), ("_mx", "_x"), ("_my", "_y"))})
    d = S.with_neighbours(d, key, ["t_s", "row_idx"], "value")
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    sxx = F.sum(dx * dx)
    return d.groupBy(key).agg(
        *S.residual_measures("value", float("nan")), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("largest"),
        F.when((F.count("_x") >= 2) & (sxx > 0), F.try_divide(F.sum(dx * dy), sxx)).alias("drift"), F.avg(F.col("spike").cast("double")).alias("spike_share"),
    )
