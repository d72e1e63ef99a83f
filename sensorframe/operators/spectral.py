"""Welch power spectra of evenly sampled series, and what is read off them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def welch(samples: DataFrame, key: list[str], dt: float, segment: int = 16) -> DataFrame:
    """One-sided power per frequency bin: Hann windows of ``segment`` samples with half overlap, mean removed.

    ``samples`` has i (0..) and value. Each sample joins the one or two segments that hold it; a segment is an array of bounded
    length, transformed in batches, and bins are averaged with partial aggregation.
    """
    step = segment // 2
    s = samples.select(*key, "i", "value", F.explode(F.array(F.floor(F.col("i") / step), F.floor(F.col("i") / step) - 1)).alias("g")).where("g >= 0")
    g = s.groupBy(*key, "g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("v")).where(F.size("v") == segment)
    size = 1 << (segment - 1).bit_length()
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / (segment - 1))

    @F.pandas_udf("array<double>")
    def power(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        x = (x - x.mean(1, keepdims=True)) * window
        p = np.abs(np.fft.rfft(x, size)) ** 2 * dt / (window**2).sum()
        p[:, 1 : -1 if size % 2 == 0 else None] *= 2
        return pd.Series(list(p))

    bins = g.select(*key, F.posexplode(power("v")).alias("bin", "p"))
    return bins.groupBy(*key, "bin").agg(F.avg("p").alias("power"), F.count("*").alias("segments")).withColumn("hz", F.col("bin") / (size * dt))


def band_power(psd: DataFrame, key: list[str], bands: list[tuple[str, float, float]]) -> DataFrame:
    """Trapezoid power of the bin intervals that touch each band, and its share of the total."""
    w = W.partitionBy(key).orderBy("hz")
    t = psd.withColumns({"hz2": F.lead("hz").over(w), "p2": F.lead("power").over(w)}).where("hz2 IS NOT NULL").withColumn("area", (F.col("hz2") - F.col("hz")) * (F.col("power") + F.col("p2")) / 2)
    total = t.groupBy(key).agg(F.sum("area").alias("total"))
    b = F.explode(F.array(*(F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in bands))).alias("b")
    out = t.select("*", b).where("hz2 > b.lo AND hz < b.hi").groupBy(*key, "b.band").agg(F.sum("area").alias("power"))
    return out.join(total, key).select(*key, "band", "power", (F.col("power") / F.col("total")).alias("share"))


def peaks(psd: DataFrame, key: list[str], top: int = 5) -> DataFrame:
    """Bins not below both neighbours, the ``top`` largest."""
    w = W.partitionBy(key).orderBy("hz")
    p = psd.withColumns({"_a": F.lag("power").over(w), "_b": F.lead("power").over(w)}).where("power >= _a AND power >= _b")
    return p.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("power"), "hz"))).where(F.col("place") <= top).drop("_a", "_b")


def roll_off(psd: DataFrame, key: list[str], share: float = 0.9) -> DataFrame:
    """Centroid, and the first frequency where the running trapezoid reaches a share of the whole."""
    w = W.partitionBy(key).orderBy("hz")
    t = psd.withColumn("_area", F.coalesce((F.col("hz") - F.lag("hz").over(w)) * (F.col("power") + F.lag("power").over(w)) / 2, F.lit(0.0)))
    t = t.withColumns({"_run": F.sum("_area").over(w), "_all": F.sum("_area").over(W.partitionBy(key))})
    return t.groupBy(key).agg((F.sum(F.col("hz") * F.col("power")) / F.sum("power")).alias("centroid_hz"), F.min(F.when(F.col("_run") >= share * F.col("_all"), F.col("hz"))).alias("roll_off_hz"), F.max("_all").alias("total_power"))
