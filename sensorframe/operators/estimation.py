"""Recursive filtering, truth alignment and ordered matching: the steps that are sequential within one series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Steps of the chi-squared gate with one degree of freedom, by confidence.
GATES = {0.9: 2.706, 0.95: 3.841, 0.99: 6.635, 0.999: 10.828}


def filter_step(state: tuple[float, float, float] | None, t: float, v: float | None, q: float, r: float, gate: float) -> tuple:
    """One step of the random-walk filter: (new state, (predicted, innovation, S, NIS, estimate, variance, status))."""
    if state is None:
        x, p = (v, r) if v is not None else (0.0, 1e6)
        return (t, x, p), (x, None, None, None, x, p, "initial")
    t0, x, p = state
    p = p + q * max(0.0, t - t0)
    if v is None or not np.isfinite(v):
        return (t, x, p), (x, None, None, None, x, p, "predict_only")
    nu, s = v - x, p + r
    nis = nu * nu / s
    if nis > gate:
        return (t, x, p), (x, nu, s, nis, x, p, "rejected")
    k = p / s
    new_p = (1 - k) * p * (1 - k) + k * r * k
    return (t, x + k * nu, new_p), (x, nu, s, nis, x + k * nu, new_p, "accepted")


FILTERED = "predicted double, innovation double, innovation_var double, nis double, estimate double, variance double, status string"


def scalar_filter(readings: DataFrame, key: list[str], q: float, r: float, confidence: float = 0.99) -> DataFrame:
    """Recursive filter of every series in order of time. Series run in parallel and stream through a task in sorted order, so
    no series is gathered; a null value only predicts."""
    gate = GATES[confidence]
    kinds = ", ".join(f"{c} {readings.schema[c].dataType.simpleString()}" for c in [*key, "row_idx"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                own = tuple(getattr(row, c) for c in key)
                if own != now:
                    now, state = own, None
                v = None if pd.isna(row.value) else float(row.value)
                state, made = filter_step(state, float(row.t_s), v, q, r, gate)
                out.append((*own, row.row_idx, row.t_s, v, *made))
            yield pd.DataFrame(out, columns=[*key, "row_idx", "t_s", "measured", *(c.split()[0] for c in FILTERED.split(", "))])

    rows = readings.select(*key, "row_idx", "t_s", "value").repartition(*key).sortWithinPartitions(*key, "t_s", "row_idx")
    return rows.mapInPandas(run, f"{kinds}, t_s double, measured double, {FILTERED}")


def filter_diagnostics(filtered: DataFrame, key: list[str], exceed: float = 3.841) -> DataFrame:
    return filtered.groupBy(key).agg(
        F.avg("innovation").alias("innovation_mean"), F.stddev_samp("innovation").alias("innovation_sd"), F.avg("nis").alias("nis_mean"), F.avg((F.col("nis") > exceed).cast("double")).alias("exceedance"),
        *(F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "rejected", "predict_only")),
    )


def match_ordered(left: DataFrame, right: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Greedy one-to-one pairs (li, ri) per key: each left row, in order of (x, id), takes the nearest unused right row within the
    tolerance; ties go to the earlier right row.

    Only candidate pairs, met in buckets as wide as the tolerance, reach the ordered pass, which streams sorted rows.
    """
    a = left.select(*key, F.col("id").alias("li"), F.col("x").alias("lx"))
    b = right.select(*key, F.col("id").alias("ri"), F.col("x").alias("rx"))
    a = a.withColumn("_b", F.explode(F.sequence(F.floor((F.col("lx") - tolerance) / tolerance), F.floor((F.col("lx") + tolerance) / tolerance))))
    c = a.join(b.withColumn("_b", F.floor(F.col("rx") / tolerance)), [*key, "_b"]).where(F.abs(F.col("lx") - F.col("rx")) <= tolerance).drop("_b")
    c = c.withColumn("d", F.abs(F.col("lx") - F.col("rx")))
    kinds = ", ".join(f"{k} {c.schema[k].dataType.simpleString()}" for k in [*key, "li", "ri"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, taken = None, set(), None
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                own = tuple(getattr(row, k) for k in key)
                if own != now:
                    now, used, taken = own, set(), None
                if row.li != taken and row.ri not in used:
                    taken = row.li
                    used.add(row.ri)
                    out.append((*own, row.li, row.ri, row.d))
            yield pd.DataFrame(out, columns=[*key, "li", "ri", "d"])

    return c.repartition(*key).sortWithinPartitions(*key, "lx", "li", "d", "rx", "ri").mapInPandas(run, f"{kinds}, d double")


def error_metrics(aligned: DataFrame, key: list[str]) -> DataFrame:
    """Errors of estimates against truth, interval coverage and normalised squared error."""
    e = F.col("estimate") - F.col("truth")
    return aligned.groupBy(key).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.max(F.abs(e)).alias("max_error"),
        F.avg((F.abs(e) <= 1.96 * F.sqrt("variance")).cast("double")).alias("coverage"), F.avg(e * e / F.col("variance")).alias("nees"),
    )


def convergence_time(rows: DataFrame, key: list[str], tolerance: float, run: int) -> DataFrame:
    """First time from which ``run`` consecutive rows are within the tolerance; the whole span where there is none."""
    w = W.partitionBy(key).orderBy("t_s", "row_idx")
    ahead = w.rowsBetween(0, run - 1)
    good = (F.abs(F.col("estimate") - F.col("truth")) <= tolerance).cast("int")
    r = rows.withColumn("_ok", (F.sum(good).over(ahead) == run))
    return r.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("t_s"))) - F.min("t_s"), F.max("t_s") - F.min("t_s")).alias("convergence_s"))
