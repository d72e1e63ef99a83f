"""As-of, window and interval alignment of slow series and events to readings.

As-of joins sweep both sides in one sort per key: no range join, and the cost does not depend on how far apart neighbours are.
Window joins meet in time buckets, so they are equi joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators.series import pearson


def neighbours(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``p`` and ``n`` to the left rows: the right row (t, v) at or before, and the one at or after, each row's time."""
    both = left.withColumns({"_r": F.lit(None).cast("struct<t:double,v:double>")})
    rows = right.select(*key, "t_s", F.struct(F.col("t_s").alias("t"), F.col("value").cast("double").alias("v")).alias("_r"))
    both = both.withColumn("_left", F.lit(True)).unionByName(rows, allowMissingColumns=True)
    back = W.partitionBy(key).orderBy(F.col("t_s"), F.col("_left").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(key).orderBy(F.col("t_s"), F.col("_left").isNull()).rowsBetween(0, W.unboundedFollowing)
    return both.withColumns({"p": F.last("_r", True).over(back), "n": F.first("_r", True).over(ahead)}).where("_left").drop("_left", "_r")


def asof(left: DataFrame, right: DataFrame, key: list[str], how: str = "nearest", max_gap_s: float = float("inf"), bracket_gap: bool = False) -> DataFrame:
    """Adds ``aligned`` (and ``gap_s`` to the nearest right row, ``extrapolated`` outside the right rows' range).

    nearest: ties go to the earlier row; linear: between the bracketing rows, the nearest one outside; hold: the row at or
    before, else the nearest. The nearest row must be within ``max_gap_s``, else the result is null; with ``bracket_gap`` the
    bracketing rows must not be further apart than that either.
    """
    d = neighbours(left, right, key)
    t = F.col("t_s")
    before, after = t - F.col("p.t"), F.col("n.t") - t
    gap = F.least(before, after)
    near = F.when(F.col("n").isNull() | (before <= after), F.col("p.v")).otherwise(F.col("n.v"))
    span = F.col("n.t") - F.col("p.t")
    if how == "nearest":
        v = near
    elif how == "hold":
        v = F.coalesce(F.col("p.v"), F.col("n.v"))
    else:
        line = F.when(span > 0, F.col("p.v") + (F.col("n.v") - F.col("p.v")) * before / span).otherwise(F.col("p.v"))
        v = F.when(F.col("p").isNull() | F.col("n").isNull(), near).otherwise(line)
        if bracket_gap:
            v = F.when(F.coalesce(span, F.lit(0.0)) <= max_gap_s, v)
    return d.withColumns({"aligned": F.when(gap <= max_gap_s, v), "gap_s": gap, "extrapolated": F.col("p").isNull() | F.col("n").isNull()}).drop("p", "n")


def latest_event(left: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``event_t`` and ``event_value`` of the latest event at or before each row."""
    return neighbours(left, events, key).select(*left.columns, F.col("p.t").alias("event_t"), F.col("p.v").alias("event_value"))


def within(left: DataFrame, right: DataFrame, key: list[str], before_s: float, after_s: float) -> DataFrame:
    """All (left, right) pairs with right time in [left time - before, left time + after]; right columns t and v."""
    width = before_s + after_s
    a = left.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t_s") - before_s) / width), F.floor((F.col("t_s") + after_s) / width))))
    b = right.select(*key, F.floor(F.col("t_s") / width).alias("_b"), F.col("t_s").alias("t"), F.col("value").alias("v"))
    return a.join(b, [*key, "_b"]).where(F.col("t").between(F.col("t_s") - before_s, F.col("t_s") + after_s)).drop("_b")


def window_aggregate(left: DataFrame, right: DataFrame, key: list[str], half_s: float, row: str = "row_idx") -> DataFrame:
    """Mean and median of the right values within a closed half width of each left row; no row where there is none."""
    w = within(left, right, key, half_s, half_s)
    return w.groupBy(*key, row).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"))


def fold_events(left: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Events in (previous row's time, this row's time] of each left row: how many, their summed value, their times.

    Each event belongs to the first row at or after it, so no event counts twice.
    """
    own = left.select(*key, F.col("t_s"), F.col("row_idx"))
    e = events.select(*key, "t_s", F.lit(None).cast("bigint").alias("row_idx"), "value")
    both = own.withColumn("value", F.lit(None).cast("double")).unionByName(e)
    ahead = W.partitionBy(key).orderBy("t_s", F.col("row_idx").isNotNull()).rowsBetween(0, W.unboundedFollowing)
    target = both.withColumn("to", F.first("row_idx", True).over(ahead)).where("row_idx IS NULL AND to IS NOT NULL")
    sums = target.groupBy(*key, F.col("to").alias("row_idx")).agg(F.count("*").alias("n_events"), F.sum("value").alias("total"), F.array_sort(F.collect_list("t_s")).alias("times"))
    return left.select(*key, "row_idx").join(sums, [*key, "row_idx"], "left").withColumns({"n_events": F.coalesce("n_events", F.lit(0)), "total": F.coalesce("total", F.lit(0.0))})


def previous_compatible(events: DataFrame, key: list[str], group: str, order: list[str]) -> DataFrame:
    """Adds ``before``: the last finite value of an earlier event of the same group."""
    w = W.partitionBy(*key, group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("before", F.last(F.when(~F.isnan("value"), F.col("value")), True).over(w))


def carry_forward(df: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Nulls take the last value before them."""
    return df.withColumn(value, F.last(value, True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def cut_windows(events: DataFrame, readings: DataFrame, key: list[str], pre_s: float, post_s: float, baseline_s: float, event: str = "event_idx") -> DataFrame:
    """Readings around each event in local time; phase is baseline (within ``baseline_s`` before) or response (from 0 on)."""
    w = within(events, readings, key, pre_s, post_s).withColumn("local", F.col("t") - F.col("t_s"))
    phase = F.when(F.col("local") >= 0, "response").when(F.col("local") >= -baseline_s, "baseline")
    return w.select(*key, event, F.col("t_s").alias("event_t"), "local", "v", phase.alias("phase"))


def lagged_pairs(a: DataFrame, b: DataFrame, key: list[str], step_s: float, max_lag: int) -> DataFrame:
    """Correlation of a with b at lags -max..max steps: each a row meets the first b row within half a step of its shifted time."""
    x = a.select(*key, F.col("row_idx").alias("ia"), "t_s", F.col("value").alias("va"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    x = x.withColumn("at", F.col("t_s") + F.col("lag") * step_s)
    x = x.withColumn("_b", F.explode(F.array(F.floor(F.col("at") / step_s - 0.5), F.floor(F.col("at") / step_s + 0.5))))
    y = b.select(*key, F.col("row_idx").alias("ib"), F.col("t_s").alias("tb"), F.col("value").alias("vb"), F.floor(F.col("t_s") / step_s).alias("_b"))
    m = x.join(y, [*key, "_b"]).where(F.abs(F.col("tb") - F.col("at")) <= step_s / 2)
    m = m.groupBy(*key, "lag", "ia").agg(F.first("va").alias("va"), F.min_by("vb", "ib").alias("vb"))
    return m.groupBy(*key, "lag").agg(F.count("*").alias("n"), pearson("va", "vb").alias("r"))
