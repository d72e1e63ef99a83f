"""Descriptive, sampling, drift, spike and spectral operators on long series; every one works on all series at once.

``key`` names the columns that tell one series from another. Values that are null or not finite are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(value: str | Column) -> Column:
    """The value, or null where it is not a finite number."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def pearson(a: str, b: str) -> Column:
    """The correlation of two columns; null where one of them is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def describe(readings: DataFrame, key: list[str], value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Count, moments, robust spread and a confidence interval of the mean of every series.

    Skewness and kurtosis divide by n but scale with the sample deviation (n - 1); the interval uses stepped z values.
    """
    v = readings.withColumn("_v", finite(value))
    q = F.percentile("_v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = v.groupBy(key).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), q.alias("_q"), F.stddev_samp("_v").alias("sd"), F.var_samp("_v").alias("variance"),
        F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("rms"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.skewness("_v").alias("_s"), F.kurtosis("_v").alias("_k"),
    )
    mad = v.join(agg.select(*key, F.col("_q")[1].alias("_m")), key).groupBy(key).agg(F.percentile(F.abs(F.col("_v") - F.col("_m")), F.lit(0.5)).alias("mad"))
    n = F.col("n").cast("double")
    z = 2.576 if confidence >= 0.99 else 1.96 if confidence >= 0.95 else 1.645
    half = z * F.col("sd") / F.sqrt(n)
    out = agg.join(mad, key)
    return out.select(
        *key, "n", "mean", F.col("_q")[1].alias("median"), "sd", "variance", "rms", (F.col("max") - F.col("min")).alias("peak_to_peak"), "min", "max",
        "mad", (1.4826 * F.col("mad")).alias("robust_sd"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
        (F.col("_s") * F.pow((n - 1) / n, 1.5)).alias("skewness"), ((F.col("_k") + 3) * F.pow((n - 1) / n, 2.0) - 3).alias("excess_kurtosis"),
        (F.col("mean") - half).alias("ci_low"), (F.col("mean") + half).alias("ci_high"),
    )


def ordered(key: list[str]) -> W:
    return W.partitionBy(key).orderBy("t_s", "row_idx")


def intervals(readings: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``dt``, the time since the row before in order of time."""
    return readings.withColumn("dt", F.col("t_s") - F.lag("t_s").over(ordered(key)))


def sampling_summary(readings: DataFrame, key: list[str]) -> DataFrame:
    """Interval statistics, duration, missing share and effective rate. Where all times are equal the rate is infinite, that of one row no
    number, and so is the variation of intervals that are all zero."""
    span = F.max("t_s") - F.min("t_s")
    rate = F.when(span > 0, F.try_divide(F.count("*") - 1, span)).otherwise(F.when(F.count("*") > 1, float("inf")).otherwise(float("nan")))
    cv = F.when(F.avg("dt") != 0, F.try_divide(F.stddev_samp("dt"), F.avg("dt"))).when(F.count("dt") > 1, float("nan"))
    return (
        intervals(readings, key).groupBy(key).agg(
            F.count("*").alias("n"), F.percentile("dt", F.lit(0.5)).alias("dt_median"), F.avg("dt").alias("dt_mean"), F.stddev_samp("dt").alias("dt_sd"),
            cv.alias("dt_cv"), F.min("dt").alias("dt_min"), F.max("dt").alias("dt_max"), span.alias("duration"),
            (F.count_if(finite("value").isNull()) / F.count("*")).alias("missing_share"), rate.alias("rate_hz"),
        )
    )


def axis_diagnostics(readings: DataFrame, key: list[str], order: str = "row_idx") -> DataFrame:
    """Duplicate times, backward steps in file order, and whether any step differs from the first positive one."""
    w = W.partitionBy(key).orderBy(order)
    step = readings.withColumn("step", F.col("t_s") - F.lag("t_s").over(w))
    first = step.where("step > 0").groupBy(key).agg(F.min_by("step", order).alias("first_step"))
    step = step.join(first, key, "left")
    off = F.abs(F.col("step") - F.col("first_step")) > F.greatest(F.abs("first_step"), F.lit(1.0)) * 1e-9
    return step.groupBy(key).agg(
        (F.count("t_s") - F.count_distinct("t_s")).alias("duplicates"), F.count_if(F.col("step") < 0).alias("backward"), F.coalesce(F.bool_or(off), F.lit(False)).alias("irregular")
    )


def timestamp_diagnostics(readings: DataFrame, key: list[str], reset_s: float) -> DataFrame:
    """Identical and conflicting duplicate times, small reversals and resets, the largest jump, the number of segments."""
    dup = readings.groupBy(*key, "t_s").agg(F.count("*").alias("c"), F.count_distinct("value").alias("d")).groupBy(key)
    dup = dup.agg(F.sum(F.when((F.col("c") > 1) & (F.col("d") <= 1), F.col("c") - 1).otherwise(0)).alias("identical"), F.count_if((F.col("c") > 1) & (F.col("d") > 1)).alias("conflicting"))
    step = readings.withColumn("step", F.col("t_s") - F.lag("t_s").over(W.partitionBy(key).orderBy("row_idx")))
    back = step.groupBy(key).agg(
        F.count_if((F.col("step") < 0) & (F.col("step") > -reset_s)).alias("reversals"), F.count_if(F.col("step") <= -reset_s).alias("resets"),
        F.max(F.abs("step")).alias("largest_jump"), (F.count_if(F.col("step") <= -reset_s) + 1).alias("segments"),
    )
    return dup.join(back, key)


def missing_counts(readings: DataFrame, key: list[str]) -> DataFrame:
    return readings.groupBy(key).agg(F.count("*").alias("rows"), F.count_if(finite("value").isNull()).alias("missing"))


def sort_report(readings: DataFrame, key: list[str]) -> DataFrame:
    """How many rows a stable sort by time moves."""
    a = F.row_number().over(W.partitionBy(key).orderBy("row_idx"))
    b = F.row_number().over(ordered(key))
    return readings.withColumns({"_a": a, "_b": b}).groupBy(key).agg(F.count("*").alias("rows"), F.count_if(F.col("_a") != F.col("_b")).alias("moved"))


def merge_duplicates(readings: DataFrame, key: list[str], policy: str = "average") -> DataFrame:
    """One row per time: the average of finite values, or the first or last row in file order."""
    pick = {"average": F.avg(finite("value")), "first": F.min_by("value", "row_idx"), "last": F.max_by("value", "row_idx")}[policy]
    return readings.groupBy(*key, "t_s").agg(pick.alias("value"), F.min("row_idx").alias("row_idx"), F.count("*").alias("merged"))


def regularity(readings: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Whether every interval is within a relative tolerance of the median one."""
    d = intervals(readings, key).where("dt IS NOT NULL")
    m = d.groupBy(key).agg(F.percentile("dt", F.lit(0.5)).alias("m"))
    return d.join(m, key).groupBy(key).agg(F.first("m").alias("dt_median"), F.bool_and(F.coalesce(F.try_divide(F.abs(F.col("dt") - F.col("m")), F.col("m")) <= tolerance, F.lit(False))).alias("regular"))


def resample_linear(readings: DataFrame, key: list[str], step_s: float, max_gap_s: float) -> DataFrame:
    """Values on the grid start + k * step by linear interpolation; null across gaps over ``max_gap_s``.

    Grid points and readings are swept together: one sort per series, no range join.
    """
    span = readings.groupBy(key).agg(F.min("t_s").alias("t0"), F.max("t_s").alias("t1"))
    grid = span.select(*key, "t0", F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / step_s).cast("int"))).alias("k"))
    grid = grid.select(*key, (F.col("t0") + F.col("k") * step_s).alias("t_s"), "k", F.lit(None).cast("struct<t:double,v:double>").alias("p"))
    rows = readings.select(*key, "t_s", F.lit(None).cast("int").alias("k"), F.struct(F.col("t_s").alias("t"), finite("value").alias("v")).alias("p"))
    # a reading within the tolerance of a grid point is an exact hit whichever side it lies on
    w = W.partitionBy(key).orderBy("t_s", F.col("k").isNotNull())
    both = grid.unionByName(rows).withColumns({"a": F.last("p", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "b": F.first("p", True).over(w.rowsBetween(0, W.unboundedFollowing))})
    t, tol = F.col("t_s"), step_s * 1e-9
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (t - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    value = F.when(F.abs(t - F.col("a.t")) <= tol, F.col("a.v")).when(F.abs(F.col("b.t") - t) <= tol, F.col("b.v")).when(F.col("b.t") - F.col("a.t") <= max_gap_s, line)
    return both.where("k IS NOT NULL").select(*key, "k", "t_s", value.alias("value"))


def segment_resets(readings: DataFrame, key: list[str], reset_s: float, fraction: float) -> DataFrame:
    """Adds ``segment``: a new one starts where time falls by ``reset_s`` or to ``fraction`` of the time before, in file order."""
    w = W.partitionBy(key).orderBy("row_idx")
    before = F.lag("t_s").over(w)
    new = (before - F.col("t_s") >= reset_s) | ((F.col("t_s") < before) & (F.col("t_s") <= before * fraction))
    return readings.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def select_windows(readings: DataFrame, events: DataFrame, key: list[str], before_s: float, after_s: float, bucket_s: float | None = None) -> DataFrame:
    """Readings outside every [event - before, event + after], both ends included.

    Time is cut into buckets as wide as a window, so an event meets two or three buckets and the anti join is an equi join.
    """
    width = bucket_s or (before_s + after_s)
    e = events.select(*key, (F.col("t_s") - before_s).alias("lo"), (F.col("t_s") + after_s).alias("hi"))
    e = e.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    r = readings.withColumn("_b", F.floor(F.col("t_s") / width))
    on = [r[c] == e[c] for c in [*key, "_b"]] + [r["t_s"] >= e["lo"], r["t_s"] <= e["hi"]]
    return r.join(e, on, "left_anti").drop("_b")


def excluded_intervals(readings: DataFrame, events: DataFrame, key: list[str], before_s: float, after_s: float) -> tuple[DataFrame, DataFrame]:
    """(intervals, report): each event's interval (key, lo, hi) with the readings in it, and per key the number of intervals, of readings in any of
    them (inside) and in none (outside). Keys of readings without events are in the report with none. Intervals meet readings in time buckets."""
    width = before_s + after_s
    e = events.select(*key, (F.col("t_s") - before_s).alias("lo"), (F.col("t_s") + after_s).alias("hi"))
    b = e.distinct().withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    r = readings.withColumn("_b", F.floor(F.col("t_s") / width))
    met = r.join(b, [*key, "_b"]).where("t_s BETWEEN lo AND hi").groupBy(*key, "lo", "hi").agg(F.count("*").alias("readings"))
    intervals = e.join(met, [*key, "lo", "hi"], "left").withColumn("readings", F.coalesce("readings", F.lit(0)))
    kept = select_windows(readings, events, key, before_s, after_s).groupBy(key).agg(F.count("*").alias("outside"))
    report = readings.groupBy(key).agg(F.count("*").alias("_n")).join(e.groupBy(key).agg(F.count("*").alias("intervals")), key, "left").join(kept, key, "left").fillna(0, ["intervals", "outside"])
    return intervals, report.select(*key, "intervals", (F.col("_n") - F.col("outside")).alias("inside"), "outside")


def ols(df: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares line per key, from sums centred on the means: slope, intercept, R2, rmse, mae, r, standard error."""
    m = df.where(finite(x).isNotNull() & finite(y).isNotNull())
    m = m.join(m.groupBy(key).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my")), key)
    dx, dy = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    s = m.groupBy(key).agg(F.count("*").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy"), F.sum(dy * dy).alias("syy")).where("n >= 2 AND sxx > 0")
    s = s.withColumn("slope", F.col("sxy") / F.col("sxx")).withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
    r = m.drop("_mx", "_my").join(s.select(*key, "slope", "intercept"), key).withColumn("_r", F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    e = r.groupBy(key).agg(F.sum(F.col("_r") ** 2).alias("rss"), F.avg(F.abs("_r")).alias("mae"), F.percentile(F.abs("_r"), F.lit(0.5)).alias("mar"))
    s = s.join(e, key)
    r2 = F.when(F.col("syy") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("rss") / F.col("syy"))))
    se = F.when(F.col("n") > 2, F.sqrt(F.col("rss") / (F.col("n") - 2) / F.col("sxx")))
    return s.select(
        *key, "n", "slope", "intercept", r2.alias("r2"), F.sqrt(F.col("rss") / F.col("n")).alias("rmse"), "mae",
        F.when(F.col("syy") > 0, F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).otherwise(0.0).alias("r"), se.alias("slope_se"), (1.4826 * F.col("mar")).alias("robust_scale"), "rss",
    )


def theil_sen(df: DataFrame, key: list[str], x: str, y: str, median: str = "mean") -> DataFrame:
    """Median of all pair slopes of each key. ``median`` = upper takes the upper middle one of an even number."""
    p = df.select(*key, F.col(x).alias("xa"), F.col(y).alias("ya"), F.col("row_idx").alias("ia"))
    q = df.select(*key, F.col(x).alias("xb"), F.col(y).alias("yb"), F.col("row_idx").alias("ib"))
    slopes = p.join(q, key).where("ia < ib AND xa <> xb").withColumn("s", (F.col("yb") - F.col("ya")) / (F.col("xb") - F.col("xa")))
    if median == "mean":
        mid = slopes.groupBy(key).agg(F.percentile("s", F.lit(0.5)).alias("slope"))
    else:
        w = W.partitionBy(key)
        mid = slopes.withColumns({"r": F.row_number().over(w.orderBy("s")), "c": F.count("*").over(w)}).where("r = floor(c / 2) + 1").select(*key, F.col("s").alias("slope"))
    means = df.groupBy(key).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    return mid.join(means, key).select(*key, "slope", (F.col("_y") - F.col("slope") * F.col("_x")).alias("intercept"))


def hampel(readings: DataFrame, key: list[str], window: int, threshold: float) -> DataFrame:
    """Robust z of each value in the window of rows around it, clipped at the ends; a spread of zero gives 1e12 to any difference."""
    h = max(window, 3) // 2
    near = F.percentile("value", F.lit(0.5)).over(ordered(key).rowsBetween(-h, h))
    own = F.collect_list("value").over(ordered(key).rowsBetween(-h, h))
    d = readings.withColumns({"_m": near, "_v": own})
    s = F.array_sort(F.transform("_v", lambda v: F.abs(v - F.col("_m"))))
    n = F.size("_v")
    mad = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    d = d.withColumn("_mad", mad)
    gap = F.abs(F.col("value") - F.col("_m"))
    z = F.when(F.col("_mad") > 0, gap / (1.4826 * F.col("_mad"))).when(gap > 0, 1e12).otherwise(0.0)
    return d.withColumn("z", z).withColumn("spike", F.col("z") > threshold).drop("_v", "_m", "_mad")


def allan(readings: DataFrame, key: list[str], clusters: list[int]) -> DataFrame:
    """Overlapping Allan deviation of evenly spaced values (rows in time order) at averaging factors ``clusters``, by prefix sums."""
    w = ordered(key)
    s = readings.select(*key, F.row_number().over(w).alias("i"), F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    s = s.unionByName(readings.select(key).distinct().select(*key, F.lit(0).alias("i"), F.lit(0.0).alias("s")))
    # each prefix sum takes part three times: as S[k], S[k + m] and S[k + 2 m]
    parts = s.select(*key, "s", "i", F.explode(F.array(*map(F.lit, clusters))).alias("m"))
    parts = parts.select(*key, "m", F.explode(F.array(*(F.struct((F.col("i") - j * F.col("m")).alias("k"), (c * F.col("s")).alias("v")) for j, c in ((0, 1.0), (1, -2.0), (2, 1.0))))).alias("p"))
    d = parts.groupBy(*key, "m", "p.k").agg(F.sum("p.v").alias("d"), F.count("*").alias("c")).where("c = 3 AND k >= 0")
    n = F.count("*")
    dev = F.sqrt(F.sum(F.pow(F.col("d") / F.col("m"), 2)) / (2 * n))
    return d.groupBy(*key, "m").agg(n.alias("terms"), dev.alias("deviation"), (dev / F.sqrt(2.0 * n)).alias("se"))


def lag_pairs(readings: DataFrame, key: list[str], max_lag: int) -> DataFrame:
    """Autocorrelation of the rows in time order at lags 0..max_lag, about the mean. Each row meets its earlier ones in one sorted pass."""
    r = readings.join(readings.groupBy(key).agg(F.avg("value").alias("_mean")), key).select(*key, "t_s", "row_idx", (F.col("value") - F.col("_mean")).alias("_v"))
    w, lags = ordered(key), range(max_lag + 1)
    r = r.select(*key, F.row_number().over(w).alias("_i"), "_v", *(F.lag("_v", k).over(w).alias(f"_v{k}") for k in lags if k))
    sums = r.groupBy(key).agg(F.max("_i").alias("_n"), F.array(*(F.sum(F.col("_v") * F.col(f"_v{k}" if k else "_v")) for k in lags)).alias("_c")).where(F.get("_c", F.lit(0)) > 0)
    c = sums.select(*key, "_n", F.get("_c", F.lit(0)).alias("_c0"), F.posexplode("_c").alias("lag", "c")).where("lag < _n")
    return c.select(*key, "lag", (F.col("c") / F.col("_c0")).alias("acf"))


def residual_summary(residuals: DataFrame, key: list[str], order: list[str], value: str = "r", still: float | None = None) -> DataFrame:
    """Durbin-Watson, lag-1 autocorrelation about the mean, sign runs about the mean. Where a series is all zero, or all equal, the ratio of
    zero to zero is ``still``; those of a single row are null."""
    m = residuals.join(residuals.groupBy(key).agg(F.avg(value).alias("_mean")), key)
    return with_neighbours(m, key, order, value).groupBy(key).agg(*residual_measures(value, still))


def with_neighbours(d: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Adds what :func:`residual_measures` takes to rows with the mean of their series, ``_mean``."""
    w = W.partitionBy(key).orderBy(order)
    d = d.withColumns({"_p": F.lag(value).over(w), "_c": F.col(value) - F.col("_mean")})
    return d.withColumns({"_pc": F.lag("_c").over(w), "_up": F.col("_c") >= 0}).withColumn("_pu", F.lag("_up").over(w))


def residual_measures(value: str, still: float | None) -> list[Column]:
    """The aggregates of :func:`residual_summary`."""
    share = lambda part, whole: F.when((part == 0) & (whole == 0), F.lit(still)).otherwise(F.try_divide(part, whole))
    return [
        F.count("*").alias("n"), share(F.sum(F.pow(F.col(value) - F.col("_p"), 2)), F.sum(F.pow(value, 2))).alias("durbin_watson"),
        share(F.sum(F.col("_c") * F.col("_pc")), F.sum(F.col("_c") ** 2)).alias("lag1"), (F.count_if(F.col("_up") != F.col("_pu")) + 1).alias("runs"),
    ]


def correlate(a: DataFrame, b: DataFrame, key: list[str], on: list[str]) -> DataFrame:
    """Pearson, covariance and Spearman (ordinal and tie-averaged ranks) of two value columns joined on equal times."""
    p = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), [*key, *on])
    w = W.partitionBy(key)

    def ranks(v: str) -> dict:
        tie = F.count("*").over(W.partitionBy(*key, v))
        return {f"o_{v}": F.row_number().over(w.orderBy(v, *on)).cast("double"), f"t_{v}": F.rank().over(w.orderBy(v)) + (tie - 1) / 2}

    p = p.withColumns(ranks("va") | ranks("vb"))
    return p.groupBy(key).agg(
        F.count("*").alias("n"), pearson("va", "vb").alias("pearson"), F.covar_samp("va", "vb").alias("covariance"),
        pearson("o_va", "o_vb").alias("spearman_ordinal"), pearson("t_va", "t_vb").alias("spearman_ties"),
    )
