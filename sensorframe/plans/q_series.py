"""Registered queries over the reading series, with their DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.operators import series as S
from sensorframe.plans.common import Registry, rounded
from sensorframe.sources.views import SERIES, in_order, readings

DAY = 86400.0
R = "WITH r AS (SELECT user_id AS sensor_id, event_type AS channel, event_id AS row_idx, epoch_us(ts) / 1e6 AS t_s, value FROM events)"


def scrambled(spark, sf):
    """Readings with repeated and backward times: every 97th row is a day earlier, every 50th is given twice."""
    r = readings(spark, sf).withColumn("t_s", F.col("t_s") - F.when(F.col("row_idx") % 97 == 0, DAY).otherwise(0.0))
    again = r.where("row_idx % 50 = 0").withColumn("row_idx", F.col("row_idx") + 1000000000).withColumn("value", F.when(F.col("row_idx") % 100 == 0, F.col("value")).otherwise(F.col("value") + 1))
    return r.unionByName(again)


X = (
    R
    + """, s0 AS (SELECT sensor_id, channel, row_idx, t_s - CASE WHEN row_idx % 97 = 0 THEN 86400.0 ELSE 0.0 END AS t_s, value FROM r),
s AS (SELECT * FROM s0 UNION ALL SELECT sensor_id, channel, row_idx + 1000000000, t_s, CASE WHEN row_idx % 100 = 0 THEN value ELSE value + 1 END FROM s0 WHERE row_idx % 50 = 0)"""
)

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

D1 = """, q AS (SELECT sensor_id, channel, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, avg(value) AS m FROM r GROUP BY ALL),
a AS (SELECT sensor_id, channel, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, var_samp(value) AS variance, sqrt(avg(value * value)) AS rms, min(value) AS mn, max(value) AS mx,
  any_value(q1) AS q1, any_value(q2) AS q2, any_value(q3) AS q3, quantile_cont(abs(value - q2), 0.5) AS mad, avg(power(value - m, 3)) AS m3, avg(power(value - m, 4)) AS m4
  FROM r JOIN q USING (sensor_id, channel) GROUP BY sensor_id, channel)"""
register(
    "d01_descriptive",
    lambda s, d: rounded(S.describe(readings(s, d), SERIES).select(*SERIES, "n", "mean", "sd", "variance", "rms", "peak_to_peak", "min", "max")),
    R + D1 + " SELECT sensor_id, channel, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(variance, 6) AS variance, round(rms, 6) AS rms, round(mx - mn, 6) AS peak_to_peak, mn AS min, mx AS max FROM a",
)
register(
    "d02_quantiles",
    lambda s, d: rounded(readings(s, d).groupBy(SERIES).agg(F.percentile("value", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("q")).select(*SERIES, *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((5, 25, 50, 75, 95))))),
    R + " SELECT sensor_id, channel, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS q{p}" for p in (5, 25, 50, 75, 95)) + " FROM r GROUP BY sensor_id, channel",
)
register(
    "d03_robust_spread",
    lambda s, d: rounded(S.describe(readings(s, d), SERIES).select(*SERIES, "median", "mad", "robust_sd", "iqr")),
    R + D1 + " SELECT sensor_id, channel, round(q2, 6) AS median, round(mad, 6) AS mad, round(1.4826 * mad, 6) AS robust_sd, round(q3 - q1, 6) AS iqr FROM a",
)
register(
    "d04_skewness_kurtosis",
    lambda s, d: rounded(S.describe(readings(s, d), SERIES).select(*SERIES, "skewness", "excess_kurtosis")),
    R + D1 + " SELECT sensor_id, channel, round(m3 / power(sd, 3), 6) AS skewness, round(m4 / power(sd, 4) - 3, 6) AS excess_kurtosis FROM a",
)
register(
    "d05_mean_interval",
    lambda s, d: rounded(S.describe(readings(s, d), SERIES).select(*SERIES, "mean", "ci_low", "ci_high")),
    R + D1 + " SELECT sensor_id, channel, round(mean, 6) AS mean, round(mean - 1.96 * sd / sqrt(n), 6) AS ci_low, round(mean + 1.96 * sd / sqrt(n), 6) AS ci_high FROM a",
)
DT = ", i AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS dt FROM r)"
register(
    "d06_sampling",
    lambda s, d: rounded(S.sampling_summary(readings(s, d), SERIES), 4),
    R + DT + """ SELECT sensor_id, channel, count(*) AS n, round(quantile_cont(dt, 0.5), 4) AS dt_median, round(avg(dt), 4) AS dt_mean, round(stddev_samp(dt), 4) AS dt_sd, round(stddev_samp(dt) / avg(dt), 4) AS dt_cv,
 round(min(dt), 4) AS dt_min, round(max(dt), 4) AS dt_max, round(max(t_s) - min(t_s), 4) AS duration, round(count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) / count(*), 4) AS missing_share, round((count(*) - 1) / (max(t_s) - min(t_s)), 4) AS rate_hz
 FROM i GROUP BY sensor_id, channel""",
)
register(
    "d07_axis_diagnostics",
    lambda s, d: S.axis_diagnostics(scrambled(s, d), SERIES),
    X + """, p AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY row_idx) AS step FROM s),
 f AS (SELECT sensor_id, channel, arg_min(step, row_idx) AS fs FROM p WHERE step > 0 GROUP BY ALL)
 SELECT sensor_id, channel, count(t_s) - count(DISTINCT t_s) AS duplicates, count(*) FILTER (step < 0) AS backward, coalesce(bool_or(abs(step - fs) > greatest(abs(fs), 1.0) * 1e-9), false) AS irregular
 FROM p LEFT JOIN f USING (sensor_id, channel) GROUP BY sensor_id, channel""",
)
register(
    "d08_timestamp_diagnostics",
    lambda s, d: rounded(S.timestamp_diagnostics(scrambled(s, d), SERIES, 3600.0), 4),
    X + """, p AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY row_idx) AS step FROM s),
 u AS (SELECT sensor_id, channel, t_s, count(*) AS c, count(DISTINCT value) AS d FROM s GROUP BY ALL),
 v AS (SELECT sensor_id, channel, CAST(sum(CASE WHEN c > 1 AND d <= 1 THEN c - 1 ELSE 0 END) AS BIGINT) AS identical, count(*) FILTER (c > 1 AND d > 1) AS conflicting FROM u GROUP BY ALL)
 SELECT sensor_id, channel, any_value(identical) AS identical, any_value(conflicting) AS conflicting, count(*) FILTER (step < 0 AND step > -3600) AS reversals, count(*) FILTER (step <= -3600) AS resets,
  round(max(abs(step)), 4) AS largest_jump, count(*) FILTER (step <= -3600) + 1 AS segments FROM p JOIN v USING (sensor_id, channel) GROUP BY sensor_id, channel""",
)
register(
    "d09_missing",
    lambda s, d: S.missing_counts(readings(s, d).withColumn("value", F.when(F.col("row_idx") % 13 == 0, float("nan")).when(F.col("row_idx") % 17 == 0, None).otherwise(F.col("value"))), SERIES),
    R + " SELECT sensor_id, channel, count(*) AS rows, count(*) FILTER (value IS NULL OR row_idx % 13 = 0 OR row_idx % 17 = 0) AS missing FROM r GROUP BY sensor_id, channel",
)


def drift_input(s, d):
    """Hours since the first reading of all, against the value."""
    r = readings(s, d)
    return r.select(*SERIES, "row_idx", ((F.col("t_s") - 1704067200.0) / 3600).alias("x"), F.col("value").alias("y"))


DR = R + ", x AS (SELECT sensor_id, channel, row_idx, (t_s - 1704067200.0) / 3600 AS x, value AS y FROM r)"
OLS = """, g AS (SELECT sensor_id, channel, avg(x) AS mx, avg(y) AS my FROM x GROUP BY ALL),
 c AS (SELECT sensor_id, channel, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy FROM x JOIN g USING (sensor_id, channel) GROUP BY sensor_id, channel HAVING count(*) >= 2 AND sum((x - mx) * (x - mx)) > 0),
 l AS (SELECT *, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept FROM c),
 e AS (SELECT x.sensor_id, x.channel, sum(power(y - intercept - slope * x, 2)) AS rss, avg(abs(y - intercept - slope * x)) AS mae, quantile_cont(abs(y - intercept - slope * x), 0.5) AS mar FROM x JOIN l USING (sensor_id, channel) GROUP BY ALL)"""
register(
    "d10_ols_line",
    lambda s, d: rounded(S.ols(drift_input(s, d), SERIES).select(*SERIES, "n", "slope", "intercept", "r2", "rmse", "mae", "r")),
    DR + OLS + " SELECT sensor_id, channel, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(greatest(0.0, least(1.0, 1 - rss / syy)), 6) AS r2, round(sqrt(rss / n), 6) AS rmse, round(mae, 6) AS mae, round(sxy / sqrt(sxx * syy), 6) AS r FROM l JOIN e USING (sensor_id, channel)",
)
register(
    "d11_ols_drift",
    lambda s, d: rounded(S.ols(drift_input(s, d), SERIES).select(*SERIES, (F.col("slope") * 1e3).alias("per_hour_milli"), (F.col("slope") * 24e3).alias("per_day_milli"), "slope_se", (F.col("slope") - 1.96 * F.col("slope_se")).alias("low"), (F.col("slope") + 1.96 * F.col("slope_se")).alias("high"), "robust_scale")),
    DR + OLS + """ SELECT sensor_id, channel, round(slope * 1e3, 6) AS per_hour_milli, round(slope * 24e3, 6) AS per_day_milli, round(se, 6) AS slope_se, round(slope - 1.96 * se, 6) AS low, round(slope + 1.96 * se, 6) AS high, round(1.4826 * mar, 6) AS robust_scale
 FROM (SELECT *, CASE WHEN n > 2 THEN sqrt(rss / (n - 2) / sxx) END AS se FROM l JOIN e USING (sensor_id, channel))""",
)
TS = ", p AS (SELECT a.sensor_id, a.channel, (b.y - a.y) / (b.x - a.x) AS s FROM x a JOIN x b ON a.sensor_id = b.sensor_id AND a.channel = b.channel AND a.row_idx < b.row_idx AND a.x <> b.x), g AS (SELECT sensor_id, channel, avg(x) AS mx, avg(y) AS my FROM x GROUP BY ALL)"
register(
    "d12_theil_sen",
    lambda s, d: rounded(S.theil_sen(drift_input(s, d), SERIES, "x", "y")),
    DR + TS + ", q AS (SELECT sensor_id, channel, quantile_cont(s, 0.5) AS slope FROM p GROUP BY ALL) SELECT sensor_id, channel, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM q JOIN g USING (sensor_id, channel)",
)
register(
    "d13_theil_sen_upper",
    lambda s, d: rounded(S.theil_sen(drift_input(s, d), SERIES, "x", "y", "upper")),
    DR + TS + ", q AS (SELECT sensor_id, channel, list_sort(list(s))[count(*) // 2 + 1] AS slope FROM p GROUP BY ALL) SELECT sensor_id, channel, round(slope, 6) AS slope, round(my - slope * mx, 6) AS intercept FROM q JOIN g USING (sensor_id, channel)",
)


def hourly(s, d, channel):
    """Mean per sensor and hour of one channel: series that share their times."""
    r = readings(s, d).where(F.col("channel") == channel)
    return r.groupBy("sensor_id", F.floor(F.col("t_s") / 21600).alias("h")).agg(F.avg("value").alias("value"))


HP = R + ", h AS (SELECT sensor_id, channel, CAST(floor(t_s / 21600) AS BIGINT) AS h, avg(value) AS v FROM r GROUP BY ALL), p AS (SELECT a.sensor_id, a.h, a.v AS va, b.v AS vb FROM h a JOIN h b ON a.sensor_id = b.sensor_id AND a.h = b.h AND a.channel = 'click' AND b.channel = 'view')"
CORR = lambda s, d: S.correlate(hourly(s, d, "click"), hourly(s, d, "view"), ["sensor_id"], ["h"])
RK = HP + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY va, h) AS oa, row_number() OVER (PARTITION BY sensor_id ORDER BY vb, h) AS ob, rank() OVER (PARTITION BY sensor_id ORDER BY va) + (count(*) OVER (PARTITION BY sensor_id, va) - 1) / 2 AS ta, rank() OVER (PARTITION BY sensor_id ORDER BY vb) + (count(*) OVER (PARTITION BY sensor_id, vb) - 1) / 2 AS tb FROM p)"
register(
    "d14_pearson_covariance",
    lambda s, d: rounded(CORR(s, d).select("sensor_id", "n", "pearson", "covariance")),
    HP + " SELECT sensor_id, count(*) AS n, CASE WHEN var_pop(va) > 0 AND var_pop(vb) > 0 THEN round(corr(va, vb), 6) END AS pearson, round(covar_samp(va, vb), 6) AS covariance FROM p GROUP BY sensor_id",
)
register(
    "d15_spearman_ordinal",
    lambda s, d: rounded(CORR(s, d).select("sensor_id", "spearman_ordinal")),
    RK + " SELECT sensor_id, CASE WHEN var_pop(oa) > 0 AND var_pop(ob) > 0 THEN round(corr(oa, ob), 6) END AS spearman_ordinal FROM k GROUP BY sensor_id",
)
register(
    "d16_spearman_ties",
    lambda s, d: rounded(CORR(s, d).select("sensor_id", "spearman_ties")),
    RK + " SELECT sensor_id, CASE WHEN var_pop(ta) > 0 AND var_pop(tb) > 0 THEN round(corr(ta, tb), 6) END AS spearman_ties FROM k GROUP BY sensor_id",
)
register(
    "d21_residual_summary",
    lambda s, d: rounded(S.residual_summary(in_order(readings(s, d), SERIES).withColumnRenamed("value", "r"), SERIES, ["t_s", "row_idx"], still=float("nan"))),
    R + """, m AS (SELECT *, avg(value) OVER (PARTITION BY sensor_id, channel) AS mean FROM r), c AS (SELECT *, value - mean AS c, lag(value) OVER w AS p, lag(value - mean) OVER w AS pc FROM m WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx))
 SELECT sensor_id, channel, count(*) AS n, round(sum(power(value - p, 2)) / sum(value * value), 6) AS durbin_watson, round(sum(c * pc) / sum(c * c), 6) AS lag1, count(*) FILTER ((c >= 0) <> (pc >= 0)) + 1 AS runs FROM c GROUP BY sensor_id, channel""",
)
register(
    "d21_autocorrelation",
    lambda s, d: rounded(S.lag_pairs(readings(s, d), SERIES, 49)),
    R + """, m AS (SELECT sensor_id, channel, row_number() OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS i, value - avg(value) OVER (PARTITION BY sensor_id, channel) AS v FROM r),
 c AS (SELECT a.sensor_id, a.channel, b.i - a.i AS lag, sum(a.v * b.v) AS c FROM m a JOIN m b ON a.sensor_id = b.sensor_id AND a.channel = b.channel AND b.i BETWEEN a.i AND a.i + 49 GROUP BY ALL)
 SELECT c.sensor_id, c.channel, lag, round(c.c / z.c0, 6) AS acf FROM c JOIN (SELECT sensor_id, channel, c AS c0 FROM c WHERE lag = 0 AND c > 0) z USING (sensor_id, channel)""",
)
register(
    "e01_stable_sort",
    lambda s, d: S.sort_report(scrambled(s, d), SERIES),
    X + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, channel ORDER BY row_idx) AS a, row_number() OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS b FROM s) SELECT sensor_id, channel, count(*) AS rows, count(*) FILTER (a <> b) AS moved FROM k GROUP BY sensor_id, channel",
)
for policy, agg in (("average", "avg(value)"), ("first", "arg_min(value, row_idx)"), ("last", "arg_max(value, row_idx)")):
    register(
        f"e02_duplicates_{policy}",
        lambda s, d, policy=policy: rounded(S.merge_duplicates(scrambled(s, d), SERIES, policy)),
        X + f" SELECT sensor_id, channel, round(t_s, 6) AS t_s, round({agg}, 6) AS value, min(row_idx) AS row_idx, count(*) AS merged FROM s GROUP BY sensor_id, channel, s.t_s",
    )
register(
    "e03_regularity",
    lambda s, d: rounded(S.regularity(readings(s, d), SERIES, 0.9), 4),
    R + DT + ", m AS (SELECT sensor_id, channel, quantile_cont(dt, 0.5) AS m FROM i WHERE dt IS NOT NULL GROUP BY ALL) SELECT sensor_id, channel, round(any_value(m), 4) AS dt_median, bool_and(abs(dt - m) / m <= 0.9) AS regular FROM i JOIN m USING (sensor_id, channel) WHERE dt IS NOT NULL GROUP BY sensor_id, channel",
)
register(
    "e04_resample_linear",
    lambda s, d: rounded(S.resample_linear(readings(s, d), SERIES, 43200.0, 3 * DAY), 4),
    R + """, g0 AS (SELECT sensor_id, channel, min(t_s) AS t0, max(t_s) AS t1 FROM r GROUP BY ALL), g AS (SELECT sensor_id, channel, CAST(k AS BIGINT) AS k, t0 + k * 43200.0 AS t_s FROM (SELECT *, unnest(range(CAST(floor((t1 - t0) / 43200.0) AS BIGINT) + 1)) AS k FROM g0)),
 a AS (SELECT g.*, r.t_s AS ta, r.value AS va FROM g ASOF JOIN r ON g.sensor_id = r.sensor_id AND g.channel = r.channel AND g.t_s >= r.t_s),
 b AS (SELECT a.*, r.t_s AS tb, r.value AS vb FROM a ASOF LEFT JOIN r ON a.sensor_id = r.sensor_id AND a.channel = r.channel AND a.t_s <= r.t_s)
 SELECT sensor_id, channel, k, round(t_s, 4) AS t_s, round(CASE WHEN abs(t_s - ta) <= 43200e-9 THEN va WHEN abs(tb - t_s) <= 43200e-9 THEN vb WHEN tb - ta <= 259200 THEN va + (vb - va) * (t_s - ta) / (tb - ta) END, 4) AS value FROM b""",
)
register(
    "e05_reset_segments",
    lambda s, d: rounded(S.segment_resets(scrambled(s, d), SERIES, 3600.0, 0.5).groupBy(*SERIES, "segment").agg(F.count("*").alias("rows"), F.min("t_s").alias("t0"), F.max("t_s").alias("t1")), 4),
    X + """, p AS (SELECT *, lag(t_s) OVER w AS b FROM s WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY row_idx)),
 q AS (SELECT *, sum(CASE WHEN b - t_s >= 3600 OR (t_s < b AND t_s <= b * 0.5) THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id, channel ORDER BY row_idx) AS segment FROM p)
 SELECT sensor_id, channel, CAST(segment AS BIGINT) AS segment, count(*) AS rows, round(min(t_s), 4) AS t0, round(max(t_s), 4) AS t1 FROM q GROUP BY sensor_id, channel, segment""",
)
register(
    "e06_hampel",
    lambda s, d: rounded(S.hampel(readings(s, d), SERIES, 7, 3.0).select(*SERIES, "row_idx", "z", "spike"), 4),
    R + """, w AS (SELECT *, median(value) OVER win AS m, list(value) OVER win AS v FROM r WINDOW win AS (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 k AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - m))) AS mad FROM w),
 z AS (SELECT *, CASE WHEN mad > 0 THEN abs(value - m) / (1.4826 * mad) WHEN abs(value - m) > 0 THEN 1e12 ELSE 0.0 END AS z FROM k)
 SELECT sensor_id, channel, row_idx, round(z, 4) AS z, z > 3.0 AS spike FROM z""",
)
register(
    "e09_allan",
    lambda s, d: rounded(S.allan(readings(s, d), SERIES, [1, 2, 3, 4, 6, 8, 12, 16, 24, 32])),
    R + """, i AS (SELECT sensor_id, channel, row_number() OVER w AS i, sum(value) OVER w AS s FROM r WINDOW w AS (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx)),
 z AS (SELECT * FROM i UNION ALL SELECT DISTINCT sensor_id, channel, 0, 0.0 FROM r),
 d AS (SELECT a.sensor_id, a.channel, m, (c.s - 2 * b.s + a.s) / m AS d FROM z a, (VALUES (1), (2), (3), (4), (6), (8), (12), (16), (24), (32)) f(m), z b, z c WHERE a.sensor_id = b.sensor_id AND a.channel = b.channel AND b.i = a.i + m AND a.sensor_id = c.sensor_id AND a.channel = c.channel AND c.i = a.i + 2 * m)
 SELECT sensor_id, channel, CAST(m AS BIGINT) AS m, count(*) AS terms, round(sqrt(sum(d * d) / (2 * count(*))), 6) AS deviation, round(sqrt(sum(d * d) / (2 * count(*))) / sqrt(2.0 * count(*)), 6) AS se FROM d GROUP BY sensor_id, channel, m""",
)
EV = ", e AS (SELECT sensor_id, t_s - 7200.0 AS lo, t_s + 14400.0 AS hi FROM r WHERE channel = 'error')"
register(
    "b02_windows",
    lambda s, d: rounded(S.select_windows(readings(s, d).where("channel <> 'error'"), readings(s, d).where("channel = 'error'").select("sensor_id", "t_s"), ["sensor_id"], 7200.0, 14400.0)),
    R + EV + " SELECT sensor_id, channel, row_idx, round(t_s, 6) AS t_s, value FROM r WHERE channel <> 'error' AND NOT EXISTS (SELECT 1 FROM e WHERE e.sensor_id = r.sensor_id AND r.t_s BETWEEN lo AND hi)",
)
register(
    "b03_excluded_intervals",
    lambda s, d: rounded(readings(s, d).where("channel = 'error'").groupBy("sensor_id").agg(F.count("*").alias("intervals"), F.min(F.col("t_s") - 7200.0).alias("first_low"), F.max(F.col("t_s") + 14400.0).alias("last_high")), 4),
    R + EV + " SELECT sensor_id, count(*) AS intervals, round(min(lo), 4) AS first_low, round(max(hi), 4) AS last_high FROM e GROUP BY sensor_id",
)


def excluded(s, d):
    r = readings(s, d)
    return S.excluded_intervals(r.where("channel <> 'error'"), r.where("channel = 'error'").select("sensor_id", "t_s"), ["sensor_id"], 7200.0, 14400.0)


register(
    "b03_interval_list",
    lambda s, d: rounded(excluded(s, d)[0], 4),
    R + EV + " SELECT sensor_id, round(lo, 4) AS lo, round(hi, 4) AS hi, (SELECT count(*) FROM r WHERE r.sensor_id = e.sensor_id AND channel <> 'error' AND t_s BETWEEN lo AND hi) AS readings FROM e",
)
register(
    "b03_interval_report",
    lambda s, d: excluded(s, d)[1],
    R + EV + """, x AS (SELECT sensor_id, EXISTS (SELECT 1 FROM e WHERE e.sensor_id = r.sensor_id AND r.t_s BETWEEN lo AND hi) AS hit FROM r WHERE channel <> 'error')
 SELECT x.sensor_id, (SELECT count(*) FROM e WHERE e.sensor_id = x.sensor_id) AS intervals, count(*) FILTER (hit) AS inside, count(*) FILTER (NOT hit) AS outside FROM x GROUP BY x.sensor_id""",
)


def characterize(s, d):
    """One row per series: description, sampling and drift."""
    r = readings(s, d)
    out = S.describe(r, SERIES).select(*SERIES, "n", "mean", "median", "sd", "mad")
    out = out.join(S.sampling_summary(r, SERIES).select(*SERIES, "dt_median", "duration"), SERIES)
    return rounded(out.join(S.ols(drift_input(s, d), SERIES).select(*SERIES, "slope", "slope_se"), SERIES, "left"), 4)


register(
    "l01_characterize",
    characterize,
    DR + DT + D1 + OLS.replace(", g AS", ", g1 AS").replace("JOIN g USING", "JOIN g1 USING").replace(" c AS", " c1 AS").replace("FROM c)", "FROM c1)") + """, sm AS (SELECT sensor_id, channel, quantile_cont(dt, 0.5) AS dt_median, max(t_s) - min(t_s) AS duration FROM i GROUP BY ALL)
 SELECT a.sensor_id, a.channel, a.n, round(mean, 4) AS mean, round(q2, 4) AS median, round(sd, 4) AS sd, round(mad, 4) AS mad, round(dt_median, 4) AS dt_median, round(duration, 4) AS duration, round(slope, 4) AS slope,
 round(CASE WHEN l.n > 2 THEN sqrt(rss / (l.n - 2) / sxx) END, 4) AS slope_se FROM a JOIN sm USING (sensor_id, channel) LEFT JOIN l USING (sensor_id, channel) LEFT JOIN e USING (sensor_id, channel)""",
)
