"""Registered alignment and event-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.operators import align as A
from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import R
from sensorframe.sources.views import readings

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
KEY = ["sensor_id"]
GAP = 43200.0


def part(s, d, channel):
    return readings(s, d).where(F.col("channel") == channel).drop("channel")


def left(s, d):
    return part(s, d, "click")


def right(s, d):
    return part(s, d, "view").select("sensor_id", "t_s", "value")


N = (
    R
    + """, a AS (SELECT sensor_id, row_idx, t_s, value FROM r WHERE channel = 'click'), b AS (SELECT sensor_id, t_s, value, row_idx FROM r WHERE channel = 'view'),
 x1 AS (SELECT a.*, b.t_s AS tp, b.value AS vp FROM a ASOF LEFT JOIN b ON a.sensor_id = b.sensor_id AND a.t_s >= b.t_s),
 x AS (SELECT x1.*, b.t_s AS tn, b.value AS vn FROM x1 ASOF LEFT JOIN b ON x1.sensor_id = b.sensor_id AND x1.t_s <= b.t_s),
 y AS (SELECT *, least(t_s - tp, tn - t_s) AS gap, CASE WHEN tn IS NULL OR t_s - tp <= tn - t_s THEN vp ELSE vn END AS near FROM x)"""
)
LINE = "CASE WHEN tp IS NULL OR tn IS NULL THEN near WHEN tn > tp THEN vp + (vn - vp) * (t_s - tp) / (tn - tp) ELSE vp END"
HEAD = " SELECT sensor_id, row_idx, round(CASE WHEN gap <= 43200 THEN %s END, 6) AS aligned, round(gap, 4) AS gap_s, tp IS NULL OR tn IS NULL AS extrapolated FROM y"


def aligned(s, d, **how):
    out = A.asof(left(s, d), right(s, d), KEY, max_gap_s=GAP, **how).select("sensor_id", "row_idx", "aligned", "gap_s", "extrapolated")
    return rounded(out.withColumn("gap_s", F.floor(F.col("gap_s") * 1e4 + 0.5001) / 1e4))


register("c01_asof_nearest", lambda s, d: aligned(s, d, how="nearest"), N + HEAD % "near")
register("c02_asof_linear", lambda s, d: aligned(s, d, how="linear"), N + HEAD % LINE)
register("c03_asof_linear_bracket", lambda s, d: aligned(s, d, how="linear", bracket_gap=True), N + HEAD % f"CASE WHEN coalesce(tn - tp, 0) <= 43200 THEN {LINE} END")
register("c04_hold_previous", lambda s, d: aligned(s, d, how="hold"), N + HEAD % "coalesce(vp, vn)")
register(
    "c05_window_mean_median",
    lambda s, d: rounded(A.window_aggregate(left(s, d), right(s, d), KEY, GAP)),
    N + " SELECT a.sensor_id, a.row_idx, count(*) AS n, round(avg(b.value), 6) AS mean, round(quantile_cont(b.value, 0.5), 6) AS median FROM a JOIN b ON a.sensor_id = b.sensor_id AND b.t_s BETWEEN a.t_s - 43200 AND a.t_s + 43200 GROUP BY ALL",
)
register(
    "c06_carry_forward",
    lambda s, d: rounded(A.carry_forward(A.asof(left(s, d), right(s, d), KEY, max_gap_s=GAP / 4), KEY, "aligned", ["t_s", "row_idx"]).select("sensor_id", "row_idx", "aligned")),
    N + ", z AS (SELECT *, CASE WHEN gap <= 10800 THEN near END AS v FROM y) SELECT sensor_id, row_idx, round(last_value(v IGNORE NULLS) OVER (PARTITION BY sensor_id ORDER BY t_s, row_idx), 6) AS aligned FROM z",
)
register(
    "c07_latest_event",
    lambda s, d: rounded(A.latest_event(left(s, d), right(s, d), KEY).select("sensor_id", "row_idx", "event_t", "event_value"), 4),
    N + " SELECT sensor_id, row_idx, round(tp, 4) AS event_t, round(vp, 4) AS event_value FROM x1",
)
register(
    "c08_fold_events",
    lambda s, d: rounded(A.fold_events(left(s, d), right(s, d), KEY).select("sensor_id", "row_idx", "n_events", "total", F.get("times", F.lit(0)).alias("first_t")), 4),
    N + """, g AS (SELECT *, lag(t_s) OVER (PARTITION BY sensor_id ORDER BY t_s, row_idx) AS t0 FROM a)
 SELECT g.sensor_id, g.row_idx, count(b.t_s) AS n_events, round(coalesce(sum(b.value), 0.0), 4) AS total, round(min(b.t_s), 4) AS first_t FROM g LEFT JOIN b ON g.sensor_id = b.sensor_id AND b.t_s <= g.t_s AND (g.t0 IS NULL OR b.t_s > g.t0) GROUP BY g.sensor_id, g.row_idx""",
)
register(
    "c09_previous_compatible",
    lambda s, d: rounded(A.previous_compatible(readings(s, d), KEY, "channel", ["t_s", "row_idx"]).select("sensor_id", "row_idx", "before")),
    R + " SELECT sensor_id, row_idx, round(lag(value) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx), 6) AS before FROM r",
)


def cut(s, d):
    events = part(s, d, "error").select("sensor_id", F.col("row_idx").alias("event_idx"), "t_s")
    rest = readings(s, d).where("channel <> 'error'").select("sensor_id", "t_s", "value", "row_idx")
    return A.cut_windows(events, rest, KEY, 86400.0, 172800.0, 86400.0)


C = R + """, e AS (SELECT sensor_id, row_idx AS event_idx, t_s FROM r WHERE channel = 'error'),
 w AS (SELECT e.sensor_id, e.event_idx, e.t_s AS event_t, r.t_s - e.t_s AS local, r.value AS v, CASE WHEN r.t_s - e.t_s >= 0 THEN 'response' ELSE 'baseline' END AS phase FROM e JOIN r ON r.sensor_id = e.sensor_id AND r.channel <> 'error' AND r.t_s BETWEEN e.t_s - 86400 AND e.t_s + 172800)"""
register(
    "c10_event_windows",
    lambda s, d: rounded(cut(s, d), 4),
    C + " SELECT sensor_id, event_idx, round(event_t, 4) AS event_t, round(local, 4) AS local, v, phase FROM w",
)
HOURS = R + ", h AS (SELECT sensor_id, channel, CAST(floor(t_s / 21600) AS BIGINT) AS h, avg(value) AS v FROM r GROUP BY ALL)"
register(
    "c11_equal_times",
    lambda s, d: rounded(_hourly(s, d, "click").join(_hourly(s, d, "view").withColumnRenamed("value", "other"), ["sensor_id", "h"])),
    HOURS + " SELECT a.sensor_id, a.h, round(a.v, 6) AS value, round(b.v, 6) AS other FROM h a JOIN h b ON a.sensor_id = b.sensor_id AND a.h = b.h AND a.channel = 'click' AND b.channel = 'view'",
)


def _hourly(s, d, channel):
    r = readings(s, d).where(F.col("channel") == channel)
    return r.groupBy("sensor_id", F.floor(F.col("t_s") / 21600).alias("h")).agg(F.avg("value").alias("value"))


register(
    "c12_lagged_correlation",
    lambda s, d: rounded(A.lagged_pairs(left(s, d), part(s, d, "view"), KEY, 21600.0, 2)),
    N + """, l AS (SELECT a.sensor_id, a.row_idx AS ia, lag, a.value AS va, arg_min(b.value, b.row_idx) AS vb FROM a, (VALUES (-2), (-1), (0), (1), (2)) f(lag), b
 WHERE a.sensor_id = b.sensor_id AND abs(b.t_s - (a.t_s + lag * 21600.0)) <= 10800 GROUP BY ALL)
 SELECT sensor_id, CAST(lag AS BIGINT) AS lag, count(*) AS n, round(CASE WHEN var_pop(va) > 0 AND var_pop(vb) > 0 THEN corr(va, vb) END, 6) AS r FROM l GROUP BY sensor_id, lag""",
)
register(
    "d27_event_baselines",
    lambda s, d: rounded(_baselines(s, d)),
    C + """, b AS (SELECT * FROM w WHERE phase = 'baseline'), m AS (SELECT sensor_id, event_idx, avg(local) AS mx, avg(v) AS my FROM b GROUP BY ALL)
 SELECT b.sensor_id, b.event_idx, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
 round(CASE WHEN count(*) >= 2 AND sum((local - mx) * (local - mx)) > 0 THEN any_value(my) - sum((local - mx) * (v - my)) / sum((local - mx) * (local - mx)) * any_value(mx) END, 6) AS line
 FROM b JOIN m USING (sensor_id, event_idx) GROUP BY b.sensor_id, b.event_idx""",
)


def _baselines(s, d):
    """Mean, median, and a line extrapolated to the event's time."""
    b = cut(s, d).where("phase = 'baseline'")
    k = ["sensor_id", "event_idx"]
    m = b.groupBy(k).agg(F.avg("local").alias("mx"), F.avg("v").alias("my"))
    dx = F.col("local") - F.col("mx")
    sxx = F.sum(dx * dx)
    line = F.when((F.count("*") >= 2) & (sxx > 0), F.first("my") - F.sum(dx * (F.col("v") - F.col("my"))) / sxx * F.first("mx"))
    return b.join(m, k).groupBy(k).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.5)).alias("median"), line.alias("line"))


TAUS = [3600.0 * 2**i for i in range(7)]


def response_grid(s, d):
    """Per event and time constant: y = y0 + a (1 - exp(-t / tau)) by normal equations on sums."""
    r = cut(s, d).where("phase = 'response'").select("sensor_id", "event_idx", "local", "v")
    g = r.withColumn("tau", F.explode(F.array(*map(F.lit, TAUS)))).withColumn("x", 1 - F.exp(-F.col("local") / F.col("tau")))
    k = ["sensor_id", "event_idx", "tau"]
    m = g.groupBy(k).agg(F.avg("x").alias("mx"), F.avg("v").alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("v") - F.col("my")
    f = g.join(m, k).groupBy(k).agg(F.count("*").alias("n"), F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy"), F.sum(dy * dy).alias("syy"), F.first("mx").alias("mx"), F.first("my").alias("my")).where("n >= 5 AND sxx > 1e-9")
    f = f.withColumn("a", F.col("sxy") / F.col("sxx")).withColumn("y0", F.col("my") - F.col("a") * F.col("mx"))
    return f.withColumn("rss", F.greatest(F.col("syy") - F.col("a") * F.col("sxy"), F.lit(1e-12)))


GRID = C + """, t(tau) AS (VALUES %s), g AS (SELECT sensor_id, event_idx, CAST(tau AS DOUBLE) AS tau, v, 1 - exp(-local / tau) AS x FROM w, t WHERE phase = 'response'),
 m AS (SELECT sensor_id, event_idx, tau, avg(x) AS mx, avg(v) AS my FROM g GROUP BY ALL),
 f AS (SELECT g.sensor_id, g.event_idx, g.tau, count(*) AS n, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (v - my)) AS sxy, sum((v - my) * (v - my)) AS syy, any_value(mx) AS mx, any_value(my) AS my FROM g JOIN m USING (sensor_id, event_idx, tau) GROUP BY ALL),
 h AS (SELECT *, sxy / sxx AS a, my - sxy / sxx * mx AS y0, greatest(syy - sxy / sxx * sxy, 1e-12) AS rss FROM f WHERE n >= 5 AND sxx > 1e-9)""" % ", ".join(f"({t})" for t in TAUS)
register(
    "g12_transient_fit",
    lambda s, d: rounded(response_grid(s, d).groupBy("sensor_id", "event_idx").agg(F.min_by(F.struct("n", "tau", "a", "y0", "rss"), F.struct("rss", "tau")).alias("b")).select("sensor_id", "event_idx", "b.*"), 4),
    GRID + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, event_idx ORDER BY rss, tau) AS i FROM h) SELECT sensor_id, event_idx, n, round(tau, 4) AS tau, round(a, 4) AS a, round(y0, 4) AS y0, round(rss, 4) AS rss FROM k WHERE i = 1",
)
register(
    "d17_fit_statistics",
    lambda s, d: rounded(_stats(response_grid(s, d)).select("sensor_id", "event_idx", "tau", "rmse", "aic", "aicc", "bic", "r2", "adj_r2"), 4),
    GRID + """ SELECT sensor_id, event_idx, tau, round(sqrt(rss / n), 4) AS rmse, round(n * ln(rss / n) + 6, 4) AS aic, round(CASE WHEN n > 4 THEN n * ln(rss / n) + 6 + 24.0 / (n - 4) END, 4) AS aicc, round(n * ln(rss / n) + 3 * ln(n), 4) AS bic,
 round(1 - rss / syy, 4) AS r2, round(CASE WHEN n > 4 THEN 1 - (rss / syy) * (n - 1) / (n - 4) END, 4) AS adj_r2 FROM h WHERE syy > 0""",
)


def _stats(f, k=3):
    """Information criteria of a fit with k parameters from n and rss."""
    n, rss = F.col("n").cast("double"), F.col("rss")
    aic = n * F.log(rss / n) + 2 * k
    return f.where("syy > 0").withColumns({
        "rmse": F.sqrt(rss / n), "aic": aic, "aicc": F.when(n > k + 1, aic + 2.0 * k * (k + 1) / (n - k - 1)), "bic": n * F.log(rss / n) + k * F.log(n),
        "r2": 1 - rss / F.col("syy"), "adj_r2": F.when(n > k + 1, 1 - rss / F.col("syy") * (n - 1) / (n - k - 1)),
    })


def ranked(f, key, criterion, name):
    """Delta to the best, Akaike weight, rank (ties: lower name), and whether a candidate is out of contention (delta over 10)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key)
    f = f.withColumn("delta", F.col(criterion) - F.min(criterion).over(w)).withColumn("_e", F.exp(-F.col("delta") / 2))
    return f.withColumns({"weight": F.col("_e") / F.sum("_e").over(w), "rank": F.row_number().over(w.orderBy(criterion, name)), "rejected": F.col("delta") > 10}).drop("_e")


register(
    "e10_model_ranking",
    lambda s, d: rounded(ranked(_stats(response_grid(s, d)), ["sensor_id", "event_idx"], "aic", "tau").select("sensor_id", "event_idx", "tau", "delta", "weight", "rejected"), 4),
    GRID + """, q AS (SELECT *, n * ln(rss / n) + 6 AS aic FROM h WHERE syy > 0), d AS (SELECT *, aic - min(aic) OVER (PARTITION BY sensor_id, event_idx) AS delta FROM q)
 SELECT sensor_id, event_idx, tau, round(delta, 4) AS delta, round(exp(-delta / 2) / sum(exp(-delta / 2)) OVER (PARTITION BY sensor_id, event_idx), 4) AS weight, delta > 10 AS rejected FROM d""",
)
register(
    "d40_pooled_time_constant",
    lambda s, d: rounded(response_grid(s, d).groupBy("sensor_id", "event_idx").agg(F.min_by("tau", F.struct("rss", "tau")).alias("tau")).groupBy("sensor_id").agg(F.min_by("tau", "event_idx").alias("first"), F.avg("tau").alias("mean"), F.percentile("tau", F.lit(0.5)).alias("median")), 4),
    GRID + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, event_idx ORDER BY rss, tau) AS i FROM h) SELECT sensor_id, round(arg_min(tau, event_idx), 4) AS first, round(avg(tau), 4) AS mean, round(quantile_cont(tau, 0.5), 4) AS median FROM k WHERE i = 1 GROUP BY sensor_id",
)
register(
    "g11_model_curve",
    lambda s, d: rounded(response_grid(s, d).groupBy("sensor_id", "event_idx").agg(F.min_by(F.struct("tau", "a", "y0"), F.struct("rss", "tau")).alias("b")).select("sensor_id", "event_idx", F.explode(F.array(*map(F.lit, (0.0, 3600.0, 86400.0)))).alias("t"), (F.col("b.y0") + F.col("b.a") * (1 - F.exp(-F.col("t") / F.col("b.tau")))).alias("single"), (F.col("b.a") / F.col("b.tau") * F.exp(-F.col("t") / F.col("b.tau"))).alias("rate")), 4),
    GRID + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, event_idx ORDER BY rss, tau) AS i FROM h) SELECT sensor_id, event_idx, CAST(t AS DOUBLE) AS t, round(y0 + a * (1 - exp(-t / tau)), 4) AS single, round(a / tau * exp(-t / tau), 4) AS rate FROM k, (VALUES (0.0), (3600.0), (86400.0)) f(t) WHERE i = 1",
)
register(
    "e21_time_to_fraction",
    lambda s, d: rounded(response_grid(s, d).groupBy("sensor_id", "event_idx").agg(F.min_by("tau", F.struct("rss", "tau")).alias("tau")).select("sensor_id", "event_idx", *((-F.col("tau") * F.log(F.lit(1 - p))).alias(n) for p, n in ((0.632, "t63"), (0.9, "t90"), (0.95, "t95")))), 4),
    GRID + ", k AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, event_idx ORDER BY rss, tau) AS i FROM h) SELECT sensor_id, event_idx, round(-tau * ln(1 - 0.632), 4) AS t63, round(-tau * ln(1 - 0.9), 4) AS t90, round(-tau * ln(1 - 0.95), 4) AS t95 FROM k WHERE i = 1",
)
