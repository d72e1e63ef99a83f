"""Registered filter, matching and power-spectrum queries."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators import assess
from sensorframe.operators import estimation as T
from sensorframe.operators import spectral as P

from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import R
from sensorframe.sources.views import SERIES, in_order, observations, readings

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
Q, RV = 0.001, 400.0


def filtered(s, d):
    r = readings(s, d).withColumn("value", F.when(F.col("row_idx") % 11 != 0, F.col("value")))
    return T.scalar_filter(r, SERIES, Q, RV)


FL = "WITH RECURSIVE r AS (SELECT user_id AS sensor_id, event_type AS channel, event_id AS row_idx, epoch_us(ts) / 1e6 AS t_s, CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM events)" + f""",
 i AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS i FROM r),
 f AS (SELECT sensor_id, channel, row_idx, i, t_s, v, coalesce(v, 0.0) AS x0, CAST(NULL AS DOUBLE) AS nu, CAST(NULL AS DOUBLE) AS s, coalesce(v, 0.0) AS x, CASE WHEN v IS NULL THEN 1e6 ELSE {RV} END AS p, 'initial' AS status FROM i WHERE i = 1
  UNION ALL SELECT sensor_id, channel, row_idx, i, t_s, v, x0, nu, s, CASE WHEN status = 'accepted' THEN x0 + pp / s * nu ELSE x0 END, CASE WHEN status = 'accepted' THEN (1 - pp / s) * pp * (1 - pp / s) + pp / s * {RV} * pp / s ELSE pp END, status
  FROM (SELECT i.sensor_id, i.channel, i.row_idx, i.i, i.t_s, i.v, f.x AS x0, i.v - f.x AS nu, CASE WHEN i.v IS NULL THEN NULL ELSE f.p + {Q} * greatest(0.0, i.t_s - f.t_s) + {RV} END AS s, f.p + {Q} * greatest(0.0, i.t_s - f.t_s) AS pp,
   CASE WHEN i.v IS NULL THEN 'predict_only' WHEN (i.v - f.x) * (i.v - f.x) / (f.p + {Q} * greatest(0.0, i.t_s - f.t_s) + {RV}) > 6.635 THEN 'rejected' ELSE 'accepted' END AS status FROM f JOIN i ON i.sensor_id = f.sensor_id AND i.channel = f.channel AND i.i = f.i + 1))"""
register(
    "h04_scalar_filter",
    lambda s, d: rounded(filtered(s, d).select(*SERIES, "row_idx", "predicted", "innovation", "innovation_var", "estimate", "variance", "status"), 4),
    FL + " SELECT sensor_id, channel, row_idx, round(x0, 4) AS predicted, round(nu, 4) AS innovation, round(s, 4) AS innovation_var, round(x, 4) AS estimate, round(p, 4) AS variance, status FROM f",
)
register(
    "d34_filter_diagnostics",
    lambda s, d: rounded(T.filter_diagnostics(filtered(s, d), SERIES), 4),
    FL + " SELECT sensor_id, channel, round(avg(nu), 4) AS innovation_mean, round(stddev_samp(nu), 4) AS innovation_sd, round(avg(nu * nu / s), 4) AS nis_mean, round(avg(CASE WHEN s IS NULL THEN NULL WHEN nu * nu / s > 3.841 THEN 1.0 ELSE 0.0 END), 4) AS exceedance, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'predict_only') AS predict_only FROM f GROUP BY sensor_id, channel",
)


def with_truth(s, d):
    """Filter rows beside a truth: the series' mean, in the order of the file, as first estimates can lie exactly on a limit."""
    f = filtered(s, d)
    m = in_order(readings(s, d), SERIES).groupBy(SERIES).agg(F.avg("value").alias("truth"))
    return f.join(m, SERIES)


TR = FL + ", m AS (SELECT user_id AS sensor_id, event_type AS channel, avg(value) AS truth FROM events GROUP BY ALL), a AS (SELECT f.*, truth FROM f JOIN m USING (sensor_id, channel))"
register(
    "d33_truth_errors",
    lambda s, d: rounded(T.error_metrics(with_truth(s, d), SERIES), 4),
    TR + " SELECT sensor_id, channel, count(*) AS n, round(sqrt(avg(power(x - truth, 2))), 4) AS rmse, round(avg(abs(x - truth)), 4) AS mae, round(avg(x - truth), 4) AS bias, round(max(abs(x - truth)), 4) AS max_error, round(avg(CASE WHEN abs(x - truth) <= 1.96 * sqrt(p) THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(power(x - truth, 2) / p), 4) AS nees FROM a GROUP BY sensor_id, channel",
)
register(
    "d35_filter_comparison",
    lambda s, d: rounded(T.error_metrics(with_truth(s, d), ["channel"]).select("channel", "n", "rmse", "mae", "coverage"), 4),
    TR + " SELECT channel, count(*) AS n, round(sqrt(avg(power(x - truth, 2))), 4) AS rmse, round(avg(abs(x - truth)), 4) AS mae, round(avg(CASE WHEN abs(x - truth) <= 1.96 * sqrt(p) THEN 1.0 ELSE 0.0 END), 4) AS coverage FROM a GROUP BY channel",
)
register(
    "e14_convergence_time",
    lambda s, d: rounded(T.convergence_time(with_truth(s, d), SERIES, 20.0, 3), 4),
    TR + ", k AS (SELECT *, sum(CASE WHEN abs(x - truth) <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 3 AS ok FROM a) SELECT sensor_id, channel, round(coalesce(min(t_s) FILTER (ok) - min(t_s), max(t_s) - min(t_s)), 4) AS convergence_s FROM k GROUP BY sensor_id, channel",
)
STEP = R + ", p AS (SELECT *, lag(value) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS b FROM r), j AS (SELECT sensor_id, channel, arg_max(t_s, (abs(value - b), -t_s)) AS t0, arg_max(b, (abs(value - b), -t_s)) AS v0, arg_max(value - b, (abs(value - b), -t_s)) AS jump FROM p WHERE b IS NOT NULL GROUP BY ALL)"
register(
    "e15_step_response_delay",
    lambda s, d: rounded(_delay(s, d), 4),
    STEP + " SELECT j.sensor_id, j.channel, round(any_value(jump), 4) AS jump, round(min(r.t_s) - any_value(t0), 4) AS delay_s FROM j LEFT JOIN r ON r.sensor_id = j.sensor_id AND r.channel = j.channel AND r.t_s > t0 AND (r.value - v0) * sign(jump) >= 0.5 * abs(jump) GROUP BY j.sensor_id, j.channel",
)


def _delay(s, d):
    """The largest step of each series, and the first later row past half of it."""
    r = readings(s, d)
    w = W.partitionBy(SERIES).orderBy("t_s", "row_idx")
    j = r.withColumn("b", F.lag("value").over(w)).where("b IS NOT NULL").groupBy(SERIES).agg(F.max_by(F.struct(F.col("t_s").alias("t0"), F.col("b").alias("v0"), (F.col("value") - F.col("b")).alias("jump")), F.struct(F.abs(F.col("value") - F.col("b")), -F.col("t_s"))).alias("j")).select(*SERIES, "j.*")
    late = r.join(j, SERIES).where("t_s > t0 AND (value - v0) * sign(jump) >= 0.5 * abs(jump)").groupBy(SERIES).agg(F.min("t_s").alias("t"))
    return j.join(late, SERIES, "left").select(*SERIES, "jump", (F.col("t") - F.col("t0")).alias("delay_s"))


register(
    "e16_innovation_autocorrelation",
    lambda s, d: rounded(_acf(s, d), 4),
    FL + ", g AS (SELECT sensor_id, channel, row_idx, t_s, nu - avg(nu) OVER (PARTITION BY sensor_id, channel) AS c FROM f WHERE nu IS NOT NULL), h AS (SELECT *, lag(c) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS b FROM g) SELECT sensor_id, channel, count(*) AS n, round(sum(c * b) / sum(c * c), 4) AS lag1, round(1.96 / sqrt(count(*)), 4) AS band FROM h GROUP BY sensor_id, channel HAVING sum(c * c) > 0",
)


def _acf(s, d):
    f = filtered(s, d).where("innovation IS NOT NULL")
    f = f.withColumn("c", F.col("innovation") - F.avg("innovation").over(W.partitionBy(SERIES)))
    f = f.withColumn("b", F.lag("c").over(W.partitionBy(SERIES).orderBy("t_s", "row_idx")))
    return f.groupBy(SERIES).agg(F.count("*").alias("n"), F.sum(F.col("c") * F.col("b")).alias("cb"), F.sum(F.col("c") ** 2).alias("cc")).where("cc > 0").select(*SERIES, "n", (F.col("cb") / F.col("cc")).alias("lag1"), (1.96 / F.sqrt("n")).alias("band"))


register(
    "h05_innovation_consistency",
    lambda s, d: rounded(filtered(s, d).where("nis IS NOT NULL").groupBy(SERIES).agg(F.count("*").alias("n"), F.avg("nis").alias("nis_mean")).select(*SERIES, "nis_mean", F.greatest(F.lit(0.0), 1 - 1.96 * F.sqrt(2 / F.col("n"))).alias("low"), (1 + 1.96 * F.sqrt(2 / F.col("n"))).alias("high")).withColumn("consistent", F.col("nis_mean").between(F.col("low"), F.col("high"))), 4),
    FL + ", k AS (SELECT sensor_id, channel, avg(nu * nu / s) AS m, greatest(0.0, 1 - 1.96 * sqrt(2 / count(*))) AS lo, 1 + 1.96 * sqrt(2 / count(*)) AS hi FROM f WHERE s IS NOT NULL GROUP BY ALL) SELECT sensor_id, channel, round(m, 4) AS nis_mean, round(lo, 4) AS low, round(hi, 4) AS high, m BETWEEN lo AND hi AS consistent FROM k",
)
register(
    "e19_environment_change",
    lambda s, d: rounded(readings(s, d).withColumn("b", F.lag("value").over(W.partitionBy(SERIES).orderBy("t_s", "row_idx"))).select(*SERIES, "row_idx", (F.abs(F.col("value") - F.col("b")) / F.greatest(F.abs("b"), F.lit(1.0))).alias("change"))),
    R + ", p AS (SELECT *, lag(value) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS b FROM r) SELECT sensor_id, channel, row_idx, round(abs(value - b) / greatest(abs(b), 1.0), 6) AS change FROM p",
)
register(
    "e22_initial_state",
    lambda s, d: rounded(readings(s, d).groupBy(SERIES).agg(F.min_by(F.when(F.col("value") > 100, F.col("value")), F.when(F.col("value") > 100, F.col("row_idx"))).alias("known"), F.min_by("value", "row_idx").alias("first")).select(*SERIES, F.coalesce("known", "first", F.lit(0.0)).alias("state"))),
    R + " SELECT sensor_id, channel, round(coalesce(arg_min(value, row_idx) FILTER (value > 100), arg_min(value, row_idx), 0.0), 6) AS state FROM r GROUP BY sensor_id, channel",
)
register(
    "b13_channel_scaling",
    lambda s, d: rounded(readings(s, d).select(*SERIES, "row_idx", (F.col("value") * 1e-3).alias("volts"), (F.col("value") * 0.01 * 1e-6).alias("variance")), 8),
    R + " SELECT sensor_id, channel, row_idx, round(value * 1e-3, 8) AS volts, round(value * 0.01 * 1e-6, 8) AS variance FROM r",
)
register(
    "b12_physical_guards",
    lambda s, d: observations(s, d).select("series", "o", "l", "p", F.when(F.col("w0") <= 0, "activity_not_positive").when(F.col("c0") <= 0, "temperature_not_positive").when(F.col("level") % 7 == 0, "charge_zero").otherwise("ok").alias("reason")),
    "SELECT l_suppkey AS series, l_orderkey AS o, l_linenumber AS l, l_partkey AS p, CASE WHEN l_discount <= 0 THEN 'activity_not_positive' WHEN l_tax <= 0 THEN 'temperature_not_positive' WHEN l_quantity % 7 = 0 THEN 'charge_zero' ELSE 'ok' END AS reason FROM lineitem",
)
register(
    "b01_channel_selection",
    lambda s, d: _selected(s, d),
    R + ", a(alias, channel, level) AS (VALUES ('click', 'click', 1), ('tap', 'click', 3), ('buy', 'purchase', 3), ('pay', 'purchase', 2), ('pay', 'signup', 2), ('view', 'view', 1), ('view', 'error', 3)), q(name) AS (VALUES ('click'), ('tap'), ('buy'), ('pay'), ('view'), ('none')),"
    " m AS (SELECT name, channel, level, min(level) OVER (PARTITION BY name) AS best FROM q LEFT JOIN a ON alias = name), u AS (SELECT name, any_value(channel) AS channel, count(channel) AS hits FROM m WHERE level = best OR level IS NULL GROUP BY name),"
    " c AS (SELECT channel, count(*) AS n FROM r GROUP BY channel) SELECT name, CASE WHEN hits = 0 THEN 'missing' WHEN hits > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN hits = 1 THEN n END AS rows FROM u LEFT JOIN c ON hits = 1 AND c.channel = u.channel",
)


def _selected(s, d):
    """Names resolved through alias levels; more than one hit at the best level is ambiguous."""
    a = s.createDataFrame([("click", "click", 1), ("tap", "click", 3), ("buy", "purchase", 3), ("pay", "purchase", 2), ("pay", "signup", 2), ("view", "view", 1), ("view", "error", 3)], "name string, channel string, level int")
    q = s.createDataFrame([(x,) for x in ("click", "tap", "buy", "pay", "view", "none")], "name string")
    m = q.join(a, "name", "left").withColumn("best", F.min("level").over(W.partitionBy("name"))).where("level = best OR level IS NULL")
    u = m.groupBy("name").agg(F.min("channel").alias("channel"), F.count("channel").alias("hits"))
    c = readings(s, d).groupBy("channel").agg(F.count("*").alias("n"))
    out = u.join(F.broadcast(c), "channel", "left")
    return out.select("name", F.when(F.col("hits") == 0, "missing").when(F.col("hits") > 1, "ambiguous").otherwise("resolved").alias("status"), F.when(F.col("hits") == 1, F.col("n")).alias("rows"))


def matched(s, d):
    """Clicks matched one to one with views of the sensor within six hours."""
    r = readings(s, d).select("sensor_id", "channel", F.col("row_idx").alias("id"), F.col("t_s").alias("x"))
    return T.match_ordered(r.where("channel = 'click'"), r.where("channel = 'view'"), ["sensor_id"], 21600.0)


def greedy_sql(left: str, right: str, key: str, tolerance: float) -> str:
    """CTEs of the same pairing: each left row in turn takes the first of its candidates that is not in the list of those taken."""
    return f""" lt AS (SELECT {key}, id, x, row_number() OVER (PARTITION BY {key} ORDER BY x, id) AS i FROM {left}),
 cd AS (SELECT l.{key} AS k, l.i, list({{'d': abs(l.x - b.x), 'rx': b.x, 'ri': b.id}} ORDER BY abs(l.x - b.x), b.x, b.id) AS c FROM lt l JOIN {right} b ON l.{key} = b.{key} AND abs(l.x - b.x) <= {tolerance!r} GROUP BY l.{key}, l.i),
 rows_ AS (SELECT lt.{key} AS k, lt.id, lt.i, coalesce(c, []) AS c FROM lt LEFT JOIN cd ON cd.k = lt.{key} AND cd.i = lt.i),
 step AS (SELECT k, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS li, NULL::BIGINT AS ri, NULL::DOUBLE AS d FROM (SELECT DISTINCT k FROM rows_)
 UNION ALL SELECT k, i, CASE WHEN f IS NULL THEN used ELSE list_append(used, f.ri) END, id, f.ri, f.d FROM (SELECT s.k, n.i, n.id, s.used, list_filter(n.c, lambda z: NOT list_contains(s.used, z.ri))[1] AS f FROM step s JOIN rows_ n ON n.k = s.k AND n.i = s.i + 1)),
 pairs AS (SELECT k AS {key}, li, ri, d FROM step WHERE ri IS NOT NULL)"""


CLICKS = R.replace("WITH r", "WITH RECURSIVE r") + ", cl AS (SELECT sensor_id, row_idx AS id, t_s AS x FROM r WHERE channel = 'click'), vw AS (SELECT sensor_id, row_idx AS id, t_s AS x FROM r WHERE channel = 'view'),"
register("c13_truth_alignment", lambda s, d: rounded(matched(s, d), 4), CLICKS + greedy_sql("cl", "vw", "sensor_id", 21600.0) + " SELECT sensor_id, li, ri, round(d, 4) AS d FROM pairs")


def aligned(s, d):
    """All clicks and views with what became of them: matched, or without a partner on their side."""
    r, m = readings(s, d), matched(s, d)
    own = lambda channel, side: r.where(F.col("channel") == channel).select("sensor_id", F.col("row_idx").alias(side), F.col("value").alias(f"{side}_value"))
    both = m.join(own("click", "li"), ["sensor_id", "li"], "full").join(own("view", "ri"), ["sensor_id", "ri"], "full")
    fate = F.when(F.col("li").isNull(), "unmatched_right").when(F.col("ri").isNull(), "unmatched_left").otherwise("matched")
    return both.select("sensor_id", "li", "ri", fate.alias("fate"), (F.col("li_value") - F.col("ri_value")).alias("error"))


register(
    "c13_alignment_fates",
    lambda s, d: rounded(aligned(s, d), 4),
    CLICKS + greedy_sql("cl", "vw", "sensor_id", 21600.0) + """, m AS (SELECT p.sensor_id, li, ri, a.value - b.value AS error FROM pairs p JOIN r a ON a.row_idx = li JOIN r b ON b.row_idx = ri)
 SELECT sensor_id, li, ri, 'matched' AS fate, round(error, 4) AS error FROM m UNION ALL SELECT sensor_id, id, NULL, 'unmatched_left', NULL FROM cl WHERE id NOT IN (SELECT li FROM m) UNION ALL SELECT sensor_id, NULL, id, 'unmatched_right', NULL FROM vw WHERE id NOT IN (SELECT ri FROM m)""",
)
LEVELS = """WITH RECURSIVE o AS (SELECT l_suppkey AS series, log10(l_quantity / 1000) AS x, l_extendedprice / 1e5 AS y, l_quantity AS level, lag(l_quantity) OVER w AS prev, row_number() OVER w AS id FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey)),
 dn AS (SELECT series, id, x FROM o WHERE level < prev), up AS (SELECT series, id, x FROM o WHERE level > prev),""" + greedy_sql("dn", "up", "series", 0.01) + ", h AS (SELECT p.series, li, ri, a.y - b.y AS difference FROM pairs p JOIN o a ON a.series = p.series AND a.id = li JOIN o b ON b.series = p.series AND b.id = ri)"
register("c14_hysteresis_pairs", lambda s, d: rounded(_hysteresis(s, d), 6), LEVELS + " SELECT series, li, ri, round(difference, 6) AS difference FROM h")
register(
    "d25_hysteresis_summary",
    lambda s, d: rounded(_hysteresis(s, d).groupBy("series").agg(F.count("*").alias("pairs"), F.avg("difference").alias("mean"), F.percentile("difference", F.lit(0.5)).alias("median"), F.max(F.abs("difference")).alias("largest"))),
    LEVELS + " SELECT series, count(*) AS pairs, round(avg(difference), 6) AS mean, round(quantile_cont(difference, 0.5), 6) AS median, round(max(abs(difference)), 6) AS largest FROM h GROUP BY series",
)


def _hysteresis(s, d):
    """Falling levels matched with rising ones at the same log activity."""
    o = observations(s, d)
    o = o.withColumn("prev", F.lag("level").over(W.partitionBy("series").orderBy("d", "o", "l", "p"))).withColumn("id", F.row_number().over(W.partitionBy("series").orderBy("d", "o", "l", "p")))
    m = T.match_ordered(o.where("level < prev").select("series", "id", "x"), o.where("level > prev").select("series", "id", "x"), ["series"], 0.01)
    y = o.select("series", "id", "y")
    m = m.join(y.toDF("series", "li", "down"), ["series", "li"]).join(y.toDF("series", "ri", "up"), ["series", "ri"])
    return m.select("series", "li", "ri", (F.col("down") - F.col("up")).alias("difference"))


def daily(s, d):
    """An evenly sampled series per channel: the mean of each six hours, counted from the channel's first."""
    h = readings(s, d).groupBy("channel", F.floor(F.col("t_s") / 21600).alias("i")).agg(F.avg("value").alias("value"))
    first = h.groupBy("channel").agg(F.min("i").alias("first"))
    return h.join(first, "channel").select("channel", (F.col("i") - F.col("first")).alias("i"), "value")


def psd(s, d):
    return P.welch(daily(s, d), ["channel"], 21600.0)


N = 16
WIN = f"(0.5 - 0.5 * cos(2 * {math.pi!r} * k / {N - 1}))"
PSD = R + f""", h0 AS (SELECT channel, CAST(floor(t_s / 21600) AS BIGINT) AS i, avg(value) AS v FROM r GROUP BY ALL), h AS (SELECT channel, i - min(i) OVER (PARTITION BY channel) AS i, v FROM h0),
 sg AS (SELECT channel, g, i - g * 8 AS k, v FROM (SELECT *, unnest([i // 8, i // 8 - 1]) AS g FROM h) WHERE g >= 0),
 ok AS (SELECT channel, g, avg(v) AS m FROM sg GROUP BY ALL HAVING count(*) = {N}), x AS (SELECT sg.channel, sg.g, k, (v - m) * {WIN} AS y FROM sg JOIN ok USING (channel, g)),
 ft AS (SELECT channel, g, bin, power(sum(y * cos(2 * {math.pi!r} * bin * k / {N})), 2) + power(sum(y * sin(2 * {math.pi!r} * bin * k / {N})), 2) AS a FROM x, (SELECT unnest(range(0, {N // 2 + 1})) AS bin) GROUP BY ALL),
 psd AS (SELECT channel, bin, avg(a * 21600 / (SELECT sum(power({WIN}, 2)) FROM (SELECT unnest(range(0, {N})) AS k)) * CASE WHEN bin IN (0, {N // 2}) THEN 1 ELSE 2 END) AS power, count(*) AS segments, bin / ({N} * 21600.0) AS hz FROM ft GROUP BY channel, bin)"""
register("g01_welch", lambda s, d: rounded(psd(s, d).select("channel", "bin", "power", "segments"), 1), PSD + " SELECT channel, bin, round(power, 1) AS power, segments FROM psd")
BANDS = [("slow", 0.0, 8e-6), ("fast", 8e-6, 3e-5)]
AREA = PSD + ", ar AS (SELECT channel, hz, lead(hz) OVER w AS hz2, (lead(hz) OVER w - hz) * (power + lead(power) OVER w) / 2 AS area FROM psd WINDOW w AS (PARTITION BY channel ORDER BY hz))"
register(
    "g02_band_power",
    lambda s, d: rounded(P.band_power(psd(s, d), ["channel"], BANDS), 4),
    AREA + ", t AS (SELECT channel, sum(area) AS total FROM ar GROUP BY channel) SELECT ar.channel, band, round(sum(area), 4) AS power, round(sum(area) / any_value(total), 4) AS share FROM ar JOIN t USING (channel), (VALUES ('slow', 0.0, 8e-6), ('fast', 8e-6, 3e-5)) b(band, lo, hi) WHERE hz2 > lo AND hz < hi GROUP BY ar.channel, band",
)
register(
    "e17_psd_peaks",
    lambda s, d: rounded(P.peaks(psd(s, d), ["channel"], 5).select("channel", "bin", "power", "place"), 1),
    PSD + ", n AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS b FROM psd WINDOW w AS (PARTITION BY channel ORDER BY hz)), k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY power DESC, hz) AS place FROM n WHERE power >= a AND power >= b) SELECT channel, bin, round(power, 1) AS power, place FROM k WHERE place <= 5",
)
register(
    "e18_roll_off",
    lambda s, d: rounded(P.roll_off(psd(s, d), ["channel"]).select("channel", (F.col("centroid_hz") * 1e6).alias("centroid_uhz"), (F.col("roll_off_hz") * 1e6).alias("roll_off_uhz")), 4),
    PSD + ", a AS (SELECT *, coalesce((hz - lag(hz) OVER w) * (power + lag(power) OVER w) / 2, 0.0) AS area FROM psd WINDOW w AS (PARTITION BY channel ORDER BY hz)), c AS (SELECT *, sum(area) OVER (PARTITION BY channel ORDER BY hz) AS run, sum(area) OVER (PARTITION BY channel) AS whole FROM a) SELECT channel, round(1e6 * sum(hz * power) / sum(power), 4) AS centroid_uhz, round(1e6 * min(hz) FILTER (run >= 0.9 * whole), 4) AS roll_off_uhz FROM c GROUP BY channel",
)
register(
    "g03_parseval",
    lambda s, d: rounded(P.roll_off(psd(s, d), ["channel"]).join(daily(s, d).groupBy("channel").agg(F.var_pop("value").alias("var")), "channel").select("channel", (F.abs(F.col("total_power") - F.col("var")) / F.col("var")).alias("gap")), 4),
    AREA + ", t AS (SELECT channel, sum(area) AS total FROM ar GROUP BY channel), v AS (SELECT channel, var_pop(v) AS var FROM h GROUP BY channel) SELECT channel, round(abs(total - var) / var, 4) AS gap FROM t JOIN v USING (channel)",
)
register(
    "a05_ingest_diagnostics",
    lambda s, d: _issues(s, d),
    "SELECT user_id AS file, count(*) AS total, count(*) FILTER (event_id % 17 = 0) AS missing, count(*) FILTER (event_id % 19 = 0 AND event_id % 17 <> 0) AS malformed, count(*) FILTER (event_id % 17 <> 0 AND event_id % 19 <> 0) AS parsed FROM events GROUP BY user_id",
)


def _issues(s, d):
    """Tokens that are missing, malformed or numbers, counted per file."""
    r = readings(s, d).withColumn("token", F.when(F.col("row_idx") % 17 == 0, "n/a").when(F.col("row_idx") % 19 == 0, "1.2.3").otherwise(F.col("value").cast("string")))
    missing = F.lower(F.trim("token")).isin("", "na", "n/a", "nan", "null", "missing")
    number = F.expr("try_cast(token AS DOUBLE)")
    return r.groupBy(F.col("sensor_id").alias("file")).agg(F.count("*").alias("total"), F.count_if(missing).alias("missing"), F.count_if(~missing & number.isNull()).alias("malformed"), F.count_if(~missing & number.isNotNull()).alias("parsed"))


register(
    "a12_content_digest",
    lambda s, d: assess.content_digest(readings(s, d), ["sensor_id"], "row_idx", ["channel", "t_s", "value"]),
    R + """, c AS (SELECT sensor_id, row_idx % 64 AS chunk, lpad(CAST(row_idx AS VARCHAR), 19, '0') || '|' || channel || '|' || CAST(CAST(floor(t_s * 1e6 + 0.5) AS BIGINT) AS VARCHAR) || '|' || coalesce(CAST(CAST(floor(value * 1e6 + 0.5) AS BIGINT) AS VARCHAR), 'null') AS line FROM r),
 k AS (SELECT sensor_id, chunk, sha256(string_agg(line, chr(10) ORDER BY line)) AS part FROM c GROUP BY ALL) SELECT sensor_id, sha256(string_agg(part, chr(10) ORDER BY chunk)) AS digest FROM k GROUP BY sensor_id""",
)
