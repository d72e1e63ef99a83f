"""Registered evidence, gate, bootstrap and steady-state queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators import align as A
from sensorframe.operators import series as S
from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import R
from sensorframe.sources.views import SERIES, observations, readings, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

EVID = "e AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS target, l_returnflag AS scope, l_quantity AS value, CASE l_linenumber % 3 WHEN 0 THEN 'mV' WHEN 1 THEN 'V' ELSE 's' END AS unit, l_discount > 0 AS available, l_tax AS strength, l_shipdate AS seen FROM lineitem)"
ID = ["o", "l", "p", "target"]


def evidence(s, d):
    li = table(s, d, "lineitem")
    unit = F.when(F.col("l_linenumber") % 3 == 0, "mV").when(F.col("l_linenumber") % 3 == 1, "V").otherwise("s")
    return li.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("scope"), F.col("l_quantity").alias("value"), unit.alias("unit"), (F.col("l_discount") > 0).alias("available"), F.col("l_tax").alias("strength"), F.col("l_shipdate").alias("seen"))


register(
    "b11_eligible_evidence",
    lambda s, d: evidence(s, d).select(*ID, F.when(~F.col("available"), "unavailable").when(F.col("scope") == "R", "scope").when(F.col("unit") == "s", "unit").when(F.col("value") < 3, "out_of_range").otherwise("eligible").alias("reason")),
    "WITH " + EVID + " SELECT o, l, p, target, CASE WHEN NOT available THEN 'unavailable' WHEN scope = 'R' THEN 'scope' WHEN unit = 's' THEN 'unit' WHEN value < 3 THEN 'out_of_range' ELSE 'eligible' END AS reason FROM e",
)
SCOPES = [("specific", "A", "x"), ("all", None, "y"), ("unspecified", None, "z"), ("specific", "N", "w")]
register(
    "c17_scope_join",
    lambda s, d: _scopes(s, d),
    "WITH " + EVID + ", q(kind, want, name) AS (VALUES ('specific', 'A', 'x'), ('all', NULL, 'y'), ('unspecified', NULL, 'z'), ('specific', 'N', 'w')) SELECT target, name, count(*) AS n FROM (SELECT target, CASE WHEN l % 7 = 0 THEN NULL ELSE scope END AS scope FROM e) e JOIN q ON (kind = 'specific' AND scope = want) OR (kind = 'all' AND scope IS NOT NULL) OR (kind = 'unspecified' AND scope IS NULL) GROUP BY ALL",
)


def _scopes(s, d):
    """A specific scope meets its equal, all meets every specific one, unspecified meets itself alone."""
    q = s.createDataFrame(SCOPES, "kind string, want string, name string")
    e = evidence(s, d).select("target", F.when(F.col("l") % 7 != 0, F.col("scope")).alias("scope"))
    fits = ((F.col("kind") == "specific") & (F.col("scope") == F.col("want"))) | ((F.col("kind") == "all") & F.col("scope").isNotNull()) | ((F.col("kind") == "unspecified") & F.col("scope").isNull())
    return e.join(F.broadcast(q), fits).groupBy("target", "name").agg(F.count("*").alias("n"))


register(
    "c19_pair_candidates",
    lambda s, d: rounded(_sides(s, d, "A", "left_").join(_sides(s, d, "N", "right_"), "target").select("target", "left_n", "right_n", (F.col("left_best") - F.col("right_best")).alias("gap"))),
    "WITH " + EVID + ", g AS (SELECT target, scope, count(*) AS n, max(value) AS best FROM e WHERE available GROUP BY ALL) SELECT a.target, a.n AS left_n, b.n AS right_n, round(a.best - b.best, 6) AS gap FROM g a JOIN g b ON a.target = b.target AND a.scope = 'A' AND b.scope = 'N'",
)


def _sides(s, d, scope, name):
    return evidence(s, d).where((F.col("scope") == scope) & F.col("available")).groupBy("target").agg(F.count("*").alias(f"{name}n"), F.max("value").alias(f"{name}best"))


register(
    "d36_repeatability",
    lambda s, d: rounded(evidence(s, d).where("available").groupBy("target", "scope").agg(F.count("*").alias("n"), F.stddev_samp(F.log("value")).alias("sd_log")).where("n >= 3")),
    "WITH " + EVID + " SELECT target, scope, count(*) AS n, round(stddev_samp(ln(value)), 6) AS sd_log FROM e WHERE available GROUP BY target, scope HAVING count(*) >= 3",
)
register(
    "e20_history",
    lambda s, d: evidence(s, d).where("strength > 0.05").groupBy("target", "seen").agg(F.min("scope").alias("level")).withColumns({"index": F.row_number().over(W.partitionBy("target").orderBy("seen")).cast("bigint"), "prior": F.lag("level").over(W.partitionBy("target").orderBy("seen"))}).select("target", "index", "level", "prior"),
    "WITH " + EVID + ", h AS (SELECT target, seen, min(scope) AS level FROM e WHERE strength > 0.05 GROUP BY target, seen) SELECT target, row_number() OVER (PARTITION BY target ORDER BY seen) AS index, level, lag(level) OVER (PARTITION BY target ORDER BY seen) AS prior FROM h",
)
register(
    "g10_delta_method",
    lambda s, d: rounded(evidence(s, d).groupBy("target").agg(F.var_samp("value").alias("va"), F.var_samp("strength").alias("vb"), F.covar_samp("value", "strength").alias("c")).select("target", F.aggregate(F.zip_with(F.array(F.lit(0.5) * F.lit(0.5), F.lit(4.0), F.lit(2 * 0.5 * 2.0)), F.array("va", "vb", "c"), lambda g, v: g * v), F.lit(0.0), lambda a, x: a + x).alias("variance"))),
    "WITH " + EVID + " SELECT target, round(0.25 * var_samp(value) + 4 * var_samp(strength) + 2 * covar_samp(value, strength), 6) AS variance FROM e GROUP BY target",
)
register(
    "i23_cross_covariance",
    lambda s, d: rounded(_cross(s, d)),
    "WITH " + EVID + " SELECT target, round(2.0 * 0.5 * var_samp(value) + 2.0 * 3.0 * covar_samp(value, strength) + (-1.0) * 0.5 * covar_samp(value, strength) + (-1.0) * 3.0 * var_samp(strength), 6) AS covariance FROM e GROUP BY target",
)


def _cross(s, d):
    """Sum of g_i C_ij h_j with the covariance as labelled rows; labels, not positions, are matched."""
    c = evidence(s, d).groupBy("target").agg(F.var_samp("value").alias("vv"), F.covar_samp("value", "strength").alias("vs"), F.var_samp("strength").alias("ss"))
    rows = c.select("target", F.explode(F.array(*(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(v).alias("c")) for a, b, v in (("value", "value", "vv"), ("value", "strength", "vs"), ("strength", "value", "vs"), ("strength", "strength", "ss"))))).alias("r")).select("target", "r.*")
    g = s.createDataFrame([("value", 2.0), ("strength", -1.0)], "row string, g double")
    h = s.createDataFrame([("strength", 3.0), ("value", 0.5)], "col string, h double")
    return rows.join(F.broadcast(g), "row").join(F.broadcast(h), "col").groupBy("target").agg(F.sum(F.col("g") * F.col("c") * F.col("h")).alias("covariance"))


register(
    "i14_identifiability",
    lambda s, d: rounded(evidence(s, d).groupBy("target").agg(F.max("value").alias("hi"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).select("target", (F.col("hi") / F.col("mean")).alias("ratio"), (F.col("hi") / F.col("mean") >= 1.9).alias("passes"))),
    "WITH " + EVID + " SELECT target, round(max(value) / avg(value), 6) AS ratio, max(value) / avg(value) >= 1.9 AS passes FROM e GROUP BY target",
)
register(
    "i19_variance_source",
    lambda s, d: rounded(evidence(s, d).select(*ID, F.least(F.greatest(F.coalesce(F.when(F.col("available"), F.col("strength") ** 2), F.when(F.col("scope") == "A", F.lit(0.01)), F.lit(0.1)) * F.when(F.col("value") > 45, 4.0).otherwise(1.0), F.lit(1e-4)), F.lit(0.02)).alias("variance"))),
    "WITH " + EVID + " SELECT o, l, p, target, round(least(greatest(coalesce(CASE WHEN available THEN strength * strength END, CASE WHEN scope = 'A' THEN 0.01 END, 0.1) * CASE WHEN value > 45 THEN 4.0 ELSE 1.0 END, 1e-4), 0.02), 6) AS variance FROM e",
)
register(
    "i21_evidence_rows",
    lambda s, d: rounded(S.describe(readings(s, d), SERIES).select(*SERIES, "mean", "median", "sd").unpivot(SERIES, ["mean", "median", "sd"], "quantity", "value").select(*SERIES, "quantity", "value", F.when(F.col("value").isNull(), "unavailable").otherwise("available").alias("availability")), 5),
    R + ", a AS (SELECT sensor_id, channel, avg(value) AS mean, quantile_cont(value, 0.5) AS median, stddev_samp(value) AS sd FROM r GROUP BY ALL), u AS (SELECT sensor_id, channel, 'mean' AS quantity, mean AS value FROM a UNION ALL SELECT sensor_id, channel, 'median', median FROM a UNION ALL SELECT sensor_id, channel, 'sd', sd FROM a) SELECT sensor_id, channel, quantity, round(value, 5) AS value, CASE WHEN value IS NULL THEN 'unavailable' ELSE 'available' END AS availability FROM u",
)
register(
    "i22_evidence_constraints",
    lambda s, d: evidence(s, d).groupBy("o", "l").agg(F.count("*").alias("c")).agg(F.count("*").alias("ids"), F.count_if(F.col("c") > 1).alias("repeated"), F.sum("c").alias("rows")),
    "WITH " + EVID + ", g AS (SELECT o, l, count(*) AS c FROM e GROUP BY ALL) SELECT count(*) AS ids, count(*) FILTER (c > 1) AS repeated, CAST(sum(c) AS BIGINT) AS rows FROM g",
)
register(
    "i25_input_compatibility",
    lambda s, d: _compatible(s, d),
    "SELECT l.l_orderkey AS o, l.l_linenumber AS l, l.l_partkey AS p, l.l_suppkey AS target, CASE WHEN o_orderkey IS NULL THEN 'legacy' WHEN o_custkey % 10 <> l_suppkey % 10 THEN 'experiment' WHEN o_orderstatus <> l_linestatus THEN 'channel' ELSE 'compatible' END AS axis FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey",
)


def _compatible(s, d):
    """The first axis on which two inputs differ; an unknown counterpart passes as legacy."""
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left")
    axis = F.when(F.col("o_orderkey").isNull(), "legacy").when(F.col("o_custkey") % 10 != F.col("l_suppkey") % 10, "experiment").when(F.col("o_orderstatus") != F.col("l_linestatus"), "channel").otherwise("compatible")
    return j.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("target"), axis.alias("axis"))


register(
    "i20_report_table",
    lambda s, d: rounded(evidence(s, d).groupBy("target").agg(F.count("*").alias("rows"), F.count_if("available").alias("available"), F.avg("strength").alias("strength"), F.max("seen").cast("string").alias("latest")).select("target", "rows", "available", "strength")),
    "WITH " + EVID + " SELECT target, count(*) AS rows, count(*) FILTER (available) AS available, round(avg(strength), 6) AS strength FROM e GROUP BY target",
)


def steady(s, d):
    """Readings of the day after each event with their statistics, and why a window is not steady."""
    r = readings(s, d)
    events = r.where("channel = 'error'").select("sensor_id", F.col("row_idx").alias("event_idx"), "t_s")
    w = A.within(events, r.where("channel <> 'error'").select("sensor_id", "t_s", "value"), ["sensor_id"], 0.0, 172800.0)
    w = w.select("sensor_id", "event_idx", (F.col("t") - F.col("t_s")).alias("x"), F.col("v").alias("y"))
    g = w.groupBy("sensor_id", "event_idx").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.percentile("y", F.lit(0.5)).alias("median"), F.stddev_samp("y").alias("sd"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"))
    slope = F.try_divide("c", "v")
    reason = F.when(F.col("n") < 4, "too_few").when(F.abs(slope) * 86400 > 60, "unstable_slope").when(F.col("sd") > 45, "too_noisy").otherwise("steady")
    return g.select("sensor_id", "event_idx", "n", "mean", "median", (F.col("sd") / F.sqrt("n")).alias("se"), (slope * 86400).alias("slope_per_day"), reason.alias("reason"))


register(
    "d26_steady_state",
    lambda s, d: rounded(steady(s, d), 4),
    R + """, e AS (SELECT sensor_id, row_idx AS event_idx, t_s FROM r WHERE channel = 'error'), w AS (SELECT e.sensor_id, event_idx, r.t_s - e.t_s AS x, r.value AS y FROM e JOIN r ON r.sensor_id = e.sensor_id AND r.channel <> 'error' AND r.t_s BETWEEN e.t_s AND e.t_s + 172800),
 g AS (SELECT sensor_id, event_idx, count(*) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS median, stddev_samp(y) AS sd, CASE WHEN var_pop(x) > 0 THEN covar_pop(x, y) / var_pop(x) END AS slope FROM w GROUP BY ALL)
 SELECT sensor_id, event_idx, n, round(mean, 4) AS mean, round(median, 4) AS median, round(sd / sqrt(n), 4) AS se, round(slope * 86400, 4) AS slope_per_day, CASE WHEN n < 4 THEN 'too_few' WHEN abs(slope) * 86400 > 60 THEN 'unstable_slope' WHEN sd > 45 THEN 'too_noisy' ELSE 'steady' END AS reason FROM g""",
)
register(
    "e07_reset_crossing",
    lambda s, d: readings(s, d).withColumn("t_s", F.col("t_s") - F.when(F.col("row_idx") % 97 == 0, 86400.0).otherwise(0.0)).withColumn("back", F.lag("t_s").over(W.partitionBy(SERIES).orderBy("row_idx")) - F.col("t_s")).groupBy(*SERIES).agg((F.coalesce(F.max("back"), F.lit(0.0)) >= 3600).alias("crosses")),
    R + ", s AS (SELECT sensor_id, channel, row_idx, t_s - CASE WHEN row_idx % 97 = 0 THEN 86400.0 ELSE 0.0 END AS t_s FROM r), b AS (SELECT *, lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY row_idx) - t_s AS back FROM s) SELECT sensor_id, channel, coalesce(max(back), 0.0) >= 3600 AS crosses FROM b GROUP BY sensor_id, channel",
)
register(
    "i09_environment_robustness",
    lambda s, d: rounded(_robust(s, d)),
    R + """, x AS (SELECT sensor_id, row_idx, value, t_s - floor(t_s / 86400) * 86400 AS c FROM r), k AS (SELECT *, rank() OVER (PARTITION BY sensor_id ORDER BY value) + (count(*) OVER (PARTITION BY sensor_id, value) - 1) / 2 AS a, rank() OVER (PARTITION BY sensor_id ORDER BY c) + (count(*) OVER (PARTITION BY sensor_id, c) - 1) / 2 AS b FROM x)
 SELECT sensor_id, count(*) AS n, round(CASE WHEN count(*) >= 20 AND max(c) - min(c) > 3600 THEN abs(corr(a, b)) END, 6) AS rho FROM k GROUP BY sensor_id""",
)


def _robust(s, d):
    """Absolute tie-averaged rank correlation of the value with the time of day, once range and count suffice."""
    x = readings(s, d).withColumn("c", F.col("t_s") - F.floor(F.col("t_s") / 86400) * 86400)

    def rank(v):
        return F.rank().over(W.partitionBy("sensor_id").orderBy(v)) + (F.count("*").over(W.partitionBy("sensor_id", v)) - 1) / 2

    k = x.withColumns({"a": rank("value"), "b": rank("c")}).groupBy("sensor_id")
    return k.agg(F.count("*").alias("n"), F.when((F.count("*") >= 20) & (F.max("c") - F.min("c") > 3600), F.abs(S.pearson("a", "b"))).alias("rho"))


register(
    "g19_compatibility_share",
    lambda s, d: rounded(compatibility(s, d, 200)),
    R + """, m AS (SELECT sensor_id, channel, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS se FROM r WHERE channel IN ('click', 'view') GROUP BY ALL HAVING count(*) >= 2), p AS (SELECT a.sensor_id, a.mean AS a, a.se AS sa, b.mean AS b, b.se AS sb FROM m a JOIN m b ON a.sensor_id = b.sensor_id AND a.channel = 'click' AND b.channel = 'view'),
 u AS (SELECT p.*, (CAST('0x' || substr(md5('7:r:' || sensor_id || ':' || k), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS ur, (CAST('0x' || substr(md5('7:t:' || sensor_id || ':' || k), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS ut FROM p, range(1, 201) t(k)),
 q AS (SELECT sensor_id, a + sa * sqrt(-2 * ln(ur)) * cos(2 * pi() * ut) AS x, b + sb * sqrt(-2 * ln(ur)) * sin(2 * pi() * ut) AS y FROM u) SELECT sensor_id, round(avg(CASE WHEN greatest(x, y) <= 1.2 * least(x, y) AND least(x, y) > 0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM q GROUP BY sensor_id""",
)


def compatibility(s, d, draws, seed=7):
    """Share of normal draws of two means whose ratio is within 1.2, from hashed uniforms."""
    m = S.describe(readings(s, d), SERIES).select(*SERIES, "mean", (F.col("sd") / F.sqrt("n")).alias("se")).where("channel IN ('click', 'view') AND se IS NOT NULL")
    p = m.where("channel = 'click'").select("sensor_id", F.col("mean").alias("a"), F.col("se").alias("sa")).join(m.where("channel = 'view'").select("sensor_id", F.col("mean").alias("b"), F.col("se").alias("sb")), "sensor_id")

    def uniform(tag):
        text = F.concat_ws(":", F.lit(seed), F.lit(tag), F.col("sensor_id").cast("string"), F.col("k").cast("string"))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)

    k = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("k"))
    r, t = F.sqrt(-2 * F.log(uniform("r"))), 2 * F.pi() * uniform("t")
    k = k.withColumns({"x": F.col("a") + F.col("sa") * r * F.cos(t), "y": F.col("b") + F.col("sb") * r * F.sin(t)})
    return k.groupBy("sensor_id").agg(F.avg(((F.greatest("x", "y") <= 1.2 * F.least("x", "y")) & (F.least("x", "y") > 0)).cast("double")).alias("share"))
