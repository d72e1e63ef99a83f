"""Registered composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.operators import calibration as C
from sensorframe.operators import jobs as J
from sensorframe.operators import linear as L
from sensorframe.operators import timescales as X
from sensorframe.operators import transient as T
from sensorframe.plans import q_models as Q
from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import R
from sensorframe.sources.storage import written
from sensorframe.sources.views import SERIES, readings, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
#: Robust z of each value in a window of seven rows, in the order of t_s and row_idx per k.
SPIKES = """{n}w AS (SELECT *, median(v) OVER win AS m, list(v) OVER win AS near FROM {t} WINDOW win AS (PARTITION BY {k} ORDER BY t_s, row_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 {n}k AS (SELECT *, list_median(list_transform(near, lambda x: abs(x - m))) AS mad FROM {n}w), {n} AS (SELECT {k}, avg(CASE WHEN CASE WHEN mad > 0 THEN abs(v - m) / (1.4826 * mad) WHEN abs(v - m) > 0 THEN 1e12 ELSE 0.0 END > 3 THEN 1.0 ELSE 0.0 END) AS spike_share FROM {n}k GROUP BY {k})"""


def compared(s, d):
    """Each sensor's clicks and views as records of its third's category, and a record of a series that is not there."""
    r = written(readings(s, d), "readings")
    m = r.where("channel IN ('click', 'view')").select(*SERIES).distinct().select(*SERIES, F.concat_ws("-", "sensor_id", "channel").alias("record"), F.concat(F.col("channel"), (F.col("sensor_id") % 3).cast("string")).alias("category"))
    m = m.union(m.where("channel = 'view'").select(F.col("sensor_id"), F.lit("gone"), F.concat(F.lit("gone-"), F.col("sensor_id")), F.lit("gone")))
    return J.compare_series(r, m, SERIES)


register(
    "l02_compare_series",
    lambda s, d: rounded(compared(s, d).withColumn("drift", F.col("drift") * 86400), 5),
    R + ", x AS (SELECT *, value AS v FROM r WHERE channel IN ('click', 'view')), " + SPIKES.format(n="sp", t="x", k="sensor_id, channel") + """,
 a AS (SELECT sensor_id, channel, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, median(v) AS med, CASE WHEN var_pop(t_s) > 0 AND count(*) >= 2 THEN covar_pop(t_s - 1704067200, v) / var_pop(t_s - 1704067200) END AS drift FROM x GROUP BY ALL), q AS (SELECT sensor_id, channel, 1.4826 * median(abs(v - med)) AS robust_sd FROM x JOIN a USING (sensor_id, channel) GROUP BY ALL),
 i AS (SELECT sensor_id, channel, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS dt FROM x), w AS (SELECT sensor_id, channel, array_to_string(list_filter([CASE WHEN stddev_samp(dt) / avg(dt) > 0.5 THEN 'irregular' END, CASE WHEN count(*) < 16 THEN 'short' END, CASE WHEN max(dt) > 432000 THEN 'gap' END], lambda z: z IS NOT NULL), ',') AS warnings FROM i GROUP BY ALL),
 j AS (SELECT *, channel || (sensor_id % 3) AS category, sensor_id || '-' || channel AS record FROM a JOIN q USING (sensor_id, channel) JOIN w USING (sensor_id, channel) JOIN sp USING (sensor_id, channel))
 SELECT category, sensor_id, channel, record, n, round(mean, 5) AS mean, round(sd, 5) AS sd, round(robust_sd, 5) AS robust_sd, round(drift * 86400, 5) AS drift, round(spike_share, 5) AS spike_share, warnings, round((mean - avg(mean) OVER c) / stddev_samp(mean) OVER c, 5) AS z FROM j WINDOW c AS (PARTITION BY category)
 UNION ALL SELECT 'gone', sensor_id, 'gone', 'gone-' || sensor_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM a WHERE channel = 'view'""",
)


def residuals(s, d):
    """What the selected response of each sensor and the selected calibration of each series leave."""
    p = Q.responses(s, d)
    best = T.select_model(T.fit_responses(p, Q.SENSOR, grid=Q.GRID), Q.SENSOR).where("selected")
    a = p.join(best, Q.SENSOR).select(F.lit("response").alias("source"), F.col("sensor_id").alias("record"), "row_idx", F.col("local").alias("t_s"), (F.col("v") - T.response(F.col("local"))).alias("r"))
    fit = C.fit_calibrations(Q.rows(s, d), Q.KEY, ["level"]).where("selected")
    fit = fit.select(*Q.KEY, F.col("model").alias("chosen"), F.col("intercept").alias("f0"), *(F.coalesce(f"b{j}", F.lit(0.0)).alias(f"f{j}") for j in (1, 2, 3)))
    # observations lie by series; only their selected model's rows are made again
    rows = L.expand(Q.obs(s, d).join(fit, Q.KEY), Q.MODELS, "y", "w", [*Q.KEY, *Q.ORDER, *fit.columns[1:]]).where("model = chosen")
    left = F.col("t") - F.col("f0") - sum(F.col(f"f{j}") * F.col(f"z{j}") for j in (1, 2, 3))
    number = F.col("part") * 1000 + F.col("l") * 100 + F.col("level").cast("bigint")
    return a, rows.select(F.lit("calibration").alias("source"), F.col("series").alias("record"), number.alias("row_idx"), F.col("o").cast("double").alias("t_s"), left.alias("r"))


def residual_reports(s, d):
    """A report each, as the residuals of calibrations lie by their record already."""
    a, b = (J.residual_report(x) for x in residuals(s, d))
    return a.unionByName(b)


_LEFT = f"""SELECT * FROM ({Q.RESPONSES} SELECT 'response' AS source, p.sensor_id AS record, row_idx, local AS t_s, p.v - (b0 + b1 * exp(-power(local / tf, beta)) + b2 * exp(-local / ts) + dr * local) AS v FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY aic, CASE model WHEN 'single' THEN 0 WHEN 'double' THEN 1 WHEN 'double_drift' THEN 2 ELSE 3 END) = 1) f JOIN p USING (sensor_id))
 UNION ALL SELECT * FROM ({Q.FITS}, s AS (SELECT *, place = max(CASE WHEN delta < 1e-12 THEN place END) OVER (PARTITION BY series) AS chosen FROM q) SELECT 'calibration', e.series, e.part * 1000 + e.l * 100 + e.level::BIGINT, e.o::DOUBLE, t - s.b0 - s.b1 * z1 - s.b2 * z2 FROM e JOIN s ON s.series = e.series AND s.model = e.model AND chosen)"""
register(
    "l03_residual_report",
    lambda s, d: rounded(residual_reports(s, d).withColumn("drift", F.col("drift") * 1e6), 3),
    "WITH x AS (" + _LEFT + "), " + SPIKES.format(n="sp", t="x", k="source, record") + """, m AS (SELECT *, avg(v) OVER (PARTITION BY source, record) AS mean FROM x), c AS (SELECT *, v - mean AS c, lag(v) OVER o AS p, lag(v - mean) OVER o AS pc FROM m WINDOW o AS (PARTITION BY source, record ORDER BY t_s, row_idx)),
 g AS (SELECT source, record, count(*) AS n, sum(power(v - p, 2)) / sum(v * v) AS dw, sum(c * pc) / sum(c * c) AS lag1, count(*) FILTER ((c >= 0) <> (pc >= 0)) + 1 AS runs, sqrt(avg(v * v)) AS rms, max(abs(v)) AS largest, covar_pop(t_s, v) / var_pop(t_s) AS drift FROM c GROUP BY ALL)
 SELECT source, record, n, round(dw, 3) AS durbin_watson, round(lag1, 3) AS lag1, runs, round(rms, 3) AS rms, round(largest, 3) AS largest, round(drift * 1e6, 3) AS drift, round(spike_share, 3) AS spike_share FROM g JOIN sp USING (source, record)""",
)

TOPOLOGY = [("a", "R0", "R", None), ("a", "R1", "R", "p1"), ("a", "C1", "C", "p1"), ("a", "R2", "R", "p2"), ("a", "Q2", "CPE", "p2"), ("a", "W1", "Wo", None), ("b", "R0", "R", None), ("b", "R1", "R", "p1"), ("b", "C1", "C", "p1"), ("b", "Q2", "CPE", "p1")]


def circuits(s, d):
    """Suppliers' circuits, one of two, with parameters from the means of their lines and covariances from their scatter; every fifth has none."""
    g = table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("record")).agg(
        F.avg("l_extendedprice").alias("m0"), F.avg("l_quantity").alias("m1"), F.avg("l_discount").alias("m2"), F.stddev_pop("l_extendedprice").alias("s0"), F.stddev_pop("l_quantity").alias("s1"), F.covar_pop("l_extendedprice", "l_quantity").alias("c01"),
    )
    fits = g.select("record", F.when(F.col("record") % 2 == 0, "a").otherwise("b").alias("circuit"), F.lit(0.5).alias("f_min"), F.lit(20.0).alias("f_max"))
    values = F.array(*(F.struct(F.lit(e).alias("element"), F.lit(i).alias("slot"), v.alias("value")) for e, i, v in (
        ("R0", 0, F.col("m0")), ("R1", 0, F.col("m0") / 100), ("C1", 0, F.col("m1") * 1e-5), ("R2", 0, F.when(F.col("record") % 7 != 0, F.col("m0") / 10)), ("Q2", 0, F.col("m1") * 1e-6), ("Q2", 1, 0.6 + F.col("m2") * F.when(F.col("record") % 3 == 0, 10).otherwise(1)), ("W1", 0, F.col("m0")), ("W1", 1, F.col("m2")))))
    parameters = g.select("record", F.explode(values).alias("x")).select("record", "x.*")
    pairs = (("R1", 0, "R1", 0, F.pow(F.col("s0") / 1000, 2)), ("C1", 0, "C1", 0, F.pow(F.col("s1") * 1e-6, 2)), ("R1", 0, "C1", 0, F.col("c01") * 1e-10), ("C1", 0, "R1", 0, F.col("c01") * 1e-10), ("R2", 0, "R2", 0, F.pow(F.col("s0") / 100, 2)), ("Q2", 0, "Q2", 0, F.pow(F.col("s1") * 1e-7, 2)), ("Q2", 1, "Q2", 1, F.lit(1e-4)))
    cov = F.array(*(F.struct(F.lit(a).alias("element"), F.lit(i).alias("slot"), F.lit(b).alias("other"), F.lit(j).alias("other_slot"), v.alias("covariance")) for a, i, b, j, v in pairs))
    covariance = g.where("record % 5 <> 0").select("record", F.explode(cov).alias("x")).select("record", "x.*")
    topology = s.createDataFrame(TOPOLOGY, "circuit string, element string, kind string, parallel string")
    return X.circuit_timescales(topology, fits, parameters, covariance)


register(
    "g09_circuit_timescales",
    lambda s, d: rounded(circuits(s, d), 6),
    """WITH g AS (SELECT l_suppkey AS record, avg(l_extendedprice) AS m0, avg(l_quantity) AS m1, avg(l_discount) AS m2, stddev_pop(l_extendedprice) AS s0, stddev_pop(l_quantity) AS s1, covar_pop(l_extendedprice, l_quantity) AS c01 FROM lineitem GROUP BY l_suppkey),
 v AS (SELECT *, m0 / 100 AS r1, m1 * 1e-5 AS c1, CASE WHEN record % 7 <> 0 THEN m0 / 10 END AS r2, m1 * 1e-6 AS q2, 0.6 + m2 * CASE WHEN record % 3 = 0 THEN 10 ELSE 1 END AS al, power(s0 / 1000, 2) AS vr1, power(s1 * 1e-6, 2) AS vc1, c01 * 1e-10 AS crc, power(s0 / 100, 2) AS vr2, power(s1 * 1e-7, 2) AS vq2, 1e-4 AS va FROM g),
 t AS (SELECT record, 'p1/R1/C1' AS timescale, 'R-C' AS kind, r1 * c1 AS value, c1 * c1 * vr1 + r1 * r1 * vc1 + 2 * r1 * c1 * crc AS var FROM v
 UNION ALL SELECT record, 'p2/R2/Q2', 'R-CPE', power(r2 * q2, 1 / al), power(power(r2 * q2, 1 / al), 2) * (vr2 / power(al * r2, 2) + vq2 / power(al * q2, 2) + power(ln(r2 * q2) / (al * al), 2) * va) FROM v WHERE record % 2 = 0 AND r2 IS NOT NULL AND al <= 1
 UNION ALL SELECT record, 'p1/R1/Q2', 'R-CPE', power(r1 * q2, 1 / al), power(power(r1 * q2, 1 / al), 2) * (vr1 / power(al * r1, 2) + vq2 / power(al * q2, 2) + power(ln(r1 * q2) / (al * al), 2) * va) FROM v WHERE record % 2 = 1 AND al <= 1
 UNION ALL SELECT record, 'W1/direct', 'Wo', m2, NULL FROM v WHERE record % 2 = 0 AND m2 > 0),
 u AS (SELECT record, timescale, kind, value, CASE WHEN record % 5 <> 0 THEN sqrt(var) END AS se, 1 / (2 * pi() * value) AS f FROM t),
 w AS (SELECT *, concat_ws(',', CASE WHEN f < 0.5 OR f > 20 THEN 'outside_band' WHEN (f - 0.5) / 19.5 < 0.05 OR (20 - f) / 19.5 < 0.05 THEN 'band_edge' END, CASE WHEN record % 5 = 0 AND kind <> 'Wo' THEN 'missing_covariance' END) AS warnings FROM u)
 SELECT record, timescale, kind, round(value, 6) AS value_s, round(se, 6) AS se_s, round(value - 1.96 * se, 6) AS ci_low_s, round(value + 1.96 * se, 6) AS ci_high_s, CASE warnings WHEN '' THEN 'valid' ELSE 'valid_with_warnings' END AS validity, warnings FROM w""",
)
