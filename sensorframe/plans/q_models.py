"""Registered queries of model choice: calibrations with several regressor sets, responses with several relaxation models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.operators import calibration as C
from sensorframe.operators import linear as L
from sensorframe.operators import transient as T
from sensorframe.plans.common import Registry, rounded
from sensorframe.sources.storage import written
from sensorframe.sources.views import observations, readings

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
KEY, ORDER = ["series"], ["o", "l", "part", "level"]
MODELS = [
    L.Model("fixed", offset="0.1 * x"), L.Model("free", ("x",)), L.Model("prior", ("x",), prior=(0.1, 0.02)), L.Model("conductivity_fixed", ("x + 0.5 * c0",)),
    L.Model("conductivity", ("x", "c0")),
]


def obs(s, d):
    """Dealt by series once, before any model explodes them."""
    return observations(s, d).select(*KEY, "x", "y", "level", "c0", "o", "l", F.col("p").alias("part"), (1 + F.col("w0") * 10).alias("w")).repartition(*KEY)


def rows(s, d):
    return L.expand(obs(s, d), MODELS, "y", "w", [*KEY, *ORDER])


ROWS = """WITH o AS (SELECT l_suppkey AS series, log10(l_quantity / 1000) AS x, l_extendedprice / 1e5 AS y, l_quantity AS level, l_tax AS c0, 1.0 + l_discount * 10 AS w, l_orderkey AS o, l_linenumber AS l, l_partkey AS part FROM lineitem),
 e AS (SELECT series, level, o, l, part, w, 'fixed' AS model, 0 AS place, 0 AS p, 0.0 AS z1, 0.0 AS z2, y - 0.1 * x AS t, 0.0 AS prec, 0.0 AS prior FROM o UNION ALL SELECT series, level, o, l, part, w, 'free', 1, 1, x, 0.0, y, 0.0, 0.0 FROM o
 UNION ALL SELECT series, level, o, l, part, w, 'prior', 2, 1, x, 0.0, y, 2500.0, 0.1 FROM o UNION ALL SELECT series, level, o, l, part, w, 'conductivity_fixed', 3, 1, x + 0.5 * c0, 0.0, y, 0.0, 0.0 FROM o UNION ALL SELECT series, level, o, l, part, w, 'conductivity', 4, 2, x, c0, y, 0.0, 0.0 FROM o)"""


def fit_sql(name: str, source: str, by: str) -> str:
    """Weighted fits of the rows of ``source`` per ``by``: coefficients by Cramer's rule on sums around the weighted means."""
    same = f"USING ({by})"
    return f""", {name}_m AS (SELECT {by}, sum(w * z1) / sum(w) AS m1, sum(w * z2) / sum(w) AS m2, sum(w * t) / sum(w) AS mt FROM {source} GROUP BY ALL),
 {name}_s AS (SELECT {by}, count(*) AS n, sum(w) AS sw, any_value(p) AS p, any_value(place) AS place, any_value(prec) AS prec, any_value(prior) AS prior, any_value(m1) AS m1, any_value(m2) AS m2, any_value(mt) AS mt, sum(w * (z1 - m1) * (z1 - m1)) + any_value(prec) AS s11, sum(w * (z1 - m1) * (z2 - m2)) AS s12,
 sum(w * (z2 - m2) * (z2 - m2)) AS s22, sum(w * (z1 - m1) * (t - mt)) + any_value(prec * prior) AS s1t, sum(w * (z2 - m2) * (t - mt)) AS s2t FROM {source} JOIN {name}_m {same} GROUP BY {by}),
 {name}_d AS (SELECT *, CASE p WHEN 0 THEN 1.0 WHEN 1 THEN s11 ELSE s11 * s22 - s12 * s12 END AS det FROM {name}_s WHERE n >= p + 1 AND (p = 0 OR s11 > 1e-12)),
 {name}_b AS (SELECT *, CASE p WHEN 0 THEN 0.0 WHEN 1 THEN s1t / det ELSE (s1t * s22 - s2t * s12) / det END AS b1, CASE WHEN p = 2 THEN (s2t * s11 - s1t * s12) / det ELSE 0.0 END AS b2 FROM {name}_d WHERE p < 2 OR det > 1e-12 * s11 * greatest(s22, 1.0)),
 {name} AS (SELECT *, mt - b1 * m1 - b2 * m2 AS b0 FROM {name}_b)"""


FITS = ROWS + fit_sql("f", "e", "series, model") + """, r AS (SELECT series, model, avg(t) AS at, sum(w * power(t - b0 - b1 * z1 - b2 * z2, 2)) AS wrss, sum(power(t - b0 - b1 * z1 - b2 * z2, 2)) AS rss, var_pop(t) * count(*) AS tss FROM e JOIN f USING (series, model) GROUP BY series, model),
 h AS (SELECT f.*, rss, wrss, tss, p + 1 AS k, (wrss + prec * power(b1 - prior, 2)) / (n + CASE WHEN prec > 0 THEN 1 ELSE 0 END - p - 1) AS s2, n * ln(greatest(rss, 2.220446049250313e-16) / n) + 2 * (p + 1) AS aic FROM f JOIN r USING (series, model)),
 u AS (SELECT DISTINCT series, model, level AS out_level FROM e), tr AS (SELECT e.*, out_level FROM e JOIN u USING (series, model) WHERE level <> out_level)""" + fit_sql("c", "tr", "series, model, out_level") + """,
 v AS (SELECT e.series, e.model, sqrt(avg(power(c.b0 + c.b1 * z1 + c.b2 * z2 - t, 2))) AS cv_rmse, avg(c.b0 + c.b1 * z1 + c.b2 * z2 - t) AS cv_bias, count(c.b0) AS cv_n, count(*) - count(c.b0) AS cv_failed FROM e LEFT JOIN c ON e.series = c.series AND e.model = c.model AND e.level = c.out_level GROUP BY ALL),
 g AS (SELECT h.*, cv_rmse, cv_bias, cv_n, cv_failed, CASE WHEN n > k + 1 THEN aic + 2.0 * k * (k + 1) / (n - k - 1) ELSE aic END AS score FROM h JOIN v USING (series, model)), q AS (SELECT *, score - min(score) OVER (PARTITION BY series) AS delta FROM g)"""
register(
    "l06_model_choice",
    lambda s, d: rounded(C.fit_calibrations(rows(s, d), KEY, ["level"]).select(
        *KEY, "model", "n", "parameters", "intercept", "b1", "b2", "intercept_se", "b1_se", "b2_se", "rss", "wrss", "adj_r2", "aicc", "bic", "cv_rmse", "cv_bias", "cv_n", "cv_failed", "delta", "weight", "selected"), 5),
    FITS + """ SELECT series, model, n, CAST(k AS BIGINT) AS parameters, round(b0, 5) AS intercept, CASE WHEN p > 0 THEN round(b1, 5) END AS b1, CASE WHEN p > 1 THEN round(b2, 5) END AS b2,
 round(sqrt(s2 * (1 / sw + CASE p WHEN 0 THEN 0 WHEN 1 THEN m1 * m1 / s11 ELSE (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det END)), 5) AS intercept_se, CASE p WHEN 1 THEN round(sqrt(s2 / s11), 5) WHEN 2 THEN round(sqrt(s2 * s22 / det), 5) END AS b1_se, CASE p WHEN 2 THEN round(sqrt(s2 * s11 / det), 5) END AS b2_se,
 round(rss, 5) AS rss, round(wrss, 5) AS wrss, CASE WHEN n > k + 1 AND tss > 0 THEN round(1 - rss / tss * (n - 1) / (n - k - 1), 5) END AS adj_r2, CASE WHEN n > k + 1 THEN round(score, 5) END AS aicc, round(aic - 2 * k + k * ln(n), 5) AS bic, round(cv_rmse, 5) AS cv_rmse, round(cv_bias, 5) AS cv_bias, cv_n, cv_failed,
 round(delta, 5) AS delta, round(exp(-delta / 2) / sum(exp(-delta / 2)) OVER (PARTITION BY series), 5) AS weight, place = max(CASE WHEN delta < 1e-12 THEN place END) OVER (PARTITION BY series) AS selected FROM q""",
)

REPLICATES = 40


def selected(s, d):
    """Intervals of the selected models; only their rows are exploded again."""
    best = written(C.fit_calibrations(rows(s, d), KEY, ["level"]).where("selected"), "selected")
    r = L.expand(obs(s, d).join(best.select(*KEY, F.col("model").alias("chosen")), KEY), MODELS, "y", "w", [*KEY, *ORDER, "chosen"]).where("model = chosen")
    return C.selected_intervals(r.drop("chosen"), best, KEY, F.floor(F.col("o") / 1000), ORDER, replicates=REPLICATES)


PICKED = FITS + f""", s AS (SELECT q.*, place = max(CASE WHEN delta < 1e-12 THEN place END) OVER (PARTITION BY series) AS chosen FROM q),
 y AS (SELECT e.*, s.b0 + s.b1 * z1 + s.b2 * z2 AS fit, t - (s.b0 + s.b1 * z1 + s.b2 * z2) AS res, s.n, row_number() OVER (PARTITION BY e.series ORDER BY o, l, part, level) - 1 AS i FROM e JOIN s ON s.series = e.series AND s.model = e.model AND chosen),
 k AS (SELECT y.*, rep, CAST('0x' || substr(md5('42:' || rep || ':' || i), 1, 12) AS BIGINT) % n AS pick FROM y, range({REPLICATES}) t(rep)),
 z AS (SELECT k.series, k.model, k.rep, k.w, k.p, k.place, k.prec, k.prior, k.z1, k.z2, k.fit + y.res AS t FROM k JOIN y ON y.series = k.series AND y.i = k.pick)""" + fit_sql("x", "z", "series, model, rep")
register(
    "l06_selected_intervals",
    lambda s, d: rounded(selected(s, d), 5),
    PICKED + """ SELECT series, model, CAST(count(*) AS BIGINT) AS succeeded, round(quantile_cont(b0, 0.025), 5) AS intercept_lower, round(quantile_cont(b0, 0.975), 5) AS intercept_upper, CASE WHEN any_value(p) > 0 THEN round(quantile_cont(b1, 0.025), 5) END AS b1_lower, CASE WHEN any_value(p) > 0 THEN round(quantile_cont(b1, 0.975), 5) END AS b1_upper,
 CASE WHEN any_value(p) > 1 THEN round(quantile_cont(b2, 0.025), 5) END AS b2_lower, CASE WHEN any_value(p) > 1 THEN round(quantile_cont(b2, 0.975), 5) END AS b2_upper FROM x GROUP BY series, model""",
)

FREE = [L.Model("free", ("x",))]


def slope_intervals(s, d, replicates=50):
    r = L.expand(obs(s, d).withColumn("one", F.lit(1.0)), FREE, "y", "one", [*KEY, *ORDER])
    out = L.bootstrap(r, written(L.fit(r, KEY), "fits"), KEY, F.floor(F.col("o") / 1000), ORDER, replicates=replicates)
    return out.select("series", F.col("succeeded").alias("replicates"), F.col("b1_lower").alias("low"), F.col("b1_upper").alias("high"))


register(
    "g14_residual_bootstrap",
    lambda s, d: rounded(slope_intervals(s, d)),
    ROWS + """, g AS (SELECT series, count(*) AS n, covar_pop(x, y) / var_pop(x) AS b1, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS b0 FROM o GROUP BY series),
 y AS (SELECT o.series, x, level, b0 + b1 * x AS fit, y - b0 - b1 * x AS res, n, row_number() OVER (PARTITION BY o.series ORDER BY o, l, part, level) - 1 AS i FROM o JOIN g USING (series)), k AS (SELECT y.*, rep, CAST('0x' || substr(md5('42:' || rep || ':' || i), 1, 12) AS BIGINT) % n AS pick FROM y, range(50) t(rep)),
 b AS (SELECT k.series, rep, covar_pop(k.x, k.fit + y.res) / var_pop(k.x) AS slope FROM k JOIN y ON y.series = k.series AND y.i = k.pick GROUP BY k.series, rep)
 SELECT series, count(*) AS replicates, round(quantile_cont(slope, 0.025), 6) AS low, round(quantile_cont(slope, 0.975), 6) AS high FROM b GROUP BY series""",
)

GRID, FULL = T.Grid(high=0.0, steps=5, betas=(0.5, 0.8), rounds=1), T.Grid()
SENSOR = ["sensor_id"]


def responses(s, d):
    """Each sensor's readings since its first error."""
    r = readings(s, d)
    t0 = r.where("channel = 'error'").groupBy("sensor_id").agg(F.min("t_s").alias("t0"))
    p = r.where("channel <> 'error'").join(t0, "sensor_id").where("t_s >= t0")
    return written(p.select("sensor_id", "row_idx", (F.col("t_s") - F.col("t0")).alias("local"), F.col("value").alias("v")), "responses")


def transients(s, d, grid, **how):
    return T.analyze_transients(responses(s, d), SENSOR, grid=grid, order=("row_idx",), **how)


def _round_sql(name: str, candidates: str) -> str:
    """All candidates' fits by Cramer's rule and direct residuals, and the best of each model."""
    return f""", {name}_e AS (SELECT p.sensor_id, p.local, p.v, p.n, span, model, fast, slow, beta, CASE model WHEN 'double_drift' THEN 3 WHEN 'double' THEN 2 ELSE 1 END AS p, exp(-CASE WHEN model = 'stretched' THEN power(local / (power(10.0, fast) * span), beta) ELSE local / (power(10.0, fast) * span) END) AS z1,
 CASE WHEN model LIKE 'double%' THEN exp(-local / (power(10.0, slow) * span)) ELSE 0.0 END AS z2, CASE WHEN model = 'double_drift' THEN local / span ELSE 0.0 END AS z3 FROM p JOIN {candidates} WHERE p.n >= CASE model WHEN 'single' THEN 5 WHEN 'double' THEN 7 WHEN 'double_drift' THEN 8 ELSE 6 END),
 {name}_c AS (SELECT sensor_id, model, fast, slow, beta, any_value(p) AS p, any_value(span) AS span, count(*) AS n, avg(z1) AS m1, avg(z2) AS m2, avg(z3) AS m3, avg(v) AS mv, count(*) * covar_pop(z1, z1) AS c11, count(*) * covar_pop(z1, z2) AS c12, count(*) * covar_pop(z1, z3) AS c13, count(*) * covar_pop(z2, z2) AS c22, count(*) * covar_pop(z2, z3) AS c23, count(*) * covar_pop(z3, z3) AS c33,
 count(*) * covar_pop(z1, v) AS c1v, count(*) * covar_pop(z2, v) AS c2v, count(*) * covar_pop(z3, v) AS c3v FROM {name}_e GROUP BY ALL),
 {name}_d AS (SELECT *, c11 * c22 - c12 * c12 AS d2, c11 * (c22 * c33 - c23 * c23) - c12 * (c12 * c33 - c13 * c23) + c13 * (c12 * c23 - c13 * c22) AS d3 FROM {name}_c WHERE c11 > 1e-12),
 {name}_b AS (SELECT *, CASE p WHEN 1 THEN c1v / c11 WHEN 2 THEN (c1v * c22 - c2v * c12) / d2 ELSE (c1v * (c22 * c33 - c23 * c23) - c12 * (c2v * c33 - c3v * c23) + c13 * (c2v * c23 - c3v * c22)) / d3 END AS b1,
 CASE p WHEN 1 THEN 0.0 WHEN 2 THEN (c2v * c11 - c1v * c12) / d2 ELSE (c11 * (c2v * c33 - c3v * c23) - c1v * (c12 * c33 - c13 * c23) + c13 * (c12 * c3v - c13 * c2v)) / d3 END AS b2,
 CASE p WHEN 3 THEN (c11 * (c22 * c3v - c23 * c2v) - c12 * (c12 * c3v - c13 * c2v) + c1v * (c12 * c23 - c13 * c22)) / d3 ELSE 0.0 END AS b3 FROM {name}_d WHERE p = 1 OR (d2 / c11 > 1e-6 * greatest(c22, 1.0) AND (p = 2 OR d3 / d2 > 1e-6 * greatest(c33, 1.0)))),
 {name}_r AS (SELECT b.sensor_id, b.model, b.fast, b.slow, b.beta, sum(power(e.v - (mv + b1 * (z1 - m1) + b2 * (z2 - m2) + b3 * (z3 - m3)), 2)) AS rss FROM {name}_b b JOIN {name}_e e ON e.sensor_id = b.sensor_id AND e.model = b.model AND e.fast = b.fast AND e.slow = b.slow AND e.beta = b.beta GROUP BY ALL),
 {name}_k AS (SELECT *, mv - b1 * m1 - b2 * m2 - b3 * m3 AS b0, row_number() OVER (PARTITION BY sensor_id, model ORDER BY rss, fast, slow, beta) AS i FROM {name}_b JOIN {name}_r USING (sensor_id, model, fast, slow, beta)), {name} AS (SELECT * FROM {name}_k WHERE i = 1)"""


_MOVES = "(VALUES " + ", ".join(f"({i})" for i in range(-2, 3)) + ")"
_SINCE = """WITH rd AS (SELECT user_id AS sensor_id, event_type AS channel, event_id AS row_idx, epoch_us(ts) / 1e6 AS t_s, value FROM events), t0 AS (SELECT sensor_id, min(t_s) AS t0 FROM rd WHERE channel = 'error' GROUP BY sensor_id),
 p0 AS (SELECT sensor_id, row_idx, t_s - t0 AS local, value AS v FROM rd JOIN t0 USING (sensor_id) WHERE channel <> 'error' AND t_s >= t0), p AS (SELECT *, max(local) OVER (PARTITION BY sensor_id) AS span, count(*) OVER (PARTITION BY sensor_id) AS n FROM p0)"""


def _responses_sql(grid: T.Grid, round_sql=_round_sql, more: str = "") -> str:
    """Readings since each sensor's first error as p, and every model's best fit of all rounds of the grid with its residual statistics as c."""
    sql = _SINCE + more + """,
 g0(model, fast, slow, beta) AS (VALUES """ + ", ".join(f"('{m}', {f!r}::DOUBLE, {s!r}::DOUBLE, {b!r}::DOUBLE)" for m, f, s, b in T._coarse(list(T.MODELS), grid)) + ")"
    sql += round_sql("f0", "g0 ON true")
    for i in range(1, grid.rounds + 1):
        step, gap = grid.step / grid.ratio**i, 0.2 / grid.ratio**i
        sql += f""", g{2 * i - 1} AS (SELECT DISTINCT sensor_id, model, fast + {step!r} * a AS fast, CASE WHEN model LIKE 'double%' THEN slow + {step!r} * b ELSE slow END AS slow, CASE WHEN model = 'stretched' THEN greatest(0.05, least(1.0, beta + {gap!r} * b)) ELSE 1.0 END AS beta FROM f{i - 1}, {_MOVES} x(a), {_MOVES} y(b)), g{2 * i} AS (SELECT * FROM g{2 * i - 1} WHERE model NOT LIKE 'double%' OR fast < slow)"""
        sql += round_sql(f"f{i}", f"g{2 * i} ON g{2 * i}.sensor_id = p.sensor_id")
    return sql + f""", f AS (SELECT *, power(10.0, fast) * span AS tf, power(10.0, slow) * span AS ts, b3 / span AS dr, CASE model WHEN 'single' THEN 3 WHEN 'double' THEN 5 WHEN 'double_drift' THEN 6 ELSE 4 END AS k FROM f{grid.rounds}),
 y AS (SELECT f.sensor_id, f.model, p.v - (b0 + b1 * exp(-power(local / tf, beta)) + b2 * exp(-local / ts) + dr * local) AS r, row_number() OVER (PARTITION BY f.sensor_id, f.model ORDER BY local, row_idx) AS i FROM f JOIN p USING (sensor_id)),
 z AS (SELECT *, lag(r) OVER (PARTITION BY sensor_id, model ORDER BY i) AS r0 FROM y), q AS (SELECT sensor_id, model, avg(abs(r)) AS mae, max(abs(r)) AS max_abs, sum(power(r - r0, 2)) / sum(r * r) AS durbin_watson, sum(r * r0) / sum(r * r) AS lag1 FROM z GROUP BY ALL),
 c AS (SELECT f.*, mae, max_abs, durbin_watson, lag1, n * ln(rss / n) + 2 * k AS aic FROM f JOIN q USING (sensor_id, model))"""


#: A sensor's points as lists in order of time.
_LISTS = """, l0 AS (SELECT sensor_id, any_value(span) AS span, any_value(n) AS n, list(local ORDER BY local, v) AS xs, list(v ORDER BY local, v) AS vs FROM p WHERE span > 0 GROUP BY sensor_id), l1 AS (SELECT *, list_avg(vs) AS mv FROM l0), l AS (SELECT * EXCLUDE (vs), list_transform(vs, lambda v: v - mv) AS v0 FROM l1)"""


def _round_of_lists(name: str, candidates: str) -> str:
    """:func:`_round_sql` with each regressor freed of those before it point by point: of the full grid's nearly alike ones sums of products lose half
    the digits."""
    less = lambda x, k, z: f"list_transform({x}, lambda a, i: a - {k} * {z}[i])"
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    fast = "x / (power(10.0, fast) * span)"
    return f""", {name}_a AS (SELECT l.*, model, fast, slow, beta, CASE model WHEN 'double_drift' THEN 3 WHEN 'double' THEN 2 ELSE 1 END AS p, CASE WHEN model = 'stretched' THEN list_transform(xs, lambda x: exp(-power({fast}, beta))) ELSE list_transform(xs, lambda x: exp(-{fast})) END AS y1,
 CASE WHEN model LIKE 'double%' THEN list_transform(xs, lambda x: exp(-x / (power(10.0, slow) * span))) END AS y2, CASE WHEN model = 'double_drift' THEN list_transform(xs, lambda x: x / span) END AS y3 FROM l JOIN {candidates.replace("p.sensor_id", "l.sensor_id")} WHERE n >= CASE model WHEN 'single' THEN 5 WHEN 'double' THEN 7 WHEN 'double_drift' THEN 8 ELSE 6 END),
 {name}_b AS (SELECT *, list_avg(y1) AS m1, list_avg(y2) AS m2, list_avg(y3) AS m3 FROM {name}_a), {name}_c AS (SELECT * EXCLUDE (xs, y1, y2, y3), list_transform(y1, lambda a: a - m1) AS z1, list_transform(y2, lambda a: a - m2) AS z2, list_transform(y3, lambda a: a - m3) AS z3 FROM {name}_b),
 {name}_d AS (SELECT *, {dot("z1", "z1")} AS d1, {dot("z2", "z2")} AS c22, {dot("z3", "z3")} AS c33, {dot("z1", "z2")} / d1 AS l21, {dot("z1", "z3")} / d1 AS l31, {dot("z1", "v0")} / d1 AS t1 FROM {name}_c WHERE {dot("z1", "z1")} > 1e-12),
 {name}_e AS (SELECT * EXCLUDE (z2, z3, v0), {less("z2", "l21", "z1")} AS z2, {less("z3", "l31", "z1")} AS z3, {less("v0", "t1", "z1")} AS v1 FROM {name}_d), {name}_g AS (SELECT * EXCLUDE (z1), {dot("z2", "z2")} AS d2, {dot("z2", "z3")} / d2 AS l32, {dot("z2", "v1")} / d2 AS t2 FROM {name}_e),
 {name}_h AS (SELECT * EXCLUDE (z2, z3, v1), {less("z3", "l32", "z2")} AS z3, CASE WHEN p = 1 THEN v1 ELSE {less("v1", "t2", "z2")} END AS v2 FROM {name}_g WHERE p = 1 OR d2 > 1e-6 * greatest(c22, 1.0)), {name}_i AS (SELECT *, {dot("z3", "z3")} AS d3, {dot("z3", "v2")} / d3 AS t3 FROM {name}_h),
 {name}_j AS (SELECT * EXCLUDE (z3, v2), CASE WHEN p < 3 THEN v2 ELSE {less("v2", "t3", "z3")} END AS v3 FROM {name}_i WHERE p < 3 OR d3 > 1e-6 * greatest(c33, 1.0)),
 {name}_k AS (SELECT sensor_id, model, fast, slow, beta, p, span, n, mv, m1, m2, m3, {dot("v3", "v3")} AS rss, CASE WHEN p > 2 THEN t3 ELSE 0.0 END AS b3, CASE p WHEN 1 THEN 0.0 WHEN 2 THEN t2 ELSE t2 - l32 * b3 END AS b2, t1 - CASE WHEN p > 1 THEN l21 * b2 ELSE 0.0 END - CASE WHEN p > 2 THEN l31 * b3 ELSE 0.0 END AS b1 FROM {name}_j),
 {name} AS (SELECT *, mv - b1 * m1 - coalesce(b2 * m2, 0.0) - coalesce(b3 * m3, 0.0) AS b0, row_number() OVER (PARTITION BY sensor_id, model ORDER BY rss, fast, slow, beta) AS i FROM {name}_k QUALIFY i = 1)"""


RESPONSES = _responses_sql(GRID)
# sums of products, as in its SQL
register(
    "l04_analyze_transients",
    lambda s, d: rounded(transients(s, d, GRID, together=0).select(*SENSOR, "model", "n", "parameters", "tau_fast", "tau_slow", "beta", "e_infinity", "a_fast", "a_slow", (F.col("drift") * F.col("duration")).alias("drifted"), "rss", "adj_r2", "aic", "aicc", "bic", "delta", "weight", "selected", "weak_support", "mae", "max_abs", "durbin_watson", "lag1"), 3),
    RESPONSES + """, m AS (SELECT *, aic - min(aic) OVER (PARTITION BY sensor_id) AS delta FROM c) SELECT sensor_id, model, n, CAST(k AS BIGINT) AS parameters, round(tf, 3) AS tau_fast, CASE WHEN p > 1 THEN round(ts, 3) END AS tau_slow, CASE WHEN model = 'stretched' THEN round(beta, 3) END AS beta, round(b0, 3) AS e_infinity, round(b1, 3) AS a_fast,
 CASE WHEN p > 1 THEN round(b2, 3) END AS a_slow, CASE WHEN p > 2 THEN round(b3, 3) END AS drifted, round(rss, 3) AS rss, round(1 - rss / v2 * (n - 1) / (n - k - 1), 3) AS adj_r2, round(aic, 3) AS aic, CASE WHEN n > k + 1 THEN round(aic + 2.0 * k * (k + 1) / (n - k - 1), 3) END AS aicc, round(aic - 2 * k + k * ln(n), 3) AS bic, round(delta, 3) AS delta,
 round(exp(-delta / 2) / sum(exp(-delta / 2)) OVER (PARTITION BY sensor_id), 3) AS weight, row_number() OVER (PARTITION BY sensor_id ORDER BY aic, CASE model WHEN 'single' THEN 0 WHEN 'double' THEN 1 WHEN 'double_drift' THEN 2 ELSE 3 END) = 1 AS selected, delta > 10 AS weak_support, round(mae, 3) AS mae, round(max_abs, 3) AS max_abs, round(durbin_watson, 3) AS durbin_watson, round(lag1, 3) AS lag1
 FROM m JOIN (SELECT sensor_id, var_pop(v) * count(*) AS v2 FROM p GROUP BY sensor_id) USING (sensor_id)""",
)
register(
    "g13_response_features",
    lambda s, d: rounded(transients(s, d, FULL).select(*SENSOR, "model", "total_amplitude", (F.col("initial_rate") * F.col("tau_fast")).alias("first_rate"), *((F.col(t) / F.col("duration")).alias(t) for t in ("t63", "t90", "t95")), "long_time_constant", "poor_separation", "negligible_amplitude", "no_aicc", "high_autocorrelation"), 3),
    _responses_sql(FULL, _round_of_lists, _LISTS) + """, u AS (SELECT * EXCLUDE (i), 20 * greatest(CASE WHEN p > 1 THEN ts ELSE tf END, span, 1.0) AS upper, abs(b1 + b2) AS d0 FROM c), w AS (SELECT sensor_id, model, i, upper * i / 2000 AS t, d0, abs(b1 * exp(-power(upper * i / 2000 / tf, beta)) + b2 * exp(-(upper * i / 2000) / ts) + dr * (upper * i / 2000)) AS away FROM u, range(2001) r(i)),
 x AS (SELECT *, lag(away) OVER (PARTITION BY sensor_id, model ORDER BY i) AS away0, lag(t) OVER (PARTITION BY sensor_id, model ORDER BY i) AS t0 FROM w), """
    + ", ".join(f"h{n} AS (SELECT sensor_id, model, arg_min(t0 + (t - t0) * (away0 - d0 * (1 - {q})) / (away0 - away), i) AS t{n} FROM x WHERE i > 0 AND away <= d0 * (1 - {q}) GROUP BY ALL)" for n, q in ((63, 0.632), (90, 0.9), (95, 0.95)))
    + """ SELECT sensor_id, model, round(-b1 - b2, 3) AS total_amplitude, CASE WHEN beta >= 1 THEN round((-b1 / tf - b2 / ts + dr) * tf, 3) END AS first_rate, round(t63 / span, 3) AS t63, round(t90 / span, 3) AS t90, round(t95 / span, 3) AS t95, CASE WHEN p > 1 THEN ts ELSE tf END / span > 1 AS long_time_constant, p > 1 AND ts / tf < 3 AS poor_separation,
 p > 1 AND least(abs(b1), abs(b2)) / (abs(b1) + abs(b2)) < 0.05 AS negligible_amplitude, n <= k + 1 AS no_aicc, abs(lag1) > 0.8 AS high_autocorrelation FROM c LEFT JOIN h63 USING (sensor_id, model) LEFT JOIN h90 USING (sensor_id, model) LEFT JOIN h95 USING (sensor_id, model)""",
)
