"""Registered calibration, unit and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.functions import electro as E
from sensorframe.operators import calibration as C
from sensorframe.operators import series as S
from sensorframe.plans.common import Registry, rounded
from sensorframe.sources.views import observations, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
KEY = ["series"]
O = "WITH o AS (SELECT l_suppkey AS series, log10(l_quantity / 1000) AS x, l_extendedprice / 1e5 AS y, l_quantity AS level, l_returnflag AS branch, l_shipdate AS d, l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_discount AS w0, l_tax AS c0, 1.0 + l_discount * 10 AS w FROM lineitem)"  # noqa: E741
ORDER = ["d", "o", "l", "p"]


def obs(s, d):
    return observations(s, d).withColumn("w", 1 + F.col("w0") * 10)


def fits(s, d):
    return C.solve(C.weighted_sums(obs(s, d), KEY))


FIT = O + """, m AS (SELECT series, avg(x) AS mx, avg(y) AS my FROM o GROUP BY series),
 s AS (SELECT o.series, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(w) AS sw, sum(w * (x - mx)) AS wx, sum(w * (y - my)) AS wy, sum(w * (x - mx) * (x - mx)) AS wxx, sum(w * (x - mx) * (y - my)) AS wxy, sum(w * (y - my) * (y - my)) AS wyy FROM o JOIN m USING (series) GROUP BY o.series),
 t AS (SELECT *, sw * wxx - wx * wx AS det FROM s WHERE n >= 3 AND sw * wxx - wx * wx > 1e-12), u AS (SELECT *, (sw * wxy - wx * wy) / det AS slope FROM t), v AS (SELECT *, (wy - slope * wx) / sw AS c FROM u),
 f AS (SELECT *, greatest(wyy - slope * wxy - c * wy, 2.220446049250313e-16) AS wrss, my + c - slope * mx AS intercept FROM v)"""
register(
    "g15_weighted_calibration",
    lambda s, d: rounded(fits(s, d).select(*KEY, "n", "slope", "intercept", "wrss", "slope_se", "intercept_se")),
    FIT + " SELECT series, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(wrss, 6) AS wrss, round(sqrt(wrss / (n - 2) * sw / det), 6) AS slope_se, round(sqrt(wrss / (n - 2) * (wxx + 2 * mx * wx + mx * mx * sw) / det), 6) AS intercept_se FROM f",
)
register(
    "g15_influence",
    lambda s, d: rounded(C.influence(obs(s, d).withColumnRenamed("w", "w_obs"), fits(s, d).withColumnRenamed("w", "w_sum"), KEY).select(*KEY, *ORDER[1:], "leverage", "residual", "cook")),
    FIT + """, i AS (SELECT o.series, o.o, o.l, o.p, o.w, y - intercept - slope * x AS residual, o.w * (1 / sw + power(x - (mx + wx / sw), 2) * sw / det) AS leverage, wrss / (n - 2) AS s2 FROM o JOIN f USING (series))
 SELECT series, o, l, p, round(leverage, 6) AS leverage, round(residual, 6) AS residual, round(CASE WHEN leverage < 1 THEN w * residual * residual / (2 * s2) * leverage / power(1 - leverage, 2) END, 6) AS cook FROM i""",
)
register(
    "d18_calibration_statistics",
    lambda s, d: rounded(fits(s, d).select(*KEY, F.sqrt(F.col("wrss") / F.col("n")).alias("wrmse"), (F.col("n") * F.log(F.col("wrss") / F.col("n")) + 4).alias("aic"), (F.col("n") * F.log(F.col("wrss") / F.col("n")) + 2 * F.log("n")).alias("bic"))),
    FIT + " SELECT series, round(sqrt(wrss / n), 6) AS wrmse, round(n * ln(wrss / n) + 4, 6) AS aic, round(n * ln(wrss / n) + 2 * ln(n), 6) AS bic FROM f",
)
CV = """, m AS (SELECT series, avg(x) AS mx, avg(y) AS my FROM o GROUP BY series), q AS (SELECT o.*, x - mx AS dx, y - my AS dy, my FROM o JOIN m USING (series)),
 tot AS (SELECT series, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy FROM q GROUP BY series),
 own AS (SELECT series, level, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy FROM q GROUP BY series, level),
 tr AS (SELECT own.series, own.level, tot.n - own.n AS n, tot.sx - own.sx AS sx, tot.sy - own.sy AS sy, tot.sxx - own.sxx AS sxx, tot.sxy - own.sxy AS sxy FROM own JOIN tot USING (series)),
 k AS (SELECT *, n * sxx - sx * sx AS det FROM tr WHERE n >= 3 AND n * sxx - sx * sx > 1e-12), l2 AS (SELECT *, (n * sxy - sx * sy) / det AS slope FROM k),
 e AS (SELECT q.series, q.dy + my - (my + (l2.sy - slope * l2.sx) / l2.n + slope * q.dx) AS error FROM q JOIN l2 ON q.series = l2.series AND q.level = l2.level)"""
register(
    "g18_cross_validation",
    lambda s, d: rounded(C.cross_validate(obs(s, d), KEY, ["level"]).groupBy(KEY).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("error") ** 2)).alias("cv_rmse"), F.avg("error").alias("bias"))),
    O + CV + " SELECT series, count(*) AS n, round(sqrt(avg(error * error)), 6) AS cv_rmse, round(avg(error), 6) AS bias FROM e GROUP BY series",
)
register(
    "b10_branch_fit",
    lambda s, d: rounded(S.ols(obs(s, d), ["series", "branch"]).select("series", "branch", "n", "slope", "intercept")),
    O + """, g AS (SELECT series, branch, avg(x) AS mx, avg(y) AS my FROM o GROUP BY ALL), c AS (SELECT o.series, o.branch, count(*) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy FROM o JOIN g USING (series, branch) GROUP BY o.series, o.branch)
 SELECT series, branch, n, round(sxy / sxx, 6) AS slope, round(my - sxy / sxx * mx, 6) AS intercept FROM c WHERE n >= 2 AND sxx > 0""",
)
register(
    "d23_observation_summary",
    lambda s, d: rounded(obs(s, d).groupBy("series", "branch").agg(F.count("*").alias("n"), F.count_distinct(F.round("x", 10)).alias("levels"), F.count_distinct("o").alias("experiments"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))),
    O + " SELECT series, branch, count(*) AS n, count(DISTINCT level) AS levels, count(DISTINCT o) AS experiments, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM o GROUP BY series, branch",
)
register(
    "d24_calibration_domain",
    lambda s, d: rounded(obs(s, d).groupBy("series").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("level").alias("level_min"), F.max("level").alias("level_max"))),
    O + " SELECT series, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(level), 6) AS level_min, round(max(level), 6) AS level_max FROM o GROUP BY series",
)
register(
    "e08_branch_direction",
    lambda s, d: obs(s, d).withColumn("prev", F.lag("level").over(W.partitionBy("series").orderBy(ORDER))).select("series", "o", "l", "p", F.when(F.col("prev").isNull(), "unknown").when(F.col("level") > F.col("prev"), "ascending").when(F.col("level") < F.col("prev"), "descending").otherwise("unknown").alias("direction")),
    O + ", q AS (SELECT *, lag(level) OVER (PARTITION BY series ORDER BY d, o, l, p) AS prev FROM o) SELECT series, o, l, p, CASE WHEN prev IS NULL THEN 'unknown' WHEN level > prev THEN 'ascending' WHEN level < prev THEN 'descending' ELSE 'unknown' END AS direction FROM q",
)
register(
    "e11_candidate_choice",
    lambda s, d: rounded(_candidates(s, d)),
    O + """, g AS (SELECT series, branch, avg(x) AS mx, avg(y) AS my FROM o GROUP BY ALL), c AS (SELECT o.series, o.branch, count(*) AS n, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy FROM o JOIN g USING (series, branch) GROUP BY o.series, o.branch),
 f AS (SELECT series, branch, n, n * ln(greatest(syy - sxy * sxy / sxx, 2.220446049250313e-16) / n) + 4 AS aic FROM c WHERE n >= 3 AND sxx > 0), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY aic / n, branch DESC) AS i FROM f)
 SELECT series, branch, n, round(aic / n, 6) AS criterion FROM k WHERE i = 1""",
)


def _candidates(s, d):
    """The branch model with the lowest criterion per observation; ties go to the last."""
    f = S.ols(obs(s, d), ["series", "branch"]).where("n >= 3")
    f = f.withColumn("criterion", (F.col("n") * F.log(F.greatest("rss", F.lit(2.220446049250313e-16)) / F.col("n")) + 4) / F.col("n"))
    k = F.row_number().over(W.partitionBy("series").orderBy("criterion", F.desc("branch")))
    return f.withColumn("i", k).where("i = 1").select("series", "branch", "n", "criterion")


register(
    "i17_regression_warnings",
    lambda s, d: rounded(fits(s, d).join(obs(s, d).groupBy("series").agg((F.max("x") - F.min("x")).alias("span"), F.count_distinct("level").alias("levels")), "series").select(
        "series", F.array_join(F.array_compact(F.array(F.when(F.col("span") < 1, "short_span"), F.when(F.col("slope") < 0, "wrong_sign"), F.when(F.col("levels") < 3, "few_levels"), F.when(F.abs(F.col("slope") / 0.05916 - 1) > 0.2, "slope_off"))), ",").alias("warnings"))),
    FIT + ", r AS (SELECT series, max(x) - min(x) AS span, count(DISTINCT level) AS levels FROM o GROUP BY series) SELECT series, array_to_string(list_filter([CASE WHEN span < 1 THEN 'short_span' END, CASE WHEN slope < 0 THEN 'wrong_sign' END, CASE WHEN levels < 3 THEN 'few_levels' END, CASE WHEN abs(slope / 0.05916 - 1) > 0.2 THEN 'slope_off' END], lambda w: w IS NOT NULL), ',') AS warnings FROM f JOIN r USING (series)",
)
register(
    "g16_two_regressors",
    lambda s, d: rounded(_two(s, d)),
    O + """, m AS (SELECT series, avg(x) AS m1, avg(c0) AS m2, avg(y) AS my FROM o GROUP BY series),
 s AS (SELECT o.series, count(*) AS n, sum(power(x - m1, 2)) AS a, sum((x - m1) * (c0 - m2)) AS b, sum(power(c0 - m2, 2)) AS c, sum((x - m1) * (y - my)) AS p, sum((c0 - m2) * (y - my)) AS q, any_value(m1) AS m1, any_value(m2) AS m2, any_value(my) AS my FROM o JOIN m USING (series) GROUP BY o.series)
 SELECT series, n, round((p * c - q * b) / (a * c - b * b), 6) AS slope, round((q * a - p * b) / (a * c - b * b), 6) AS conductivity, round(my - (p * c - q * b) / (a * c - b * b) * m1 - (q * a - p * b) / (a * c - b * b) * m2, 6) AS intercept FROM s WHERE n >= 4 AND a * c - b * b > 1e-9""",
)


def _two(s, d):
    """Two regressors and a constant by centred normal equations."""
    o = obs(s, d)
    o = o.join(o.groupBy("series").agg(F.avg("x").alias("m1"), F.avg("c0").alias("m2"), F.avg("y").alias("my")), "series")
    d1, d2, dy = F.col("x") - F.col("m1"), F.col("c0") - F.col("m2"), F.col("y") - F.col("my")
    t = o.groupBy("series").agg(F.count("*").alias("n"), F.sum(d1 * d1).alias("a"), F.sum(d1 * d2).alias("b"), F.sum(d2 * d2).alias("c"), F.sum(d1 * dy).alias("p"), F.sum(d2 * dy).alias("q"), F.first("m1").alias("m1"), F.first("m2").alias("m2"), F.first("my").alias("my"))
    t = t.withColumn("det", F.expr("a * c - b * b")).where("n >= 4 AND det > 1e-9").withColumns({"slope": F.expr("(p * c - q * b) / det"), "conductivity": F.expr("(q * a - p * b) / det")})
    return t.select("series", "n", "slope", "conductivity", F.expr("my - slope * m1 - conductivity * m2").alias("intercept"))


KS = [10.0**-e for e in range(1, 6)]
register(
    "g17_selectivity_grid",
    lambda s, d: rounded(_selectivity(s, d)),
    O + ", k(k) AS (VALUES %s), r AS (SELECT o.series, k.k, y - 0.05916 * log10(level / 1000 + k.k * (c0 + 0.01)) AS z FROM o, k), f AS (SELECT series, k, avg(z) AS e0, var_pop(z) * count(*) AS rss FROM r GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rss, k) AS i FROM f) SELECT series, round(k, 6) AS k, round(e0, 6) AS e0, round(rss, 6) AS rss FROM b WHERE i = 1" % ", ".join(f"({k!r})" for k in KS),
)


def _selectivity(s, d):
    """Selectivity coefficient on a grid: at each the best E0 is the mean residual; the smallest rss wins."""
    g = obs(s, d).withColumn("k", F.explode(F.array(*map(F.lit, KS))))
    g = g.withColumn("z", F.col("y") - 0.05916 * F.log10(F.col("level") / 1000 + F.col("k") * (F.col("c0") + 0.01)))
    g = g.groupBy("series", "k").agg(F.avg("z").alias("e0"), (F.var_pop("z") * F.count("*")).alias("rss"))
    return g.groupBy("series").agg(F.min_by(F.struct("k", "e0", "rss"), F.struct("rss", "k")).alias("b")).select("series", "b.*")


register(
    "g20_curve_points",
    lambda s, d: rounded(fits(s, d).join(obs(s, d).groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi")), "series").select("series", "slope", "intercept", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("series", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 4).alias("x"), (F.col("intercept") + F.col("slope") * (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / 4)).alias("y"))),
    FIT + ", b AS (SELECT series, min(x) AS lo, max(x) AS hi FROM o GROUP BY series) SELECT f.series, i, round(lo + (hi - lo) * i / 4, 6) AS x, round(intercept + slope * (lo + (hi - lo) * i / 4), 6) AS y FROM f JOIN b USING (series), (VALUES (CAST(0 AS BIGINT)), (1), (2), (3), (4)) g(i)",
)

L = "l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS series"


def keys():
    return [F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("series")]


def t_col():
    return 280 + F.col("l_quantity")


def z_col():
    return F.when(F.col("l_linenumber") % 2 == 0, 2.0).otherwise(1.0)


def unit_col():
    return F.when(F.col("l_linenumber") % 4 == 0, "mV").when(F.col("l_linenumber") % 4 == 1, "C").when(F.col("l_linenumber") % 4 == 2, "min").otherwise("furlong")


def line(s, d):
    return table(s, d, "lineitem")


T_, Z_ = "(280 + l_quantity)", "(CASE WHEN l_linenumber % 2 = 0 THEN 2.0 ELSE 1.0 END)"
SLOPE = f"(2.302585092994046 * {E.GAS} * {T_} / ({Z_} * {E.FARADAY}))"
register(
    "j_nernst",
    lambda s, d: rounded(line(s, d).select(*keys(), E.nernst_slope(t_col(), z_col()).alias("slope"), E.potential(F.lit(0.2), E.nernst_slope(t_col(), z_col()), F.col("l_discount")).alias("e"), E.activity(F.lit(0.2), E.nernst_slope(t_col(), z_col()), F.lit(0.15)).alias("a"))),
    f"SELECT {L}, round({SLOPE}, 6) AS slope, round(CASE WHEN l_discount > 0 THEN 0.2 + {SLOPE} * log10(l_discount) END, 6) AS e, round(power(10.0, (0.15 - 0.2) / {SLOPE}), 6) AS a FROM lineitem",
)
register(
    "j_activity_models",
    lambda s, d: rounded(line(s, d).select(*keys(), E.davies(z_col(), F.col("l_tax")).alias("davies"), E.debye_huckel(z_col(), F.col("l_tax"), F.lit(0.3)).alias("debye"))),
    f"SELECT {L}, round(power(10.0, -0.509 * {Z_} * {Z_} * (sqrt(l_tax) / (1 + sqrt(l_tax)) - 0.3 * l_tax)), 6) AS davies, round(power(10.0, -0.509 * {Z_} * {Z_} * sqrt(l_tax) / (1 + 3.29 * 0.3 * sqrt(l_tax))), 6) AS debye FROM lineitem",
)
register(
    "j_selectivity",
    lambda s, d: rounded(line(s, d).select(*keys(), E.effective_activity(F.col("l_discount") + 0.01, z_col(), F.array(F.struct(F.lit(1e-2).alias("k"), (F.col("l_tax") + 0.01).alias("a"), F.lit(1.0).alias("z")), F.struct(F.lit(1e-3).alias("k"), F.lit(0.1).alias("a"), F.lit(2.0).alias("z")))).alias("effective"))),
    f"SELECT {L}, round(l_discount + 0.01 + 1e-2 * power(l_tax + 0.01, {Z_} / 1.0) + 1e-3 * power(0.1, {Z_} / 2.0), 6) AS effective FROM lineitem",
)
UNIT = "(CASE l_linenumber % 4 WHEN 0 THEN 'mV' WHEN 1 THEN 'C' WHEN 2 THEN 'min' ELSE 'furlong' END)"
register(
    "j_units",
    lambda s, d: rounded(line(s, d).select(*keys(), unit_col().alias("unit"), E.to_base(F.col("l_quantity"), unit_col()).alias("base"))),
    f"SELECT {L}, {UNIT} AS unit, round(CASE l_linenumber % 4 WHEN 0 THEN l_quantity * 1e-3 WHEN 1 THEN l_quantity + 273.15 WHEN 2 THEN l_quantity * 60 END, 6) AS base FROM lineitem",
)
register(
    "j_state_transforms",
    lambda s, d: rounded(line(s, d).select(*keys(), F.when(F.col("l_discount") > 0, F.log10("l_discount")).alias("log10"), E.logistic(F.col("l_tax"), 0.0, 5.0).alias("bounded"), E.logit(F.col("l_discount"), 0.0, 0.1).alias("unbounded"), E.stepped_z(F.col("l_discount") * 10).alias("z"))),
    f"SELECT {L}, round(CASE WHEN l_discount > 0 THEN log10(l_discount) END, 6) AS log10, round(0.0 + 5.0 / (1 + exp(-l_tax)), 6) AS bounded, round(CASE WHEN l_discount > 0 AND l_discount < 0.1 THEN ln((l_discount - 0.0) / (0.1 - l_discount)) END, 6) AS unbounded, round(CASE WHEN l_discount * 10 >= 0.99 THEN 2.576 WHEN l_discount * 10 >= 0.95 THEN 1.96 ELSE 1.645 END, 6) AS z FROM lineitem",
)
register(
    "d28_ionic_strength",
    lambda s, d: rounded(line(s, d).groupBy(F.col("l_orderkey").alias("solution")).agg((0.5 * F.sum(F.col("l_quantity") / 1000 * z_col() * z_col())).alias("ionic_strength"))),
    f"SELECT l_orderkey AS solution, round(0.5 * sum(l_quantity / 1000 * {Z_} * {Z_}), 6) AS ionic_strength FROM lineitem GROUP BY l_orderkey",
)


def temperatures(s, d):
    """Slopes of each line's charge at its own temperature, where it has one, and at the two fixed ones, by convention."""
    own = F.when(F.col("l_linenumber") % 3 != 0, t_col() - F.when(F.col("l_quantity") == 1, 400.0).otherwise(0.0))
    out = line(s, d)
    picked = {m: E.effective_temperature(m, own, 298.15, 293.15) for m in ("constant", "reference", "observation")}
    slopes = {f"{m}_{sign}": E.response_slope(E.nernst_slope(t, -z_col()), sign) for m, t in picked.items() for sign in ("auto", "positive", "negative")}
    return out.select(*keys(), *(c.alias(n) for n, c in slopes.items()))


def _signed(t: str) -> str:
    slope = f"(2.302585092994046 * {E.GAS} * {t} / (-{Z_} * {E.FARADAY}))"
    return ", ".join(f"round(CASE WHEN {t} > 0 THEN {x} END, 6) AS {{m}}_{n}" for n, x in (("auto", slope), ("positive", f"abs{slope}"), ("negative", f"-abs{slope}")))


_OWN = f"coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN {T_} - CASE WHEN l_quantity = 1 THEN 400.0 ELSE 0.0 END END, 298.15)"
register(
    "j_temperature_policy",
    lambda s, d: rounded(temperatures(s, d)),
    f"SELECT {L}, {_signed('298.15').format(m='constant')}, {_signed('293.15').format(m='reference')}, {_signed(_OWN).format(m='observation')} FROM lineitem",
)
_MODELS = ("ideal", "davies", "debye_huckel", "conductivity", "user_provided")


def evaluated(s, d):
    """Activities by a model that goes with the quantity; some lines bring an activity or a coefficient of their own, some lack what it needs."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (q % 5 + 1).cast("int"))
    a = E.evaluate_activity(
        model, F.when(q != 17, F.col("l_discount") - F.when(q == 18, 1.0).otherwise(0.0) + 0.001), F.when(q == 19, 0.0).otherwise(z_col()), explicit=F.when(q == 20, F.col("l_tax") - 0.02), coefficient=F.when(n == 5, F.col("l_tax") - 0.01),
        ionic=F.when(q != 21, F.col("l_discount") * 6), conductivity=F.when(q != 28, F.col("l_tax")), b0=0.1, b1=-2.0, conductivity_range=(0.01, 0.06),
    )
    return line(s, d).select(*keys(), a.alias("v")).select("*", "v.*").drop("v")


register(
    "j_activity_evaluation",
    lambda s, d: rounded(evaluated(s, d)),
    f"""WITH x AS (SELECT {L}, CASE l_quantity % 5 WHEN 0 THEN 'ideal' WHEN 1 THEN 'davies' WHEN 2 THEN 'debye_huckel' WHEN 3 THEN 'conductivity' ELSE 'user_provided' END AS m, CASE WHEN l_quantity <> 17 THEN l_discount - CASE WHEN l_quantity = 18 THEN 1.0 ELSE 0.0 END + 0.001 END AS c, CASE WHEN l_quantity = 19 THEN 0.0 ELSE {Z_} END AS z,
 CASE WHEN l_quantity = 20 THEN l_tax - 0.02 END AS ea, CASE WHEN l_linenumber = 5 THEN l_tax - 0.01 END AS eg, CASE WHEN l_quantity <> 21 THEN l_discount * 6 END AS i, CASE WHEN l_quantity <> 28 THEN l_tax END AS kappa FROM lineitem),
 r AS (SELECT *, CASE WHEN z = 0 THEN 'charge' WHEN eg <= 0 THEN 'coefficient' WHEN ea <= 0 THEN 'explicit_activity' WHEN ea IS NULL AND (c IS NULL OR c <= 0) THEN 'concentration' WHEN ea IS NULL AND eg IS NULL AND m = 'user_provided' THEN 'model' WHEN ea IS NULL AND eg IS NULL AND m IN ('davies', 'debye_huckel') AND i IS NULL THEN 'ionic_strength' WHEN ea IS NULL AND eg IS NULL AND m = 'conductivity' AND kappa IS NULL THEN 'conductivity' END AS reason,
 CASE WHEN eg IS NOT NULL THEN eg WHEN ea IS NOT NULL THEN NULL WHEN m = 'ideal' THEN 1.0 WHEN m = 'davies' THEN power(10.0, -0.509 * z * z * (sqrt(i) / (1 + sqrt(i)) - 0.3 * i)) WHEN m = 'debye_huckel' THEN power(10.0, -0.509 * z * z * sqrt(i) / (1 + 3.29 * 0.3 * sqrt(i))) END AS g, ea IS NULL AND eg IS NULL AND m = 'conductivity' AS emp FROM x)
 SELECT o, l, p, series, CASE WHEN reason IS NULL THEN round(CASE WHEN ea IS NOT NULL THEN ea WHEN emp THEN power(10.0, log10(c) + 0.1 - 2.0 * kappa) ELSE c * g END, 6) END AS activity, CASE WHEN reason IS NULL THEN round(g, 6) END AS coefficient, reason IS NULL AND emp AS empirical,
 CASE WHEN reason IS NULL AND ea IS NULL AND eg IS NULL THEN CASE WHEN m = 'davies' AND i > 0.5 OR m = 'debye_huckel' AND i > 0.1 THEN 'ionic_strength' WHEN emp AND (kappa < 0.01 OR kappa > 0.06) THEN 'conductivity' END END AS warning, reason FROM r""",
)
_OTHERS = lambda: F.array(F.struct(F.lit(1e-2).alias("k"), (F.col("l_tax") + 0.01).alias("a"), F.lit(1.0).alias("z")))
register(
    "j_selectivity_inverse",
    lambda s, d: rounded(line(s, d).select(*keys(), E.primary_activity(F.col("l_discount") + 0.0005, z_col(), _OTHERS()).alias("own"), E.selectivity_derivative(E.nernst_slope(t_col(), z_col()), F.col("l_discount")).alias("derivative"), E.logistic_derivative(F.col("l_tax"), 0.0, 5.0).alias("bounded_slope"), E.logit_derivative(F.col("l_discount"), 0.0, 0.1).alias("unbounded_slope"))),
    f"SELECT {L}, round(CASE WHEN l_discount + 0.0005 - 1e-2 * power(l_tax + 0.01, {Z_}) > 0 THEN l_discount + 0.0005 - 1e-2 * power(l_tax + 0.01, {Z_}) END, 6) AS own, round(CASE WHEN l_discount > 0 THEN {SLOPE} / (2.302585092994046 * l_discount) END, 6) AS derivative, round(5.0 * (1 / (1 + exp(-l_tax))) * (1 - 1 / (1 + exp(-l_tax))), 6) AS bounded_slope, round(CASE WHEN l_discount > 0 AND l_discount < 0.1 THEN 0.1 / (l_discount * (0.1 - l_discount)) END, 6) AS unbounded_slope FROM lineitem",
)


def unit_reasons(s, d):
    u = F.element_at(F.array(*map(F.lit, ("mV", "C", "g/L", "mmol/L", "mg/L", "furlong", "L/min", "K"))), (F.col("l_partkey") % 8 + 1).cast("int"))
    v = F.col("l_quantity") - F.when(u.isin("C", "K"), 280.0).otherwise(0.0)
    return line(s, d).select(*keys(), u.alias("unit"), E.molar(v, u, F.when(F.col("l_linenumber") != 3, 58.44)).alias("molar"), E.unit_problem(v, u, "temperature").alias("as_temperature"), E.unit_problem(v, u, "concentration").alias("as_concentration"))


register(
    "j_unit_reasons",
    lambda s, d: rounded(unit_reasons(s, d)),
    f"""WITH x AS (SELECT *, list_extract(['mV', 'C', 'g/L', 'mmol/L', 'mg/L', 'furlong', 'L/min', 'K'], CAST(l_partkey % 8 + 1 AS BIGINT)) AS u FROM lineitem), y AS (SELECT *, l_quantity - CASE WHEN u IN ('C', 'K') THEN 280.0 ELSE 0.0 END AS v FROM x)
 SELECT {L}, u AS unit, round(CASE WHEN u = 'mmol/L' THEN v * 1e-3 WHEN l_linenumber <> 3 AND u = 'g/L' THEN v / 58.44 WHEN l_linenumber <> 3 AND u = 'mg/L' THEN v * 1e-3 / 58.44 END, 6) AS molar, CASE WHEN u = 'furlong' THEN 'unknown_unit' WHEN u NOT IN ('C', 'K') THEN 'other_dimension' WHEN u = 'C' AND v + 273.15 <= 0 OR u = 'K' AND v <= 0 THEN 'not_above_zero' END AS as_temperature,
 CASE WHEN u = 'furlong' THEN 'unknown_unit' WHEN u <> 'mmol/L' THEN 'other_dimension' END AS as_concentration FROM y""",
)
