"""Registered spectrum queries."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.functions import complexes as Z
from sensorframe.operators import kramers_kronig as K
from sensorframe.operators import spectra as P
from sensorframe.operators import topologies as G
from sensorframe.plans.common import Registry, rounded
from sensorframe.sources.views import spectra

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
S = "WITH s AS (SELECT l_suppkey AS spectrum_id, l_quantity AS level, power(10.0, (l_quantity - 1) / 10) AS freq_hz, avg(l_extendedprice) AS z_re, -1e3 * avg(l_discount) AS z_im FROM lineitem GROUP BY ALL)"
PREP = S + f", p AS (SELECT *, 2 * {math.pi!r} * freq_hz AS omega, greatest(sqrt(z_re * z_re + z_im * z_im), 1.0) AS weight, row_number() OVER (PARTITION BY spectrum_id ORDER BY freq_hz DESC) AS rank FROM s QUALIFY count(*) OVER (PARTITION BY spectrum_id) >= 3)"
ID = "spectrum_id"
GRID = [(f"zarc{a}", 10.0**-e, a) for e in range(6) for a in (0.7, 0.85)] + [("rc", 10.0**-e, 1.0) for e in range(6)]


def prep(s, d):
    return P.prepare(spectra(s, d))


register(
    "a04_bode",
    lambda s, d: rounded(P.bode(spectra(s, d)).select("spectrum_id", "level", "freq_hz", "magnitude", "phase_deg"), 5),
    S + " SELECT spectrum_id, level, round(freq_hz, 5) AS freq_hz, round(sqrt(z_re * z_re + z_im * z_im), 5) AS magnitude, round(degrees(atan2(z_im, z_re)), 5) AS phase_deg FROM s",
)
register(
    "b04_frequency_crop",
    lambda s, d: rounded(spectra(s, d).where(F.col("freq_hz").between(10.0, 5000.0)), 4),
    S + " SELECT spectrum_id, level, round(freq_hz, 4) AS freq_hz, round(z_re, 4) AS z_re, round(z_im, 4) AS z_im FROM s WHERE freq_hz BETWEEN 10 AND 5000",
)
register(
    "b05_drop_inductive",
    lambda s, d: rounded(spectra(s, d, ordered=True).withColumn("z_im", F.col("z_im") + 50).where("z_im < 0"), 4),
    S + " SELECT spectrum_id, level, round(freq_hz, 4) AS freq_hz, round(z_re, 4) AS z_re, round(z_im + 50, 4) AS z_im FROM s WHERE z_im + 50 < 0",
)
register(
    "b06_prepare",
    lambda s, d: rounded(prep(s, d).select("spectrum_id", "level", "omega", "weight", "rank"), 4),
    PREP + " SELECT spectrum_id, level, round(omega, 4) AS omega, round(weight, 4) AS weight, rank FROM p",
)
register(
    "b07_select_positions",
    lambda s, d: rounded(prep(s, d).withColumnRenamed("rank", "position").join(s.range(1).select(F.posexplode(F.array(F.lit(5), F.lit(1), F.lit(5), F.lit(12))).alias("request", "position")), "position").select("spectrum_id", "request", "position", "z_re"), 4),
    PREP + " SELECT spectrum_id, CAST(request AS BIGINT) AS request, CAST(position AS BIGINT) AS position, round(z_re, 4) AS z_re FROM p JOIN (VALUES (0, 5), (1, 1), (2, 5), (3, 12)) q(request, position) ON p.rank = q.position",
)
register(
    "b08_nearest_x",
    lambda s, d: rounded(prep(s, d).crossJoin(F.broadcast(s.createDataFrame([(30.0,), (4000.0,)], "target double"))).groupBy("spectrum_id", "target").agg(F.min_by(F.struct("rank", "z_re"), F.struct(F.abs(F.col("freq_hz") - F.col("target")), F.col("rank"))).alias("b")).select("spectrum_id", "target", "b.rank", "b.z_re"), 4),
    PREP + ", q AS (SELECT *, row_number() OVER (PARTITION BY spectrum_id, target ORDER BY abs(freq_hz - target), rank) AS i FROM p, (VALUES (30.0), (4000.0)) t(target)) SELECT spectrum_id, CAST(target AS DOUBLE) AS target, rank, round(z_re, 4) AS z_re FROM q WHERE i = 1",
)
register(
    "b09_reassign",
    lambda s, d: rounded(prep(s, d).join(s.createDataFrame([(1, 5.5), (3, 7.25)], "rank int, new_x double"), "rank", "left").select("spectrum_id", "rank", F.coalesce("new_x", "freq_hz").alias("freq_hz"), "z_re"), 4),
    PREP + " SELECT spectrum_id, p.rank, round(coalesce(CAST(new_x AS DOUBLE), freq_hz), 4) AS freq_hz, round(z_re, 4) AS z_re FROM p LEFT JOIN (VALUES (1, 5.5), (3, 7.25)) q(rank, new_x) ON p.rank = q.rank",
)
SC = PREP + ", g(shape, tau, alpha) AS (VALUES %s)" % ", ".join(f"('{n}', CAST({t!r} AS DOUBLE), CAST({a!r} AS DOUBLE))" for n, t, a in GRID) + f""",
 m AS (SELECT p.*, shape, tau, alpha, 1 + power(omega * tau, alpha) * cos({math.pi / 2!r} * alpha) AS u, power(omega * tau, alpha) * sin({math.pi / 2!r} * alpha) AS v FROM p, g),
 ab AS (SELECT *, u / (u * u + v * v) AS a, -v / (u * u + v * v) AS b FROM m),
 t AS (SELECT spectrum_id, shape, tau, alpha, count(*) AS n, sum(a) AS sa, sum(a * a + b * b) AS saa, sum(z_re) AS sy, sum(a * z_re + b * z_im) AS say, sum(z_re * z_re + z_im * z_im) AS syy FROM ab GROUP BY ALL),
 c AS (SELECT *, (n * say - sa * sy) / (n * saa - sa * sa) AS s1 FROM t WHERE n * saa - sa * sa > 1e-12), c2 AS (SELECT *, (sy - s1 * sa) / n AS s0 FROM c),
 sc AS (SELECT *, greatest(syy - s0 * sy - s1 * say, 1e-9) AS rss FROM c2), k AS (SELECT *, 2 * n * ln(rss / (2 * n)) + 8 AS aic, 2 * n * ln(rss / (2 * n)) + 4 * ln(2 * n) AS bic FROM sc),
 best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY spectrum_id ORDER BY bic, rss, shape, tau, alpha) = 1)"""
register(
    "g06_score_shapes",
    lambda s, d: rounded(P.score_shapes(prep(s, d), GRID).select("spectrum_id", "shape", "tau", "s0", "s1", (F.col("rss") / 1e6).alias("rss_m")), 3),
    SC + " SELECT spectrum_id, shape, round(tau, 3) AS tau, round(s0, 3) AS s0, round(s1, 3) AS s1, round(rss / 1e6, 3) AS rss_m FROM k",
)
register(
    "d20_candidate_scores",
    lambda s, d: rounded(P.score_shapes(prep(s, d), GRID).select("spectrum_id", "shape", "tau", "n", "aic", "bic"), 4),
    SC + " SELECT spectrum_id, shape, round(tau, 4) AS tau, n, round(aic, 4) AS aic, round(bic, 4) AS bic FROM k",
)
register(
    "e12_candidate_order",
    lambda s, d: rounded(P.score_shapes(prep(s, d), GRID).groupBy("spectrum_id", "shape").agg(F.min("bic").alias("bic")).withColumn("place", F.row_number().over(W.partitionBy("spectrum_id").orderBy("bic", "shape"))), 4),
    SC + ", q AS (SELECT spectrum_id, shape, min(bic) AS bic FROM k GROUP BY ALL) SELECT spectrum_id, shape, round(bic, 4) AS bic, row_number() OVER (PARTITION BY spectrum_id ORDER BY bic, shape) AS place FROM q",
)
register(
    "e13_preferred_with_margin",
    lambda s, d: P.score_shapes(prep(s, d), GRID).groupBy("spectrum_id").agg(F.min(F.when(F.col("shape") == "rc", F.col("aic"))).alias("plain"), F.min(F.when(F.col("shape") != "rc", F.col("aic"))).alias("extended")).select("spectrum_id", F.when(F.col("extended") + 2 < F.col("plain"), "extended").otherwise("plain").alias("preferred")),
    SC + " SELECT spectrum_id, CASE WHEN min(aic) FILTER (shape <> 'rc') + 2 < min(aic) FILTER (shape = 'rc') THEN 'extended' ELSE 'plain' END AS preferred FROM k GROUP BY spectrum_id",
)


def best(s, d):
    return P.best_shape(P.score_shapes(prep(s, d), GRID))


RES = SC + f""", r AS (SELECT p.*, s0 + s1 * u / (u * u + v * v) AS fit_re, -s1 * v / (u * u + v * v) AS fit_im FROM (SELECT p.*, s0, s1, 1 + power(omega * tau, alpha) * cos({math.pi / 2!r} * alpha) AS u, power(omega * tau, alpha) * sin({math.pi / 2!r} * alpha) AS v FROM p JOIN best USING (spectrum_id)) p),
 e AS (SELECT *, fit_re - z_re AS d_re, fit_im - z_im AS d_im FROM r)"""
register(
    "d19_fit_metrics",
    lambda s, d: rounded(P.fit_metrics(P.residuals(prep(s, d), best(s, d))).select("spectrum_id", "n", "weighted_sse", "weighted_rmse", "aic_weighted", "rmse_re", "rmse_im", "max_modulus_error", "legacy_score"), 3),
    RES + """, z AS (SELECT *, (d_re * d_re + d_im * d_im) AS sq FROM e) SELECT spectrum_id, count(*) AS n, round(sum(sq / (weight * weight)), 3) AS weighted_sse, round(sqrt(sum(sq / (weight * weight)) / (2 * count(*))), 3) AS weighted_rmse,
 round(2 * count(*) * ln(greatest(sum(sq / (weight * weight)), 1e-30) / (2 * count(*))) + 8, 3) AS aic_weighted, round(sqrt(avg(d_re * d_re)), 3) AS rmse_re, round(sqrt(avg(d_im * d_im)), 3) AS rmse_im,
 round(max(abs(sqrt(fit_re * fit_re + fit_im * fit_im) - sqrt(z_re * z_re + z_im * z_im))), 3) AS max_modulus_error, round(sum(sq / sqrt(z_re * z_re + z_im * z_im)), 3) AS legacy_score FROM z GROUP BY spectrum_id""",
)
register(
    "d22_spectrum_residuals",
    lambda s, d: rounded(P.residual_summary(P.residuals(prep(s, d), best(s, d))), 3),
    RES + ", h AS (SELECT *, rank <= floor(count(*) OVER (PARTITION BY spectrum_id) / 2) AS high FROM e) SELECT spectrum_id, round(avg(d_re), 3) AS mean_re, round(avg(d_im), 3) AS mean_im, round(avg(d_re) FILTER (high), 3) AS high_bias, round(avg(d_re) FILTER (NOT high), 3) AS low_bias FROM h GROUP BY spectrum_id",
)
register(
    "d41_fit_report",
    lambda s, d: rounded(P.residuals(prep(s, d), best(s, d)).select("spectrum_id", "level", "d_re", "d_im", (F.hypot("fit_re", "fit_im") - F.hypot("z_re", "z_im")).alias("d_mag"), (F.hypot("d_re", "d_im") / F.col("weight")).alias("normalised")), 3),
    RES + " SELECT spectrum_id, level, round(d_re, 3) AS d_re, round(d_im, 3) AS d_im, round(sqrt(fit_re * fit_re + fit_im * fit_im) - sqrt(z_re * z_re + z_im * z_im), 3) AS d_mag, round(sqrt(d_re * d_re + d_im * d_im) / weight, 3) AS normalised FROM e",
)
register(
    "g07_initial_features",
    lambda s, d: rounded(P.initial_features(P.prepare(spectra(s, d, ordered=True))), 3),
    PREP + """, q AS (SELECT *, count(*) OVER (PARTITION BY spectrum_id) AS n FROM p) SELECT spectrum_id, round(avg(z_re) FILTER (rank <= 5), 3) AS series_resistance, round(max(-z_im), 3) AS peak, round(arg_max(omega, (-z_im, omega)), 3) AS peak_omega,
 round(avg(-z_im * sqrt(omega)) FILTER (rank > n - 3), 3) AS tail_sigma, round(max(z_re) - min(z_re), 3) AS diameter FROM q GROUP BY spectrum_id""",
)
register(
    "g09_timescales",
    lambda s, d: rounded(best(s, d).join(prep(s, d).groupBy("spectrum_id").agg(F.min("omega").alias("lo"), F.max("omega").alias("hi")), "spectrum_id").select("spectrum_id", "tau", (F.abs("s1") * F.col("tau")).alias("rq"), F.pow(F.col("tau"), 1 / F.col("alpha")).alias("tau_alpha"), ((1 / F.col("tau") < F.col("lo")) | (1 / F.col("tau") > F.col("hi"))).alias("out_of_band")), 4),
    SC + ", b AS (SELECT spectrum_id, min(omega) AS lo, max(omega) AS hi FROM p GROUP BY ALL) SELECT spectrum_id, round(tau, 4) AS tau, round(abs(s1) * tau, 4) AS rq, round(power(tau, 1 / alpha), 4) AS tau_alpha, 1 / tau < lo OR 1 / tau > hi AS out_of_band FROM best JOIN b USING (spectrum_id)",
)
register(
    "g21_nyquist_table",
    lambda s, d: rounded(P.residuals(prep(s, d), best(s, d)).select("spectrum_id", "level", F.explode(F.array(F.struct(F.lit("measured").alias("kind"), F.col("z_re").alias("x"), (-F.col("z_im")).alias("y")), F.struct(F.lit("fitted").alias("kind"), F.col("fit_re").alias("x"), (-F.col("fit_im")).alias("y")))).alias("c")).select("spectrum_id", "level", "c.*"), 3),
    RES + " SELECT spectrum_id, level, 'measured' AS kind, round(z_re, 3) AS x, round(-z_im, 3) AS y FROM e UNION ALL SELECT spectrum_id, level, 'fitted', round(fit_re, 3), round(-fit_im, 3) FROM e",
)
ROOT = "sqrt(omega * 1e-3 / 2)"
register(
    "g04_elements",
    lambda s, d: rounded(_elements(s, d), 5),
    PREP + f""", x AS (SELECT *, {ROOT} AS h, power(omega, 0.8) * cos({math.pi / 2 * 0.8!r}) AS cr, power(omega, 0.8) * sin({math.pi / 2 * 0.8!r}) AS ci FROM p),
 t AS (SELECT *, sinh(2 * h) / (cosh(2 * h) + cos(2 * h)) AS tr, sin(2 * h) / (cosh(2 * h) + cos(2 * h)) AS ti FROM x)
 SELECT spectrum_id, level, round(-1 / (omega * 1e-4), 5) AS c_im, round(omega * 1e-3, 5) AS l_im, round(50 / sqrt(omega), 5) AS w_re, round(cr * 2e-3 / (4e-6 * (cr * cr + ci * ci)), 5) AS cpe_re, round(-ci * 2e-3 / (4e-6 * (cr * cr + ci * ci)), 5) AS cpe_im,
 round(100 * (tr + ti) * h / (2 * h * h), 5) AS ws_re, round(100 * (ti - tr) * h / (2 * h * h), 5) AS ws_im, round(100 / power(1 + power(omega * 1e-3, 2), 0.25) * cos(atan2(omega * 1e-3, 1) / 2), 5) AS g_re FROM t""",
)


def _elements(s, d):
    w = F.col("omega")
    lit = F.lit
    c, ind, wb = Z.capacitor(lit(1e-4), w), Z.inductor(lit(1e-3), w), Z.warburg(lit(50.0), w)
    q, ws, g = Z.cpe(lit(2e-3), lit(0.8), w), Z.finite_warburg(lit(100.0), lit(1e-3), w), Z.gerischer(lit(100.0), lit(1e-3), w)
    return prep(s, d).select("spectrum_id", "level", c.im.alias("c_im"), ind.im.alias("l_im"), wb.re.alias("w_re"), q.re.alias("cpe_re"), q.im.alias("cpe_im"), ws.re.alias("ws_re"), ws.im.alias("ws_im"), g.re.alias("g_re"))


register(
    "g05_circuit",
    lambda s, d: rounded(prep(s, d).select("spectrum_id", "level", *(lambda z: (z.re.alias("re"), z.im.alias("im")))(Z.circuit(("series", ["R0", ("parallel", ["R1", "C1"])]), {"R0": [F.lit(260.0)], "R1": [F.lit(5000.0)], "C1": [F.lit(2e-5)]}, F.col("omega")))), 4),
    PREP + " SELECT spectrum_id, level, round(260 + 5000 / (1 + power(omega * 0.1, 2)), 4) AS re, round(-5000 * omega * 0.1 / (1 + power(omega * 0.1, 2)), 4) AS im FROM p",
)


def kk(s, d):
    return K.kramers_kronig(spectra(s, d), [ID])


def _eliminated(p: int) -> str:
    """CTEs that solve the system a11..app, b1..bp of table n0 by elimination and substitution, one step each."""
    out = ""
    for k in range(1, p):
        cells = [f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}" for i in range(k + 1, p + 1) for j in range(k + 1, p + 1)] + [f"b{i} - a{i}{k} * b{k} / a{k}{k} AS b{i}" for i in range(k + 1, p + 1)]
        out += f", n{k} AS (SELECT * REPLACE ({', '.join(cells)}) FROM n{k - 1})"
    for k in range(p, 0, -1):
        known = "".join(f" - a{k}{j} * x{j}" for j in range(k + 1, p + 1))
        out += f", x{k} AS (SELECT *, (b{k}{known}) / a{k}{k} AS x{k} FROM {f'x{k + 1}' if k < p else f'n{p - 1}'})"
    return out


_P, _TAU = 4, "exp(ln(tau_min) + {k} / 2.0 * ln(tau_max / tau_min))"
_COLUMNS = [("1.0", "0.0")] + [(f"1 / (1 + power(w * {_TAU.format(k=k)}, 2))", f"-(w * {_TAU.format(k=k)}) / (1 + power(w * {_TAU.format(k=k)}, 2))") for k in range(3)]
register(
    "g08_kramers_kronig",
    lambda s, d: rounded(K.kramers_kronig(spectra(s, d), [ID], first=3, most=3).select(ID, "m", "n", "mu", *((F.col("series") if not k else F.get("resistances", F.lit(k - 1))).alias(f"r{k}") for k in range(4)), F.sqrt(F.col("rss") / F.col("n")).alias("rms")), 4),
    """WITH q AS (SELECT l_suppkey AS spectrum_id, power(10.0, (l_quantity - 1) / 10) AS f, avg(l_extendedprice) AS z_re, -1e3 * avg(l_discount) AS z_im FROM lineitem GROUP BY l_suppkey, l_quantity),
 t AS (SELECT *, 2 * pi() * f AS w, 1 / (2 * pi() * max(f) OVER (PARTITION BY spectrum_id)) AS tau_min, 1 / (2 * pi() * min(f) OVER (PARTITION BY spectrum_id)) AS tau_max FROM q),
 c AS (SELECT *, """ + ", ".join(f"{re} AS p{i}, {im} AS q{i}" for i, (re, im) in enumerate(_COLUMNS, 1)) + """ FROM t WHERE tau_min < tau_max),
 n0 AS (SELECT spectrum_id, count(*) AS n, """ + ", ".join(f"sum(p{i} * p{j} + q{i} * q{j}) AS a{i}{j}" for i in range(1, _P + 1) for j in range(1, _P + 1)) + ", " + ", ".join(f"sum(p{i} * z_re + q{i} * z_im) AS b{i}" for i in range(1, _P + 1)) + " FROM c GROUP BY spectrum_id)" + _eliminated(_P) + """,
 e AS (SELECT spectrum_id, sum(power(z_re - x1 * p1 - x2 * p2 - x3 * p3 - x4 * p4, 2) + power(z_im - x1 * q1 - x2 * q2 - x3 * q3 - x4 * q4, 2)) AS rss FROM c JOIN x1 USING (spectrum_id) GROUP BY spectrum_id)
 SELECT spectrum_id, 3::BIGINT AS m, n, round(CASE WHEN least(x2, x3, x4) < 0 THEN 1 - (greatest(x2, 0) + greatest(x3, 0) + greatest(x4, 0)) / -(least(x2, 0) + least(x3, 0) + least(x4, 0)) ELSE -1.0 END, 4) AS mu, round(x1, 4) AS r0, round(x2, 4) AS r1, round(x3, 4) AS r2, round(x4, 4) AS r3, round(sqrt(rss / n), 4) AS rms FROM x1 JOIN e USING (spectrum_id)""",
)
register("g08_kramers_kronig_residuals", lambda s, d: rounded(K.residuals(spectra(s, d), kk(s, d), [ID]).select(ID, "freq_hz", "res_re", "res_im")))

COARSE = G.Grid(steps=6, rounds=0)


def scored_topologies(s, d, names, grid):
    f = G.score_topologies(spectra(s, d), [ID], topologies=names, grid=grid)
    term = F.get("terms", F.lit(0))
    return f.select(ID, "topology", "n", "k", "r0", term["scale"].alias("scale"), F.log10(term["tau"]).alias("log_tau"), term["alpha"].alias("alpha"), (F.col("rss") / 1e6).alias("rss_m"), "aic", "bic", "delta")


register(
    "g06_topologies",
    lambda s, d: rounded(scored_topologies(s, d, ("randles", "gerischer"), COARSE), 4),
    f"""WITH q AS (SELECT l_suppkey AS spectrum_id, power(10.0, (l_quantity - 1) / 10) AS f, avg(l_extendedprice) AS z_re, -1e3 * avg(l_discount) AS z_im FROM lineitem GROUP BY l_suppkey, l_quantity), e AS (SELECT spectrum_id, 1 / (2 * pi() * max(f)) AS lo, 1 / (2 * pi() * min(f)) AS hi FROM q GROUP BY spectrum_id HAVING max(f) > min(f)),
 c AS (SELECT spectrum_id, topology, alpha, exp(ln(lo) + i / {COARSE.steps}.0 * ln(hi / lo)) AS tau FROM e, range({COARSE.steps + 1}) t(i), (VALUES ('randles', 0.6::DOUBLE), ('randles', 0.8), ('randles', 1.0), ('gerischer', 1.0)) u(topology, alpha)),
 x AS (SELECT c.*, z_re, z_im, 2 * pi() * f * tau AS w FROM c JOIN q USING (spectrum_id)), y AS (SELECT *, 1 + power(w, alpha) * cos(pi() / 2 * alpha) AS u, power(w, alpha) * sin(pi() / 2 * alpha) AS v FROM x),
 h AS (SELECT *, CASE topology WHEN 'randles' THEN u / (u * u + v * v) ELSE power(1 + w * w, -0.25) * cos(atan(w) / 2) END AS a, CASE topology WHEN 'randles' THEN -v / (u * u + v * v) ELSE -power(1 + w * w, -0.25) * sin(atan(w) / 2) END AS b FROM y),
 g AS (SELECT spectrum_id, topology, alpha, tau, count(*) AS n, sum(a) AS a, sum(a * a + b * b) AS aa, sum(z_re) AS y, sum(a * z_re + b * z_im) AS ay, sum(z_re * z_re + z_im * z_im) AS yy FROM h GROUP BY ALL),
 r AS (SELECT *, (y * aa - a * ay) / (n * aa - a * a) AS r0, (n * ay - a * y) / (n * aa - a * a) AS s FROM g), m AS (SELECT *, yy - r0 * y - s * ay AS rss FROM r WHERE s > 0 AND r0 >= 0),
 k AS (SELECT *, CASE topology WHEN 'randles' THEN 4 ELSE 3 END AS k, row_number() OVER (PARTITION BY spectrum_id, topology ORDER BY rss) AS i FROM m), z AS (SELECT *, 2 * n * ln(rss / (2 * n)) AS fit FROM k WHERE i = 1)
 SELECT spectrum_id, topology, n, CAST(k AS BIGINT) AS k, round(r0, 4) AS r0, round(s, 4) AS scale, round(log10(tau), 4) AS log_tau, round(alpha, 4) AS alpha, round(rss / 1e6, 4) AS rss_m, round(fit + 2 * k, 4) AS aic, round(fit + k * ln(2 * n), 4) AS bic, round(fit + k * ln(2 * n) - min(fit + k * ln(2 * n)) OVER (PARTITION BY spectrum_id), 4) AS delta FROM z""",
)
register("g06_topologies_refined", lambda s, d: rounded(scored_topologies(s, d, tuple(G.TOPOLOGIES), G.Grid(steps=6, rounds=1)), 4))


def strict(s, d):
    """Spectra cut to as many points as their number allows, with requests that some of them cannot meet."""
    p = prep(s, d).where((F.col("rank") <= 6) | (F.col(ID) % 3 != 0))
    return P.select_positions(p, s.createDataFrame([(0, 5), (1, 1), (2, 5), (3, 12)], "request int, position int"))


CUT = PREP + ", c AS (SELECT * FROM p WHERE rank <= 6 OR spectrum_id % 3 <> 0)"
register(
    "b07_strict_positions",
    lambda s, d: rounded(strict(s, d)[0].select(ID, "request", "position", "z_re"), 4),
    CUT + " SELECT spectrum_id, CAST(request AS BIGINT) AS request, CAST(position AS BIGINT) AS position, round(z_re, 4) AS z_re FROM c JOIN (VALUES (0, 5), (1, 1), (2, 5), (3, 12)) q(request, position) ON c.rank = q.position WHERE spectrum_id IN (SELECT spectrum_id FROM c GROUP BY 1 HAVING count(*) >= 12)",
)
register(
    "b07_refused_positions",
    lambda s, d: rounded(strict(s, d)[1]),
    CUT + " SELECT spectrum_id, count(*) AS points, CASE WHEN count(*) < 5 THEN 5 ELSE 12 END::BIGINT AS position FROM c GROUP BY spectrum_id HAVING count(*) < 12",
)


def reassigned(s, d):
    """New frequencies for two thirds of the spectra; every sixth has a value too few."""
    p = prep(s, d)
    v = p.where(f"{ID} % 3 <> 0 AND NOT ({ID} % 6 = 1 AND rank = 2)").select(ID, "rank", (F.col("freq_hz") * 2).alias("value"))
    return P.reassign(p, v, "freq_hz")


register(
    "b09_strict_reassign",
    lambda s, d: rounded(reassigned(s, d)[0].select(ID, "rank", "freq_hz", "z_re"), 4),
    PREP + " SELECT spectrum_id, rank, round(CASE WHEN spectrum_id % 3 <> 0 THEN 2 * freq_hz ELSE freq_hz END, 4) AS freq_hz, round(z_re, 4) AS z_re FROM p WHERE spectrum_id % 6 <> 1",
)
register("b09_refused_reassign", lambda s, d: reassigned(s, d)[1], PREP + ' SELECT spectrum_id, count(*) AS points, count(*) - 1 AS "values" FROM p WHERE spectrum_id % 6 = 1 GROUP BY spectrum_id')
