"""Registered assessment, prediction, ingest and history queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators import assess as A
from sensorframe.operators import lineage as G
from sensorframe.operators import series as S
from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import R
from sensorframe.sources import ingest
from sensorframe.sources.storage import fresh_path
from sensorframe.sources.views import SERIES, observations, readings, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def contexts(s, d):
    """A customer's context beside that of the first customer of its nation."""
    c = table(s, d, "customer").select(
        F.col("c_custkey").alias("record"), F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("analyte"), F.when(F.col("c_acctbal") < 2500, "water").when(F.col("c_acctbal") < 6000, "soil").otherwise("serum").alias("sample_matrix"),
        F.when(F.col("c_acctbal") >= 0, 298.0 + F.col("c_acctbal") / 1000).alias("temperature_k"), F.substring("c_name", -1, 1).alias("design"),
    )
    names = ["analyte", "sample_matrix", "temperature_k", "design"]
    base = c.groupBy("site").agg(F.min_by(F.struct(*names), "record").alias("b")).select("site", *(F.col(f"b.{n}").alias(f"b_{n}") for n in names))
    return c.join(base, "site")


register(
    "i02_comparability",
    lambda s, d: A.comparability(contexts(s, d), {"analyte": "analyte", "sample_matrix": "sample_matrix"}, 2.0, {"design": "design"}).select("record", "comparability", "reason"),
    """WITH c AS (SELECT c_custkey AS record, c_nationkey AS site, c_mktsegment AS a, CASE WHEN c_acctbal < 2500 THEN 'water' WHEN c_acctbal < 6000 THEN 'soil' ELSE 'serum' END AS m, CASE WHEN c_acctbal >= 0 THEN 298.0 + CAST(c_acctbal AS DOUBLE) / 1000 END AS t, right(c_name, 1) AS g FROM customer),
 b AS (SELECT site, a AS ba, m AS bm, t AS bt, g AS bg FROM c WHERE record IN (SELECT min(record) FROM c GROUP BY site)),
 k AS (SELECT *, CASE WHEN a <> ba THEN 'analyte' WHEN m <> bm THEN 'sample_matrix' WHEN abs(t - bt) > 2 THEN 'temperature' WHEN g <> bg THEN 'design' END AS why, coalesce(abs(t - bt) > 0, false) AS near FROM c JOIN b USING (site))
 SELECT record, CASE WHEN why IS NOT NULL THEN 'not_comparable' WHEN near THEN 'comparable_with_warnings' ELSE 'comparable' END AS comparability, coalesce(why, CASE WHEN near THEN 'temperature within tolerance' END) AS reason FROM k""",
)


def sampling(s, d):
    r = readings(s, d)
    step = F.col("t_s") - F.lag("t_s").over(W.partitionBy(*SERIES).orderBy("row_idx"))
    axis = r.withColumn("_step", step).groupBy(*SERIES).agg(F.count_if(F.col("_step") == 0).alias("duplicates"), F.count_if(F.col("_step") < 0).alias("backward"))
    return S.sampling_summary(r, SERIES).join(axis, SERIES)


register(
    "i06_quality_gate",
    lambda s, d: A.quality_gate(sampling(s, d), least_samples=8, most_missing=0.2, most_cv=1.1, most_duplicates=0, most_backward=6, most_gap=12 * 86400.0).select(*SERIES, "state", "reason"),
    R + """, w AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY row_idx) AS step, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS dt FROM r),
 g AS (SELECT sensor_id, channel, count(*) AS n, stddev_samp(dt) / avg(dt) AS cv, max(dt) AS gap, count(*) FILTER (step = 0) AS dup, count(*) FILTER (step < 0) AS back FROM w GROUP BY ALL)
 SELECT sensor_id, channel, CASE WHEN cv IS NULL OR n < 8 OR cv > 1.1 OR dup > 0 OR back > 6 OR gap > 1036800 THEN 'poor' ELSE 'adequate' END AS state, CASE WHEN cv IS NULL THEN 'absent' WHEN n < 8 OR cv > 1.1 OR dup > 0 OR back > 6 OR gap > 1036800 THEN 'limit' ELSE 'within' END AS reason FROM g""",
)
LIMITS = [("spread", "sd", 30.0, 60.0, 90.0), ("spread", "range", 100.0, 200.0, 400.0), ("level", "mean", 20.0, 40.0, 80.0), ("level", "offset", 1.0, 2.0, 3.0)]


def metrics(s, d):
    g = readings(s, d).groupBy("sensor_id").agg(F.stddev_samp("value").alias("sd"), (F.max("value") - F.min("value")).alias("range"), F.avg("value").alias("mean"))
    return g.unpivot(["sensor_id"], ["sd", "range", "mean"], "metric", "value").where("value IS NOT NULL")


register(
    "i08_dimension_scores",
    lambda s, d: rounded(A.dimension_scores(metrics(s, d), s.createDataFrame(LIMITS, "dimension string, metric string, watch double, degraded double, critical double"), ["sensor_id"])),
    R + f""", g AS (SELECT sensor_id, stddev_samp(value) AS sd, max(value) - min(value) AS range, avg(value) AS mean FROM r GROUP BY sensor_id),
 m AS (SELECT sensor_id, 'sd' AS metric, sd AS v FROM g UNION ALL SELECT sensor_id, 'range', range FROM g UNION ALL SELECT sensor_id, 'mean', mean FROM g UNION ALL SELECT sensor_id, 'offset', NULL FROM g),
 k AS (SELECT sensor_id, dimension, metric, CASE WHEN v >= critical THEN 3 WHEN v >= degraded THEN 2 WHEN v >= watch THEN 1 WHEN v IS NOT NULL THEN 0 END AS lv FROM m JOIN (VALUES {', '.join(map(str, LIMITS))}) t(dimension, metric, watch, degraded, critical) USING (metric))
 SELECT sensor_id, dimension, CAST(max(lv) AS BIGINT) AS level, arg_min(metric, (-lv, metric)) FILTER (lv IS NOT NULL) AS worst, count(*) FILTER (lv IS NULL) AS absent FROM k GROUP BY ALL""",
)
RULES = [("fouling", "all", "click", 1, 0.0, "signal"), ("fouling", "any", "view", -1, 0.5, "dynamic"), ("fouling", "any", "error", 1, 0.5, "reference"), ("recovery", "all", "click", -1, 0.0, "signal"), ("recovery", "all", "purchase", 1, 0.0, "calibration")]


def trends(s, d):
    weeks = readings(s, d).groupBy(*SERIES, F.floor(F.col("t_s") / 604800).alias("x")).agg(F.avg("value").alias("y"))
    slopes = S.ols(weeks, SERIES).select("sensor_id", F.col("channel").alias("feature"), "slope")
    wanted = slopes.select("sensor_id").distinct().join(s.createDataFrame(RULES, "rule string, part string, feature string, sign int, threshold double, domain string"))
    return wanted.join(slopes, ["sensor_id", "feature"], "left")


register(
    "i04_trend_rules",
    lambda s, d: A.trend_rules(trends(s, d), ["sensor_id"], 2).select("sensor_id", "rule", "triggered", "confidence", "satisfied", "contradicted", "unavailable", "domains"),
    R + f""", k AS (SELECT sensor_id, channel, CAST(floor(t_s / 604800) AS BIGINT) AS x, avg(value) AS y FROM r GROUP BY ALL), c AS (SELECT sensor_id, channel AS feature, covar_pop(x, y) / var_pop(x) AS slope FROM k GROUP BY ALL HAVING count(*) >= 2 AND var_pop(x) > 0),
 w AS (SELECT * FROM (SELECT DISTINCT sensor_id FROM c), (VALUES {', '.join(map(str, RULES))}) t(rule, part, feature, sign, threshold, domain)), h AS (SELECT w.*, sign * slope > threshold AS h FROM w LEFT JOIN c USING (sensor_id, feature)),
 g AS (SELECT sensor_id, rule, count(*) FILTER (h) AS satisfied, count(*) FILTER (NOT h) AS contradicted, count(*) FILTER (h IS NULL) AS unavailable, count(DISTINCT domain) FILTER (h) AS domains, count(*) FILTER (part = 'all' AND h IS NOT TRUE) AS missed, count(*) FILTER (part = 'any') AS n_any, count(*) FILTER (part = 'any' AND h) AS one FROM h GROUP BY ALL),
 f AS (SELECT *, missed = 0 AND (n_any = 0 OR one > 0) AND unavailable = 0 AND domains >= 2 AS triggered, CASE WHEN domains >= 3 THEN 3 ELSE 2 END - CASE WHEN contradicted > 0 THEN 1 ELSE 0 END AS grade FROM g)
 SELECT sensor_id, rule, triggered, CASE WHEN NOT triggered THEN 'insufficient' WHEN grade = 3 THEN 'high' WHEN grade = 2 THEN 'moderate' ELSE 'low' END AS confidence, satisfied, contradicted, unavailable, domains FROM f""",
)


def halves(s, d):
    o = observations(s, d)
    return o.where("o % 2 = 0"), o.where("o % 2 = 1")


MODEL = """WITH ob AS (SELECT l_suppkey AS series, log10(l_quantity / 1000) AS x, l_extendedprice / 1e5 AS y, l_orderkey AS o, l_linenumber AS l FROM lineitem),
 m AS (SELECT series, count(*) AS n, avg(x) AS mx, covar_pop(x, y) / var_pop(x) AS slope, avg(y) - covar_pop(x, y) / var_pop(x) * avg(x) AS e0, var_pop(x) * count(*) AS sxx, sqrt(greatest(0, var_pop(y) - covar_pop(x, y) * covar_pop(x, y) / var_pop(x))) AS rmse, min(x) AS lo, max(x) AS hi FROM ob WHERE o % 2 = 0 GROUP BY series HAVING count(*) >= 3 AND var_pop(x) > 0),
 q AS (SELECT ob.*, m.* EXCLUDE (series) FROM ob LEFT JOIN m USING (series) WHERE o % 2 = 1)"""


def fit_predict(s, d):
    fit, new = halves(s, d)
    out = A.predict_activity(new.select("series", "o", "l", F.col("y").alias("potential")), A.line_models(fit, ["series"]), ["series"])
    shown = [F.when(F.abs(f"log10_activity{n}") < A.DIGITS, F.col(f"log10_activity{n}")).alias(f"lg{n}") for n in ("", "_lower", "_upper")]
    return out.select("series", "o", "l", *shown, F.when(F.abs("log10_activity") < A.DIGITS, F.col("distance")).alias("distance"), "reason")


register(
    "l06_fit_and_predict",
    lambda s, d: rounded(fit_predict(s, d), 4),
    MODEL + """, p AS (SELECT *, (y - e0) / slope AS lg, 1.96 * rmse / abs(slope) AS half FROM q), z AS (SELECT *, greatest(0, lo - lg, lg - hi) AS dist FROM p)
 SELECT series, o, l, CASE WHEN abs(lg) < 307 THEN round(lg, 4) END AS lg, CASE WHEN abs(lg - half) < 307 THEN round(lg - half, 4) END AS lg_lower, CASE WHEN abs(lg + half) < 307 THEN round(lg + half, 4) END AS lg_upper, CASE WHEN abs(lg) < 307 THEN round(dist, 4) END AS distance,
 CASE WHEN slope IS NULL THEN 'model' WHEN abs(lg) >= 307 THEN 'not_finite' WHEN dist > 0 THEN 'extrapolated' END AS reason FROM z""",
)
register(
    "j_predict_potential",
    lambda s, d: rounded(A.predict_potential(halves(s, d)[1].select("series", "o", "l", F.pow(F.lit(10.0), "x").alias("activity")), A.line_models(halves(s, d)[0], ["series"]), ["series"]).drop("activity"), 5),
    MODEL + """ SELECT series, o, l, round(e0 + slope * x, 5) AS potential, round(rmse * sqrt(1 / n + power(x - mx, 2) / sxx), 5) AS potential_se, CASE WHEN slope IS NULL THEN 0.0 ELSE round(greatest(0, lo - x, x - hi), 5) END AS distance, CASE WHEN slope IS NULL THEN 'model' WHEN greatest(0, lo - x, x - hi) > 1e-9 THEN 'extrapolated' END AS reason FROM q""",
)
MAPPING = [("calibration", "slope", "membrane", "sensitivity"), ("calibration", "e0", "reference", "offset"), ("impedance", "tau", "membrane", "relaxation")]


def prior_values(s, d):
    m = A.line_models(observations(s, d), ["series"]).select("series", F.lit("calibration").alias("source"), "slope", "e0")
    results = m.unpivot(["series", "source"], ["slope", "e0"], "path", "value")
    return A.priors(results, s.createDataFrame(MAPPING, "source string, path string, component string, parameter string"), ["series"])


register(
    "i26_prior_lookup",
    lambda s, d: rounded(prior_values(s, d), 5),
    MODEL.split(" q AS")[0].replace("WHERE o % 2 = 0 ", "").rstrip().rstrip(",") + """ SELECT series, 'membrane' AS component, 'sensitivity' AS parameter, round(slope, 5) AS value FROM m UNION ALL SELECT series, 'reference', 'offset', round(e0, 5) FROM m UNION ALL SELECT series, 'membrane', 'relaxation', NULL FROM m""",
)


def part_evidence(s, d):
    li = table(s, d, "lineitem")
    role = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49), "contradicts").when((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 48), "missing").otherwise("supports")
    return li.select(F.col("l_partkey").alias("hypothesis"), role.alias("role"), F.col("l_suppkey").alias("replicate"))


register(
    "i26_component_levels",
    lambda s, d: A.component_levels(part_evidence(s, d), table(s, d, "part").select(F.col("p_partkey").alias("hypothesis"), (F.col("p_size") % 5).alias("least_replicates"))),
    """WITH e AS (SELECT l_partkey AS hypothesis, CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 'contradicts' WHEN l_returnflag = 'A' AND l_quantity > 48 THEN 'missing' ELSE 'supports' END AS role, l_suppkey AS k FROM lineitem),
 g AS (SELECT hypothesis, count(*) FILTER (role = 'supports') AS s, count(*) FILTER (role = 'contradicts') AS c, count(*) FILTER (role = 'missing') AS m, count(DISTINCT k) FILTER (role = 'supports') AS r FROM e GROUP BY hypothesis),
 d AS (SELECT p_partkey AS hypothesis, p_size % 5 AS least, coalesce(s, 0) AS s, coalesce(c, 0) AS c, coalesce(m, 0) AS m, coalesce(r, 0) AS r FROM part LEFT JOIN g ON p_partkey = hypothesis)
 SELECT hypothesis, s AS supporting, c AS contradicting, m AS missing, r AS replicates, CASE WHEN c > 0 THEN 'contradictory' WHEN m > 0 OR r < least THEN 'weak' WHEN s = 0 THEN 'insufficient' ELSE 'moderate' END AS level FROM d""",
)


def supplier_links(s, d):
    """Suppliers of one nation that both had a large line of one part depend on each other."""
    li = table(s, d, "lineitem").where("l_quantity >= 48").select("l_partkey", F.col("l_suppkey").alias("k")).distinct()
    li = li.join(table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("site")), "k")
    return li.toDF("a", "l_partkey", "site").join(li.toDF("b", "l_partkey", "site"), ["l_partkey", "site"]).where("a < b").select("a", "b").distinct()


register(
    "f06_independent_subset",
    lambda s, d: G.independent_subset(table(s, d, "supplier").select(F.col("s_nationkey").alias("site"), F.col("s_suppkey").alias("id")), supplier_links(s, d), ["site"]),
    """WITH RECURSIVE li AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS k, s_nationkey AS site FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 48), dep AS (SELECT DISTINCT x.k AS a, y.k AS b FROM li x JOIN li y ON x.p = y.p AND x.site = y.site AND x.k <> y.k),
 ag AS (SELECT s_suppkey AS id, s_nationkey AS site, coalesce(list(b) FILTER (b IS NOT NULL), []) AS against FROM supplier LEFT JOIN dep ON a = s_suppkey GROUP BY ALL),
 sets AS (SELECT site, [id] AS ids, id AS last FROM ag UNION ALL SELECT sets.site, list_append(ids, id), id FROM sets JOIN ag ON ag.site = sets.site AND id > last AND NOT list_has_any(ids, against)),
 best AS (SELECT site, arg_min(ids, (-len(ids), ids)) AS ids FROM sets GROUP BY site) SELECT site, unnest(ids) AS id, true AS exact FROM best""",
)


def conflicts(s, d):
    """Order lines as readings: a line's part and ship day, with its quantity."""
    rows = table(s, d, "lineitem").select(F.col("l_suppkey").alias("sensor_id"), F.col("l_shipdate").alias("t_s"), F.floor(F.col("l_quantity") / 10).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"))
    kept, bad = A.part_conflicts(rows, ["sensor_id"])
    return kept.select("sensor_id", "row_idx", F.lit("kept").alias("fate")).union(bad.select("sensor_id", "row_idx", F.lit("quarantined")))


register(
    "h08_late_and_repeated_rows",
    conflicts,
    """WITH x AS (SELECT l_suppkey AS sensor_id, l_shipdate AS t, floor(l_quantity / 10) AS v, l_orderkey * 10 + l_linenumber AS row_idx FROM lineitem), g AS (SELECT sensor_id, t, count(DISTINCT v) AS n FROM x GROUP BY ALL)
 SELECT sensor_id, min(row_idx) AS row_idx, 'kept' AS fate FROM x JOIN g USING (sensor_id, t) WHERE n = 1 GROUP BY sensor_id, t, v UNION ALL SELECT sensor_id, row_idx, 'quarantined' FROM x JOIN g USING (sensor_id, t) WHERE n > 1""",
)


def manifest(s, d):
    """Orders name the parts whose files they need; lines are the readings of a part's file."""
    li = table(s, d, "lineitem")
    wanted = li.select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("file"))
    have = li.where("l_linenumber = 1").select(F.col("l_partkey").alias("file"), "l_quantity")
    run, gone = ingest.run_manifest(wanted.distinct(), have)
    return run.groupBy("record").agg(F.count("*").alias("rows"), F.lit("").alias("missing")).union(gone.select("record", F.lit(0), F.array_join("missing", ",")))


register(
    "a09_manifest_run",
    manifest,
    """WITH w AS (SELECT DISTINCT l_orderkey AS record, l_partkey AS file FROM lineitem), h AS (SELECT l_partkey AS file, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
 j AS (SELECT record, file, n FROM w LEFT JOIN h USING (file)), g AS (SELECT record, count(*) FILTER (n IS NULL) AS gone, sum(n) AS n, coalesce(string_agg(CAST(file AS VARCHAR), ',' ORDER BY file) FILTER (n IS NULL), '') AS missing FROM j GROUP BY record)
 SELECT record, CASE WHEN gone > 0 THEN 0 ELSE CAST(n AS BIGINT) END AS rows, missing FROM g""",
)


def documents_back(s, d):
    """Suppliers as versioned JSON documents, written, read back and sorted out."""
    path = fresh_path(s, "json")
    sup = table(s, d, "supplier")
    body = F.to_json(F.struct(F.when(F.col("s_suppkey") % 7 == 0, "other").otherwise("sensor").alias("kind"), (F.col("s_suppkey") % 4).cast("int").alias("schema_version"), F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).alias("payload")))
    sup.select(F.when(F.col("s_suppkey") % 11 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("value")).write.text(path)
    good, bad = ingest.read_documents(s, path, "sensor", "id bigint, name string", [1, 2])
    return good.groupBy(F.lit("read").alias("outcome")).agg(F.count("*").alias("rows"), F.sum("id").alias("ids")).union(bad.groupBy("reason").agg(F.count("*"), F.lit(None).cast("long")))


register(
    "a10_versioned_documents",
    documents_back,
    """WITH x AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 = 0 THEN 'malformed' WHEN s_suppkey % 7 = 0 THEN 'kind' WHEN s_suppkey % 4 NOT IN (1, 2) THEN 'version' ELSE 'read' END AS outcome FROM supplier)
 SELECT outcome, count(*) AS rows, CAST(CASE WHEN outcome = 'read' THEN sum(k) END AS BIGINT) AS ids FROM x GROUP BY outcome""",
)


def sinks_back(s, d):
    """Nations' customer counts as a table partitioned by region, written as CSV and read back."""
    path = fresh_path(s, "sink")
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ingest.write_results(c.groupBy("n_regionkey", "n_name").agg(F.count("*").alias("customers")), path, ["n_regionkey"], "csv")
    return s.read.option("header", True).schema("n_name string, customers bigint, n_regionkey bigint").csv(path)


register(
    "a11_result_sinks",
    sinks_back,
    "SELECT n_name, count(*) AS customers, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
)


def truth_back(s, d):
    """Readings as a reference CSV with other header names, read back."""
    path = fresh_path(s, "truth")
    readings(s, d).select(F.col("row_idx").alias("Sample"), F.when(F.col("row_idx") % 9 == 0, "n/a").otherwise(F.format_string("%.4f", "value")).alias("Reference Value")).write.option("header", True).csv(path)
    return ingest.read_truth(s, path, {"row": ["sample"], "truth": ["reference value", "value"]})


register(
    "a13_truth_read",
    lambda s, d: rounded(truth_back(s, d), 4),
    "SELECT CAST(event_id AS DOUBLE) AS row, CASE WHEN event_id % 9 <> 0 THEN round(value, 4) END AS truth FROM events",
)
