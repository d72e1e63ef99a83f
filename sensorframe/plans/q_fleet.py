"""Registered fleet, lineage and evidence queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators import fleet as H
from sensorframe.operators import lineage as G
from sensorframe.operators import series as S
from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import R
from sensorframe.sources.storage import dealt, written
from sensorframe.sources.views import readings, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
FEATURES = ["mean", "sd", "rate", "peak"]


def features(s, d):
    """Long feature table: record (sensor), context, feature, value."""
    r = readings(s, d)
    w = r.groupBy(F.col("sensor_id").alias("record")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (86400 * F.count("*") / (F.max("t_s") - F.min("t_s"))).alias("rate"), F.max("value").alias("peak"))
    w = w.withColumn("context", F.when(F.col("record") % 3 == 0, "blood").when(F.col("record") % 3 == 1, "water").otherwise("soil"))
    return w.unpivot(["record", "context"], FEATURES, "feature", "value")


FT = R + """, w AS (SELECT sensor_id AS record, CASE sensor_id % 3 WHEN 0 THEN 'blood' WHEN 1 THEN 'water' ELSE 'soil' END AS context, avg(value) AS mean, stddev_samp(value) AS sd, 86400 * count(*) / (max(t_s) - min(t_s)) AS rate, max(value) AS peak FROM r GROUP BY sensor_id),
 f AS (SELECT record, context, feature, value FROM w UNPIVOT (value FOR feature IN (mean, sd, rate, peak)))"""
CF = ["context", "feature"]


def base(s, d):
    return H.baseline(features(s, d).where("record % 2 = 0"), CF)


def scored(s, d):
    f = written(features(s, d), "features")  # read for the baseline, its spread, shares and current values
    return H.deviations(f.where("record % 2 = 1"), f.where("record % 2 = 0"), CF)


BS = FT + """, b0 AS (SELECT context, feature, count(value) AS records, avg(value) AS b_mean, stddev_samp(value) AS b_sd, quantile_cont(value, 0.25) AS b_q1, quantile_cont(value, 0.5) AS b_median, quantile_cont(value, 0.75) AS b_q3, min(value) AS b_min, max(value) AS b_max, list_sort(list(value)) AS empirical FROM f WHERE record % 2 = 0 GROUP BY ALL),
 bm AS (SELECT f.context, f.feature, quantile_cont(abs(value - b_median), 0.5) AS b_mad FROM f JOIN b0 USING (context, feature) WHERE record % 2 = 0 GROUP BY ALL), b AS (SELECT * FROM b0 JOIN bm USING (context, feature)),
 dv AS (SELECT f.record, b.*, f.value, value - b_median AS absolute, CASE WHEN b_median <> 0 THEN (value - b_median) / b_median END AS relative, CASE WHEN value > 0 AND b_median > 0 THEN ln(value / b_median) END AS log_ratio,
  CASE WHEN records >= 3 AND b_sd > 0 THEN (value - b_mean) / b_sd END AS z, CASE WHEN records >= 3 AND b_mad > 0 THEN (value - b_median) / (1.4826 * b_mad) END AS robust_z, len(list_filter(empirical, lambda x: x <= value)) / len(empirical) AS share, CASE WHEN b_max > b_min THEN (value - b_min) / (b_max - b_min) END AS position FROM f JOIN b USING (context, feature) WHERE record % 2 = 1)"""
register("d32_features_long", lambda s, d: rounded(features(s, d), 5), FT + " SELECT record, context, feature, round(value, 5) AS value FROM f")
register("a03_wide_and_long", lambda s, d: rounded(features(s, d).groupBy("record").pivot("feature", FEATURES).agg(F.first("value")), 5), FT + " SELECT record, round(mean, 5) AS mean, round(sd, 5) AS sd, round(rate, 5) AS rate, round(peak, 5) AS peak FROM w")
register(
    "d29_baseline",
    lambda s, d: rounded(base(s, d), 5),
    BS + " SELECT context, feature, records, round(b_mean, 5) AS b_mean, round(b_sd, 5) AS b_sd, round(b_min, 5) AS b_min, round(b_max, 5) AS b_max, round(b_mad, 5) AS b_mad, round(b_q1, 5) AS b_q1, round(b_median, 5) AS b_median, round(b_q3, 5) AS b_q3 FROM b",
)
register(
    "d31_grouped_feature_means",
    lambda s, d: rounded(features(s, d).groupBy("context", "feature").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).withColumn("contexts", F.count("*").over(W.partitionBy("feature"))), 5),
    FT + " SELECT context, feature, round(avg(value), 5) AS mean, count(*) AS n, count(*) OVER (PARTITION BY feature) AS contexts FROM f GROUP BY context, feature",
)
register(
    "d30_context_conflicts",
    lambda s, d: readings(s, d).groupBy("sensor_id").agg(F.array_sort(F.collect_set(F.when(F.col("channel") != "view", F.col("channel")))).alias("v")).select("sensor_id", F.when(F.size("v") == 1, F.col("v")[0]).alias("value"), F.size("v").cast("bigint").alias("members"), F.array_join("v", ",").alias("conflict")),
    R + ", v AS (SELECT sensor_id, list_sort(list(DISTINCT channel)) AS v FROM r WHERE channel <> 'view' GROUP BY sensor_id) SELECT sensor_id, CASE WHEN len(v) = 1 THEN v[1] END AS value, len(v) AS members, array_to_string(v, ',') AS conflict FROM v",
)
register(
    "i01_deviation_scores",
    lambda s, d: rounded(scored(s, d).select("record", "feature", "absolute", "relative", "log_ratio", "z", "robust_z", "share", "position"), 5),
    BS + " SELECT record, feature, round(absolute, 5) AS absolute, round(relative, 5) AS relative, round(log_ratio, 5) AS log_ratio, round(z, 5) AS z, round(robust_z, 5) AS robust_z, round(share, 5) AS share, round(position, 5) AS position FROM dv",
)
register(
    "c20_current_to_baseline",
    lambda s, d: rounded(scored(s, d).select("record", "context", "feature", "value", "b_median"), 5),
    BS + " SELECT record, context, feature, round(value, 5) AS value, round(b_median, 5) AS b_median FROM dv",
)


def conditions(s, d):
    """Three rules over the scored features, as condition rows."""
    z = F.col("robust_z")
    c = F.array(
        *(F.struct(F.lit(rule).alias("rule"), F.lit(part).alias("part"), h.alias("holds")) for rule, part, h in (
            ("shift", "any", F.when(F.col("feature").isin("mean", "sd"), z > 1)), ("shift", "none", F.when(F.col("feature") == "rate", z > 2)), ("steady", "all", F.abs(z) < 3))
        )
    )
    rows = scored(s, d).select("record", F.col("feature").alias("domain"), F.explode(c).alias("c")).select("record", "domain", "c.*")
    return rows.where("NOT (rule = 'shift' AND part = 'any' AND domain NOT IN ('mean', 'sd')) AND NOT (part = 'none' AND domain <> 'rate')")


RULE = BS + """, c AS (SELECT record, feature AS domain, 'shift' AS rule, 'any' AS part, robust_z > 1 AS holds FROM dv WHERE feature IN ('mean', 'sd') UNION ALL SELECT record, feature, 'shift', 'none', robust_z > 2 FROM dv WHERE feature = 'rate' UNION ALL SELECT record, feature, 'steady', 'all', abs(robust_z) < 3 FROM dv),
 g AS (SELECT record, rule, count(*) FILTER (part = 'all' AND NOT holds) AS a_no, count(*) FILTER (part = 'all' AND holds IS NULL) AS a_un, count(*) FILTER (part = 'any' AND holds) AS y_yes, count(*) FILTER (part = 'any' AND holds IS NULL) AS y_un, count(*) FILTER (part = 'any') AS y_n, count(*) FILTER (part = 'none' AND holds) AS n_yes, count(*) FILTER (part = 'none' AND holds IS NULL) AS n_un, count(DISTINCT domain) FILTER (holds) AS domains FROM c GROUP BY ALL)"""
register(
    "i03_rules",
    lambda s, d: H.rules(conditions(s, d), "record", "rule"),
    RULE + " SELECT record, rule, CASE WHEN a_no > 0 OR n_yes > 0 OR (y_n > 0 AND y_yes = 0 AND y_un = 0) THEN 'false' WHEN a_un = 0 AND n_un = 0 AND (y_n = 0 OR y_yes > 0) THEN 'true' ELSE 'unavailable' END AS outcome, domains FROM g",
)
register(
    "i05_status",
    lambda s, d: scored(s, d).groupBy("record").agg(F.max(F.when((F.abs("robust_z") >= 3) | (F.abs("relative") >= 0.5), 1).otherwise(0)).alias("w")).select("record", F.when(F.col("w") == 1, "watch").otherwise("fine").alias("status")),
    BS + " SELECT record, CASE WHEN max(CASE WHEN abs(robust_z) >= 3 OR abs(relative) >= 0.5 THEN 1 ELSE 0 END) = 1 THEN 'watch' ELSE 'fine' END AS status FROM dv GROUP BY record",
)
register(
    "i07_severity",
    lambda s, d: rounded(scored(s, d).withColumn("level", H.severity(F.abs("robust_z"), 1.0, 2.0, 3.0)).groupBy("record").agg(F.max("level").alias("worst"), F.max_by("feature", F.struct("level", "feature")).alias("by_feature"))),
    BS + ", l AS (SELECT *, CASE WHEN abs(robust_z) >= 3 THEN 3 WHEN abs(robust_z) >= 2 THEN 2 WHEN abs(robust_z) >= 1 THEN 1 WHEN robust_z IS NOT NULL THEN 0 END AS level FROM dv) SELECT record, CAST(max(level) AS BIGINT) AS worst, arg_max(feature, (level, feature)) AS by_feature FROM l GROUP BY record",
)
register(
    "i10_feature_trend",
    lambda s, d: rounded(S.ols(_weekly(s, d), ["sensor_id"]).select("sensor_id", "n", "slope", "r")),
    R + """, k AS (SELECT sensor_id, CAST(floor(t_s / 604800) AS BIGINT) AS x, avg(value) AS y FROM r GROUP BY ALL), g AS (SELECT sensor_id, avg(x) AS mx, avg(y) AS my FROM k GROUP BY ALL),
 c AS (SELECT k.sensor_id, count(*) AS n, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy FROM k JOIN g USING (sensor_id) GROUP BY k.sensor_id)
 SELECT sensor_id, n, round(sxy / sxx, 6) AS slope, round(CASE WHEN syy > 0 THEN sxy / sqrt(sxx * syy) ELSE 0 END, 6) AS r FROM c WHERE n >= 2 AND sxx > 0""",
)


def _weekly(s, d):
    return readings(s, d).groupBy("sensor_id", F.floor(F.col("t_s") / 604800).alias("x")).agg(F.avg("value").alias("y"))


register(
    "d37_replicate_change",
    lambda s, d: rounded(_weekly(s, d).groupBy("sensor_id").agg(F.stddev_pop("y").alias("sd"), F.min_by("y", "x").alias("first"), F.max_by("y", "x").alias("last")).select("sensor_id", "sd", (F.col("last") - F.col("first")).alias("absolute"), ((F.col("last") - F.col("first")) / F.col("first")).alias("relative"), F.log(F.col("last") / F.col("first")).alias("log_change"))),
    R + ", k AS (SELECT sensor_id, floor(t_s / 604800) AS x, avg(value) AS y FROM r GROUP BY ALL), c AS (SELECT sensor_id, stddev_pop(y) AS sd, arg_min(y, x) AS a, arg_max(y, x) AS b FROM k GROUP BY sensor_id) SELECT sensor_id, round(sd, 6) AS sd, round(b - a, 6) AS absolute, round((b - a) / a, 6) AS relative, round(ln(b / a), 6) AS log_change FROM c",
)


def scales(s, d):
    """A timescale per sensor and channel: the median interval."""
    r = S.intervals(readings(s, d), ["sensor_id", "channel"])
    return r.groupBy(F.col("sensor_id").alias("record"), "channel").agg(F.percentile("dt", F.lit(0.5)).alias("tau"), (F.stddev_samp("dt") / F.sqrt(F.count("dt"))).alias("se")).where("tau IS NOT NULL AND se IS NOT NULL")


def pairs(s, d):
    a = scales(s, d).toDF("record", "ca", "a", "se_a")
    b = scales(s, d).toDF("record", "cb", "b", "se_b")
    p = a.join(b, "record").where("ca < cb")
    ratio = F.greatest(F.col("a") / F.col("b"), F.col("b") / F.col("a"))
    p = p.withColumns({"ratio": ratio, "log_diff": F.abs(F.log10(F.col("a") / F.col("b"))), "symmetric": 2 * F.abs(F.col("a") - F.col("b")) / (F.col("a") + F.col("b")), "overlap": F.abs(F.col("a") - F.col("b")) <= 1.96 * (F.col("se_a") + F.col("se_b"))})
    return p.withColumn("level", F.when(F.col("ratio") <= 1.25, "strong").when(F.col("ratio") <= 2, "moderate").when(F.col("ratio") <= 5, "weak").otherwise("contradictory"))


TAU = R + """, i AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS dt FROM r), t AS (SELECT sensor_id AS record, channel, quantile_cont(dt, 0.5) AS tau, stddev_samp(dt) / sqrt(count(dt)) AS se FROM i GROUP BY ALL HAVING quantile_cont(dt, 0.5) IS NOT NULL AND stddev_samp(dt) IS NOT NULL),
 p AS (SELECT a.record, a.channel AS ca, b.channel AS cb, a.tau AS a, b.tau AS b, a.se AS sa, b.se AS sb, greatest(a.tau / b.tau, b.tau / a.tau) AS ratio FROM t a JOIN t b ON a.record = b.record AND a.channel < b.channel)"""
LEVEL = "CASE WHEN ratio <= 1.25 THEN 'strong' WHEN ratio <= 2 THEN 'moderate' WHEN ratio <= 5 THEN 'weak' ELSE 'contradictory' END"
register("c18_timescale_pairs", lambda s, d: rounded(pairs(s, d).select("record", "ca", "cb", "a", "b"), 4), TAU + " SELECT record, ca, cb, round(a, 4) AS a, round(b, 4) AS b FROM p")
register(
    "i11_timescale_compatibility",
    lambda s, d: rounded(pairs(s, d).select("record", "ca", "cb", "ratio", "log_diff", "symmetric", "overlap", "level"), 5),
    TAU + f" SELECT record, ca, cb, round(ratio, 5) AS ratio, round(abs(log10(a / b)), 5) AS log_diff, round(2 * abs(a - b) / (a + b), 5) AS symmetric, abs(a - b) <= 1.96 * (sa + sb) AS overlap, {LEVEL} AS level FROM p",
)
register(
    "i12_log_distance_gate",
    lambda s, d: rounded(pairs(s, d).withColumn("distance", F.abs(F.log("a") - F.log("b")) + F.sqrt((F.col("se_a") / F.col("a")) ** 2 + (F.col("se_b") / F.col("b")) ** 2)).select("record", "ca", "cb", "distance", (F.col("distance") <= 0.8).alias("passes")), 5),
    TAU + ", q AS (SELECT *, abs(ln(a) - ln(b)) + sqrt(power(sa / a, 2) + power(sb / b, 2)) AS distance FROM p) SELECT record, ca, cb, round(distance, 5) AS distance, distance <= 0.8 AS passes FROM q",
)
register(
    "i13_amplitude_gate",
    lambda s, d: rounded(pairs(s, d).select("record", "ca", "cb", (F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(1.0))).alias("share"), (F.abs(F.col("a") - F.col("b")) / F.greatest(F.abs("a"), F.abs("b"), F.lit(1.0)) <= 0.3).alias("passes")), 5),
    TAU + " SELECT record, ca, cb, round(abs(a - b) / greatest(abs(a), abs(b), 1.0), 5) AS share, abs(a - b) / greatest(abs(a), abs(b), 1.0) <= 0.3 AS passes FROM p",
)
register("d38_contradictions", lambda s, d: pairs(s, d).groupBy("record").agg(F.count("*").alias("pairs"), F.count_if(F.col("level") == "contradictory").alias("contradictory"), F.count_if(F.col("level") == "strong").alias("strong")), TAU + f" SELECT record, count(*) AS pairs, count(*) FILTER ({LEVEL} = 'contradictory') AS contradictory, count(*) FILTER ({LEVEL} = 'strong') AS strong FROM p GROUP BY record")
register(
    "i15_promotion",
    lambda s, d: pairs(s, d).groupBy("record").agg(F.count_if(F.col("level") == "contradictory").alias("no"), F.bool_and(F.col("level").isin("strong", "moderate")).alias("all_ok"), F.bool_or(F.col("level") == "strong").alias("some")).select("record", F.when(F.col("no") > 0, "contradicted").when(F.col("all_ok") & F.col("some"), "validated_for_domain").when(F.col("some"), "experimentally_supported").otherwise("hypothesized").alias("level")),
    TAU + f", l AS (SELECT record, {LEVEL} AS level FROM p) SELECT record, CASE WHEN count(*) FILTER (level = 'contradictory') > 0 THEN 'contradicted' WHEN bool_and(level IN ('strong', 'moderate')) AND bool_or(level = 'strong') THEN 'validated_for_domain' WHEN bool_or(level = 'strong') THEN 'experimentally_supported' ELSE 'hypothesized' END AS level FROM l GROUP BY record",
)
register(
    "c16_mixed_state_policy",
    lambda s, d: rounded(pairs(s, d).select("record", "ca", "cb", F.least(F.col("a") / 1e6, F.col("b") / 1e6, F.lit(1.0)).alias("fraction"), F.when(F.least(F.col("a"), F.col("b")) / 1e6 >= 0.5, "accept").when(F.least(F.col("a"), F.col("b")) / 1e6 > 0, "partial").otherwise("reject").alias("policy")), 5),
    TAU + " SELECT record, ca, cb, round(least(a / 1e6, b / 1e6, 1.0), 5) AS fraction, CASE WHEN least(a, b) / 1e6 >= 0.5 THEN 'accept' WHEN least(a, b) / 1e6 > 0 THEN 'partial' ELSE 'reject' END AS policy FROM p",
)


def edges(s, d):
    """order -> customer -> nation -> region and supplier -> nation, as text ids."""

    def e(t, a, pa, b, pb):
        return table(s, d, t).select(F.concat(F.lit(pa), F.col(a)).alias("child"), F.concat(F.lit(pb), F.col(b)).alias("parent"))

    parts = [e("orders", "o_orderkey", "o", "o_custkey", "c"), e("customer", "c_custkey", "c", "c_nationkey", "n"), e("supplier", "s_suppkey", "s", "s_nationkey", "n"), e("nation", "n_nationkey", "n", "n_regionkey", "r")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ED = "e AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"
CL = "WITH RECURSIVE " + ED + ", a AS (SELECT child AS id, parent AS ancestor, 1 AS depth FROM (SELECT DISTINCT * FROM e) UNION ALL SELECT a.id, e.parent, depth + 1 FROM a JOIN (SELECT DISTINCT * FROM e) e ON a.ancestor = e.child), cl AS (SELECT id, ancestor, min(depth) AS depth FROM a GROUP BY ALL)"
register("f01_ancestors", lambda s, d: rounded(G.ancestors(edges(s, d))), CL + " SELECT id, ancestor, CAST(depth AS BIGINT) AS depth FROM cl")
register(
    "f02_catalog_integrity",
    lambda s, d: edges(s, d).groupBy("child").agg(F.count("*").alias("rows"), F.count_distinct("parent").alias("parents")).select(F.count_if(F.col("rows") > 1).alias("duplicate_keys"), F.count_if(F.col("rows") > F.col("parents")).alias("repeated_dependencies"), F.count("*").alias("keys")),
    "WITH " + ED + ", g AS (SELECT child, count(*) AS rows, count(DISTINCT parent) AS parents FROM e GROUP BY child) SELECT count(*) FILTER (rows > 1) AS duplicate_keys, count(*) FILTER (rows > parents) AS repeated_dependencies, count(*) AS keys FROM g",
)
register(
    "f03_scope_union",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("v")).select("l_orderkey", F.when(F.size("v") == 0, "unknown").when(F.size("v") == 1, "single").otherwise("aggregate").alias("scope"), F.size("v").cast("bigint").alias("members")),
    "SELECT l_orderkey, CASE count(DISTINCT l_suppkey) WHEN 0 THEN 'unknown' WHEN 1 THEN 'single' ELSE 'aggregate' END AS scope, count(DISTINCT l_suppkey) AS members FROM lineitem GROUP BY l_orderkey",
)


def supplier_pairs(s, d):
    """Pairs of suppliers that meet in an order."""
    li = table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey")).alias("x"), F.col("l_suppkey").alias("k")).distinct()
    return li.toDF("l_orderkey", "a", "ka").join(li.toDF("l_orderkey", "b", "kb"), "l_orderkey").where("ka <= kb").select("a", "b").distinct()


PR = ", li AS (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem), sp AS (SELECT DISTINCT 's' || x.k AS a, 's' || y.k AS b FROM li x JOIN li y ON x.l_orderkey = y.l_orderkey AND x.k <= y.k)"


def families(s, d):
    n = table(s, d, "nation")
    return table(s, d, "supplier").join(n, F.col("s_nationkey") == n["n_nationkey"]).select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.when(F.col("s_suppkey") % 9 != 0, F.col("n_regionkey")).alias("family"))


register(
    "f04_independence",
    lambda s, d: rounded(G.independence(supplier_pairs(s, d), G.ancestors(edges(s, d)).where("id LIKE 's%'"), families(s, d))),
    "WITH " + ED + PR + """, f AS (SELECT 's' || s_suppkey AS id, s_nationkey AS n, n_regionkey AS rg, CASE WHEN s_suppkey % 9 <> 0 THEN n_regionkey END AS family FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT least(a, b) AS a, greatest(a, b) AS b, CASE WHEN a = b THEN 'same_source' WHEN x.family IS NULL OR y.family IS NULL THEN 'unknown' WHEN x.rg = y.rg OR x.family = y.family THEN 'partial' ELSE 'independent' END AS class, CAST(CASE WHEN x.n = y.n THEN 2 WHEN x.rg = y.rg THEN 1 ELSE 0 END AS BIGINT) AS shared FROM sp JOIN f x ON x.id = a JOIN f y ON y.id = b""",
)
register(
    "f05_canonical_pair",
    lambda s, d: supplier_pairs(s, d).select(F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b")).alias("pair")).distinct(),
    "WITH x AS (SELECT 1)" + PR + " SELECT DISTINCT least(a, b) || '|' || greatest(a, b) AS pair FROM sp",
)
register(
    "f07_leakage_guard",
    lambda s, d: table(s, d, "orders").where("o_orderkey % 5 = 0").join(table(s, d, "orders").where("o_orderkey % 5 <> 0").select("o_custkey"), "o_custkey", "left_anti").select("o_orderkey", "o_custkey"),
    "SELECT o_orderkey, o_custkey FROM orders o WHERE o_orderkey % 5 = 0 AND NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderkey % 5 <> 0 AND t.o_custkey = o.o_custkey)",
)
register(
    "f08_condition_coverage",
    lambda s, d: readings(s, d).groupBy("sensor_id").agg(F.count_distinct("channel").alias("met")).select("sensor_id", "met", (F.col("met") == 5).alias("covered")),
    R + " SELECT sensor_id, count(DISTINCT channel) AS met, count(DISTINCT channel) = 5 AS covered FROM r GROUP BY sensor_id",
)
register(
    "f09_consumed_union",
    lambda s, d: table(s, d, "lineitem").select(F.col("l_partkey").alias("id")).union(table(s, d, "part").select("p_partkey")).distinct(),
    "SELECT l_partkey AS id FROM lineitem UNION SELECT p_partkey FROM part",
)
def _unmatched(s, d):
    """Ids that stand on one side only: orders keep their rows, lines count once."""
    o, li = dealt(table(s, d, "orders").select(F.col("o_orderkey").alias("id")), ["id"]), dealt(table(s, d, "lineitem").select(F.col("l_orderkey").alias("id")), ["id"])
    alone = lambda side, a, b: a.join(b, "id", "left_anti").select(F.lit(side).alias("side"), "id")
    return alone("orders", o, li).union(alone("lineitem", li, o).distinct())


register(
    "f10_unmatched",
    lambda s, d: _unmatched(s, d),
    "SELECT 'orders' AS side, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT 'lineitem', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
)
register(
    "c15_temporal_join",
    lambda s, d: _temporal(s, d),
    R + """, w AS (SELECT sensor_id, row_idx AS w, t_s AS lo, t_s + 21600 AS hi FROM r WHERE channel = 'error'), p AS (SELECT sensor_id, row_idx AS p, t_s, CASE WHEN row_idx % 10 = 0 THEN NULL ELSE t_s END AS t FROM r WHERE channel = 'click')
 SELECT p.sensor_id, p, w, CASE WHEN t IS NULL THEN 'indeterminate' ELSE 'joined' END AS outcome FROM p JOIN w ON p.sensor_id = w.sensor_id AND p.t_s BETWEEN lo AND hi""",
)


def _temporal(s, d):
    """Points in closed windows, met in buckets; a point without a known time is indeterminate."""
    from sensorframe.operators.align import within

    r = readings(s, d)
    w = r.where("channel = 'error'").select("sensor_id", F.col("row_idx").alias("w"), "t_s")
    p = r.where("channel = 'click'").select("sensor_id", F.col("row_idx").cast("double").alias("value"), "t_s")
    m = within(w, p, ["sensor_id"], 0.0, 21600.0)
    return m.select("sensor_id", F.col("v").cast("bigint").alias("p"), "w", F.when(F.col("v") % 10 == 0, "indeterminate").otherwise("joined").alias("outcome"))


register(
    "i16_equilibrium",
    lambda s, d: S.ols(_weekly(s, d), ["sensor_id"]).select("sensor_id", F.when(F.col("n") < 3, "indeterminate").when(F.abs("slope") > 8, "disturbed").when(F.abs("slope") > 4, "transitional").when(F.abs("slope") > 1, "quasi_equilibrium").otherwise("equilibrium").alias("class")),
    R + """, k AS (SELECT sensor_id, CAST(floor(t_s / 604800) AS BIGINT) AS x, avg(value) AS y FROM r GROUP BY ALL), g AS (SELECT sensor_id, avg(x) AS mx, avg(y) AS my FROM k GROUP BY ALL), c AS (SELECT k.sensor_id, count(*) AS n, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) AS sxy FROM k JOIN g USING (sensor_id) GROUP BY k.sensor_id)
 SELECT sensor_id, CASE WHEN n < 3 THEN 'indeterminate' WHEN abs(sxy / sxx) > 8 THEN 'disturbed' WHEN abs(sxy / sxx) > 4 THEN 'transitional' WHEN abs(sxy / sxx) > 1 THEN 'quasi_equilibrium' ELSE 'equilibrium' END AS class FROM c WHERE n >= 2 AND sxx > 0""",
)
register(
    "i18_signal_warnings",
    lambda s, d: S.sampling_summary(readings(s, d), ["sensor_id", "channel"]).select("sensor_id", "channel", F.array_join(F.array_compact(F.array(F.when(F.col("dt_cv") > 0.5, "irregular"), F.when(F.col("missing_share") > 0.2, "missing"), F.when(F.col("n") < 16, "short"), F.when(F.col("dt_max") > 5 * 86400, "gap"))), ",").alias("warnings")),
    R + ", i AS (SELECT *, t_s - lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY t_s, row_idx) AS dt FROM r) SELECT sensor_id, channel, array_to_string(list_filter([CASE WHEN stddev_samp(dt) / avg(dt) > 0.5 THEN 'irregular' END, CASE WHEN count(*) < 16 THEN 'short' END, CASE WHEN max(dt) > 432000 THEN 'gap' END], lambda w: w IS NOT NULL), ',') AS warnings FROM i GROUP BY sensor_id, channel",
)
register(
    "i24_domain_status",
    lambda s, d: rounded(readings(s, d).select("sensor_id", "row_idx", F.when(F.col("value").isNull(), "missing").when(F.col("value").between(5, 100), "inside").when(F.greatest(5 - F.col("value"), F.col("value") - 100) < 2, "near").otherwise("outside").alias("status"), F.greatest(5 - F.col("value"), F.col("value") - 100, F.lit(0.0)).alias("distance"))),
    R + " SELECT sensor_id, row_idx, CASE WHEN value IS NULL THEN 'missing' WHEN value BETWEEN 5 AND 100 THEN 'inside' WHEN greatest(5 - value, value - 100) < 2 THEN 'near' ELSE 'outside' END AS status, round(greatest(5 - value, value - 100, 0.0), 6) AS distance FROM r",
)
