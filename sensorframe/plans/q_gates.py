"""Registered queries of evidence: joins in time, lineage status, condition coverage, promotion, and rules with all operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators import assess as A
from sensorframe.operators import evidence as V
from sensorframe.operators import lineage as G
from sensorframe.operators import series as S
from sensorframe.plans.common import Registry, rounded
from sensorframe.sources.storage import written
from sensorframe.sources.views import SERIES, in_order, readings, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
R = "WITH r AS (SELECT user_id AS sensor_id, event_type AS channel, event_id AS row_idx, epoch_us(ts) / 1e6 AS t_s, value FROM events)"


def supports(s, d):
    """Readings as supports in time: clicks are points, views windows as long as their value says in minutes times four, errors events of their day."""
    r = readings(s, d)
    kind = F.when(F.col("channel") == "click", "point").when(F.col("channel") == "view", "window").when(F.col("channel") == "error", "event")
    share = lambda n: F.when(F.col("row_idx") % n != 0, F.when(F.col("row_idx") % (n + 1) == 0, 0.5).otherwise(1.0))
    return r.where("channel IN ('click', 'view', 'error')").select(
        F.col("row_idx").alias("id"), F.col("sensor_id").alias("scope"), F.when(F.col("row_idx") % 11 != 0, F.col("row_idx") % 2).alias("clock"), kind.alias("kind"),
        F.when(kind != "event", F.col("t_s")).alias("start_s"), F.when(kind == "window", F.col("t_s") + 240 * F.col("value")).alias("end_s"),
        F.when(kind == "event", F.when(F.col("row_idx") % 5 == 0, "").otherwise(F.floor(F.col("t_s") / 86400).cast("string"))).alias("event_id"),
        share(7).alias("classified"), share(4).alias("equilibrium"), share(3).alias("steady"),
    )


SUP = R + """, s AS (SELECT row_idx AS id, sensor_id AS scope, CASE WHEN row_idx % 11 <> 0 THEN row_idx % 2 END AS clock, CASE channel WHEN 'click' THEN 'point' WHEN 'view' THEN 'window' ELSE 'event' END AS kind, CASE WHEN channel <> 'error' THEN t_s END AS a, CASE WHEN channel = 'view' THEN t_s + 240 * value END AS b,
 CASE WHEN channel = 'error' THEN CASE WHEN row_idx % 5 = 0 THEN '' ELSE CAST(CAST(floor(t_s / 86400) AS BIGINT) AS VARCHAR) END END AS ev, CASE WHEN row_idx % 7 <> 0 THEN CASE WHEN row_idx % 8 = 0 THEN 0.5 ELSE 1.0 END END AS classified, CASE WHEN row_idx % 4 <> 0 THEN CASE WHEN row_idx % 5 = 0 THEN 0.5 ELSE 1.0 END END AS equilibrium, CASE WHEN row_idx % 3 <> 0 THEN CASE WHEN row_idx % 4 = 0 THEN 0.5 ELSE 1.0 END END AS steady FROM r WHERE channel IN ('click', 'view', 'error'))"""
register(
    "c15_meeting_pairs",
    lambda s, d: V.meeting_pairs(supports(s, d), supports(s, d), tolerance_s=7200.0, base_s=3600.0),
    SUP + """ SELECT l.id AS left_id, r.id AS right_id, l.kind || '_' || r.kind AS mode FROM s l JOIN s r ON l.scope = r.scope AND l.clock = r.clock AND CASE l.kind || '_' || r.kind WHEN 'point_point' THEN abs(l.a - r.a) <= 7200 WHEN 'point_window' THEN l.a BETWEEN r.a AND r.b WHEN 'window_point' THEN r.a BETWEEN l.a AND l.b
 WHEN 'window_window' THEN greatest(l.a, r.a) < least(l.b, r.b) WHEN 'event_event' THEN l.ev = r.ev AND l.ev <> '' ELSE false END""",
)
LIMITS = V.TemporalLimits(point_tolerance_s=28800.0, minimum_classified=0.8, minimum_equilibrium=0.4, policy="minimum", quasi_equilibrium=True, minimum_steady=0.5)


def requests(s, d):
    """Each support with the sensor's next and third next one, and with an id that may be unknown, in the mode of their kinds or another."""
    x = supports(s, d)
    w = W.partitionBy("scope").orderBy(F.coalesce("start_s", F.col("id") * 60.0), "id")
    x = x.withColumns({"n1": F.lead("id", 1).over(w), "n3": F.lead("id", 3).over(w)})
    x = x.select(F.col("id").alias("left_id"), "kind", F.explode(F.array("n1", "n3", F.col("id") + 5000)).alias("right_id")).where("right_id IS NOT NULL")
    y = x.join(supports(s, d).select(F.col("id").alias("right_id"), F.col("kind").alias("other")), "right_id", "left")
    mode = F.when(F.col("left_id") % 13 == 0, "window_window").otherwise(F.concat_ws("_", "kind", F.coalesce("other", F.lit("point"))))
    return y.select("left_id", "right_id", mode.alias("mode"))


register(
    "c15_temporal_assessment",
    lambda s, d: rounded(V.assess_temporal(requests(s, d), supports(s, d), LIMITS)),
    SUP + """, x1 AS (SELECT *, lead(id, 1) OVER o AS n1, lead(id, 3) OVER o AS n3 FROM s WINDOW o AS (PARTITION BY scope ORDER BY coalesce(a, id * 60.0), id)), x2 AS (SELECT id, kind, unnest([n1, n3, id + 5000]) AS right_id FROM x1),
 q AS (SELECT x2.id AS left_id, right_id, CASE WHEN x2.id % 13 = 0 THEN 'window_window' ELSE x2.kind || '_' || coalesce(o.kind, 'point') END AS mode FROM x2 LEFT JOIN s o ON o.id = right_id WHERE right_id IS NOT NULL),
 j AS (SELECT q.*, l.id AS li, r.id AS ri, l.kind || '_' || r.kind AS kinds, l.scope AS ls, r.scope AS rs, l.clock AS lc, r.clock AS rc, CASE mode WHEN 'point_point' THEN abs(l.a - r.a) <= 28800 WHEN 'point_window' THEN l.a BETWEEN r.a AND r.b WHEN 'window_point' THEN r.a BETWEEN l.a AND l.b WHEN 'window_window' THEN greatest(l.a, r.a) < least(l.b, r.b) WHEN 'event_event' THEN l.ev = r.ev AND l.ev <> '' ELSE false END AS meets,
 CASE WHEN l.classified IS NOT NULL AND r.classified IS NOT NULL THEN least(l.classified, r.classified) END AS c, CASE WHEN l.equilibrium IS NOT NULL AND r.equilibrium IS NOT NULL THEN least(l.equilibrium, r.equilibrium) END AS e, CASE WHEN l.steady IS NOT NULL AND r.steady IS NOT NULL THEN least(l.steady, r.steady) END AS st FROM q LEFT JOIN s l ON l.id = left_id LEFT JOIN s r ON r.id = right_id),
 k AS (SELECT *, CASE WHEN li IS NULL OR ri IS NULL THEN 'unknown_evidence' WHEN mode <> kinds OR mode NOT IN ('point_point', 'point_window', 'window_point', 'window_window', 'event_event') THEN 'mode_support_mismatch' WHEN ls IS DISTINCT FROM rs THEN 'scope_mismatch' WHEN lc IS DISTINCT FROM rc THEN CASE WHEN lc IS NULL OR rc IS NULL THEN 'clock_unknown' ELSE 'clock_mismatch' END
 WHEN meets IS NOT TRUE THEN CASE mode WHEN 'point_point' THEN 'point_tolerance_exceeded' WHEN 'window_window' THEN 'no_positive_overlap' WHEN 'event_event' THEN 'event_mismatch' ELSE 'point_outside_window' END WHEN c < 0.8 THEN 'classified_below_minimum' WHEN e < 0.4 THEN 'equilibrium_below_minimum'
 WHEN (coalesce(st, e) >= 0.5) IS NOT TRUE THEN CASE WHEN coalesce(st, e) IS NULL THEN 'steadiness_unknown' ELSE 'not_steady' END END AS reason FROM j)
 SELECT left_id, right_id, mode, CASE WHEN reason IS NULL THEN 'eligible' WHEN reason IN ('unknown_evidence', 'mode_support_mismatch', 'scope_mismatch', 'clock_mismatch', 'clock_unknown', 'steadiness_unknown') THEN 'indeterminate' ELSE 'ineligible' END AS outcome, reason,
 CASE WHEN x THEN round(c, 6) END AS classified, CASE WHEN x THEN round(e, 6) END AS equilibrium, CASE WHEN x THEN round(st, 6) END AS steady FROM (SELECT *, meets IS TRUE AND reason IS DISTINCT FROM 'unknown_evidence' AND reason IS DISTINCT FROM 'mode_support_mismatch' AND reason IS DISTINCT FROM 'scope_mismatch' AND reason IS DISTINCT FROM 'clock_mismatch' AND reason IS DISTINCT FROM 'clock_unknown' AS x FROM k)""",
)


def derivations(s, d):
    """Customers derive from their nation and nations from their region; orders from their customer and, one in twenty, from an order that
    is missing; every ninth customer also derives from one of its orders, which closes a cycle."""
    o, c, n = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "nation")
    e = lambda df, a, b: df.select(a.cast("string").alias("child"), b.cast("string").alias("parent"))
    t = lambda p, col: F.concat(F.lit(p), F.col(col))
    out = e(o, t("o", "o_orderkey"), t("c", "o_custkey")).union(e(c, t("c", "c_custkey"), t("n", "c_nationkey"))).union(e(n, t("n", "n_nationkey"), t("r", "n_regionkey")))
    out = out.union(e(o.where("o_orderkey % 20 = 0"), t("o", "o_orderkey"), F.concat(F.lit("gone"), F.col("o_orderkey") % 7)))
    return out.union(e(o.where("o_custkey % 9 = 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")), t("c", "o_custkey"), t("o", "o_orderkey")))


def artifacts(s, d):
    """Orders, customers, nations and regions; every eleventh customer's families are unknown, regions have one each."""
    none, no = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    a = table(s, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("id"), F.array(F.concat(F.lit("y"), F.year("o_orderdate"))).alias("families"))
    a = a.union(table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")), F.when(F.col("c_custkey") % 11 == 0, no).otherwise(none)))
    a = a.union(table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")), none))
    return a.union(table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")), F.array(F.lower("r_name"))))


register(
    "f01_lineage_status",
    lambda s, d: rounded(G.resolve(artifacts(s, d), derivations(s, d))),
    """WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'o' || o_orderkey, 'gone' || (o_orderkey % 7) FROM orders WHERE o_orderkey % 20 = 0 UNION SELECT 'c' || o_custkey, 'o' || min(o_orderkey) FROM orders WHERE o_custkey % 9 = 0 GROUP BY o_custkey),
 n AS (SELECT 'o' || o_orderkey AS id, ['y' || year(o_orderdate)] AS fam FROM orders UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE [] END FROM customer UNION ALL SELECT 'n' || n_nationkey, [] FROM nation UNION ALL SELECT 'r' || r_regionkey, [lower(r_name)] FROM region),
 a AS (SELECT child AS id, parent AS anc FROM e UNION SELECT a.id, e.parent FROM a JOIN e ON a.anc = e.child), loops AS (SELECT id FROM a WHERE id = anc),
 g AS (SELECT a.id, count(*) AS k, bool_or(anc IN (SELECT id FROM loops)) AS cyc, coalesce(string_agg(anc, ',' ORDER BY anc) FILTER (n.id IS NULL), '') AS missing, bool_or(n.id IS NOT NULL AND n.fam IS NULL) AS unk FROM a LEFT JOIN n ON n.id = anc GROUP BY a.id),
 f AS (SELECT id, string_agg(DISTINCT f, ',' ORDER BY f) AS names FROM (SELECT id, unnest(fam) AS f FROM n UNION ALL SELECT a.id, unnest(n.fam) FROM a JOIN n ON n.id = anc) GROUP BY id)
 SELECT n.id, CASE WHEN cyc THEN 'cycle' WHEN missing <> '' THEN 'incomplete' ELSE 'complete' END AS status, coalesce(k, 0) AS ancestors, coalesce(missing, '') AS missing, CASE WHEN n.fam IS NULL OR coalesce(unk, false) THEN NULL ELSE coalesce(names, '') END AS families FROM n LEFT JOIN g USING (id) LEFT JOIN f USING (id)""",
)


def coverage(s, d):
    """Parts are protocols: each size group asks for two or three quantities, in the nation of its condition; lines are the evidence."""
    p, li = table(s, d, "part"), table(s, d, "lineitem")
    protocols = p.select(F.col("p_partkey").alias("protocol"), (F.col("p_size") % 4 + 2).cast("bigint").alias("minimum_families"))
    c = p.select(F.col("p_partkey").alias("protocol"), F.explode(F.sequence(F.lit(0), F.col("p_size") % 3)).alias("k"), "p_size")
    c = c.withColumn("requirement", F.explode(F.array(F.lit("A"), F.when(F.col("p_size") % 2 == 0, F.lit("R"))))).select("protocol", F.concat(F.lit("k"), "k").alias("condition"), F.when(F.col("k") == 0, "AIR").when(F.col("k") == 1, "RAIL").otherwise("SHIP").alias("scope"), "requirement")
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    e = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_quantity").alias("l_quantity"), F.min("l_suppkey").alias("l_suppkey"))
    roles = e.select(F.col("l_partkey").alias("protocol"), F.col("l_returnflag").alias("requirement"), key, F.when(F.col("l_quantity") > 2, "validation").otherwise("support").alias("role"))
    scope = F.when(F.col("l_orderkey") % 4 == 0, "AIR").when(F.col("l_orderkey") % 4 == 1, "RAIL").when(F.col("l_orderkey") % 4 == 2, "SHIP")
    evidence = e.select(key, scope.alias("scope"), (F.col("l_quantity") > 4).alias("independent"), F.array("l_suppkey").alias("families"))
    return V.condition_coverage(c, roles, evidence, protocols)


register(
    "f08_validation_coverage",
    lambda s, d: rounded(coverage(s, d)),
    """WITH e AS (SELECT min(l_partkey) AS protocol, min(l_returnflag) AS requirement, l_orderkey % 4 AS z, min(l_quantity) AS q, min(l_suppkey) AS family FROM lineitem GROUP BY l_orderkey, l_linenumber), v AS (SELECT *, CASE z WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' WHEN 2 THEN 'SHIP' END AS scope FROM e WHERE q > 2),
 c AS (SELECT p_partkey AS protocol, 'k' || k AS condition, CASE k WHEN 0 THEN 'AIR' WHEN 1 THEN 'RAIL' ELSE 'SHIP' END AS scope, req FROM part, range(3) t(k), (VALUES ('A'), ('R')) u(req) WHERE k <= p_size % 3 AND (req = 'A' OR p_size % 2 = 0)),
 h AS (SELECT protocol, condition, bool_and(EXISTS (SELECT 1 FROM v WHERE v.q > 4 AND v.protocol = c.protocol AND v.requirement = c.req AND v.scope = c.scope)) AS ok FROM c GROUP BY ALL),
 g AS (SELECT protocol, count(*) AS required, count(*) FILTER (ok) AS passed, coalesce(string_agg(condition, ',' ORDER BY condition) FILTER (ok), '') AS passed_conditions FROM h GROUP BY protocol),
 f AS (SELECT protocol, count(DISTINCT family) FILTER (q > 4) AS families, bool_or(q <= 4) AS doubt FROM v GROUP BY protocol), x AS (SELECT g.*, coalesce(families, 0) AS families, coalesce(doubt, false) AS doubt, p_size % 4 + 2 AS least FROM part JOIN g ON g.protocol = p_partkey LEFT JOIN f USING (protocol))
 SELECT protocol, required, passed, passed_conditions, families, passed = required AND families >= least AS satisfied, CASE WHEN passed = required AND families >= least THEN 'passed' WHEN doubt THEN 'unknown_family' ELSE 'missing_evidence' END AS reason FROM x""",
)


def promoted(s, d):
    """Suppliers are hypotheses: requirements met by parts of large first lines, gates by line numbers, contradictions by large returned lines."""
    li, sup = table(s, d, "lineitem"), table(s, d, "supplier")
    h = sup.select(F.col("s_suppkey").alias("hypothesis"), (F.col("s_suppkey") % 3 + 1).alias("minimum_support"))
    ask = sup.select(F.col("s_suppkey").alias("hypothesis"), F.explode(F.sequence(F.lit(0), F.col("s_suppkey") % 4)).alias("requirement"))
    ask = ask.select("hypothesis", "requirement", F.when(F.col("requirement") == 3, "validation").when(F.col("requirement") == 1, "support_and_validation").otherwise("support").alias("stage"), F.when((F.col("requirement") == 2) & (F.col("hypothesis") % 2 == 0), "optional").otherwise("required").alias("gate"))
    ev = li.where("l_quantity >= 48 AND l_linenumber = 1").select(F.col("l_suppkey").alias("hypothesis"), (F.col("l_partkey") % 4).cast("int").alias("requirement"), F.col("l_orderkey").alias("id"))
    first = in_order(li.where("l_quantity >= 46 AND l_linenumber <= 4").select("l_suppkey", "l_linenumber", "l_discount"), ["l_suppkey", "l_linenumber"])
    g = first.groupBy(F.col("l_suppkey").alias("hypothesis"), F.col("l_linenumber").alias("n")).agg((F.avg("l_discount") > 0.04).alias("satisfied"))
    g = g.select("hypothesis", F.element_at(F.array(*map(F.lit, ("timescale", "amplitude", "repeatability", "identifiability"))), F.col("n").cast("int")).alias("kind"), F.col("n").alias("gate"), F.when(F.col("hypothesis") % 17 != 0, F.col("satisfied")).alias("satisfied"))
    g = g.where("hypothesis % 5 <> 0")
    no = li.where("l_returnflag = 'R' AND l_quantity = 50 AND l_discount >= 0.1").groupBy(F.col("l_suppkey").alias("hypothesis")).agg(F.count("*").alias("strong_critical")).where("hypothesis % 6 = 0")
    ok = sup.select(F.col("s_suppkey").alias("hypothesis"), (F.col("s_acctbal") > 0).alias("satisfied"))
    return V.promote(h, ask, ev, g, no, ok)


def components(s, d):
    targets = table(s, d, "lineitem").where("l_linenumber = 1 AND l_quantity > 45").select(F.col("l_suppkey").alias("hypothesis"), (F.col("l_partkey") % 50).alias("component")).distinct()
    names = F.array(*map(F.lit, ("phenomenological", *V.LEVELS[1:])))
    prior = table(s, d, "part").where("p_partkey < 50 AND p_partkey % 5 <> 0").select(F.col("p_partkey").alias("component"), F.element_at(names, (F.col("p_partkey") % 4 + 1).cast("int")).alias("status"))
    return V.promote_components(promoted(s, d), targets, prior)


PROMOTED = """WITH h AS (SELECT s_suppkey AS hypothesis, s_suppkey % 3 + 1 AS least, s_acctbal > 0 AS valid FROM supplier), a AS (SELECT s_suppkey AS hypothesis, k AS requirement FROM supplier, range(4) t(k) WHERE k <= s_suppkey % 4 AND k <> 3 AND NOT (k = 2 AND s_suppkey % 2 = 0)),
 n AS (SELECT hypothesis, count(*) AS required, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_quantity >= 48 AND l_linenumber = 1 AND l_suppkey = hypothesis AND l_partkey % 4 = requirement)) AS supported FROM a GROUP BY hypothesis),
 g AS (SELECT l_suppkey AS hypothesis, l_linenumber AS k, CASE WHEN l_suppkey % 17 <> 0 THEN avg(l_discount) > 0.04 ELSE false END AS ok FROM lineitem WHERE l_quantity >= 46 AND l_linenumber <= 4 AND l_suppkey % 5 <> 0 GROUP BY l_suppkey, l_linenumber), gg AS (SELECT hypothesis, bool_and(ok) AS all_ok, count(*) FILTER (ok) AS passed, string_agg(CASE k WHEN 1 THEN 'timescale' WHEN 2 THEN 'amplitude' WHEN 3 THEN 'repeatability' ELSE 'identifiability' END, ',' ORDER BY k) FILTER (ok) AS names FROM g GROUP BY hypothesis),
 x AS (SELECT DISTINCT l_suppkey AS hypothesis, true AS bad FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_discount >= 0.1 AND l_suppkey % 6 = 0),
 j AS (SELECT h.*, coalesce(required, 0) AS required, coalesce(supported, 0) AS supported, coalesce(passed, 0) AS gates_passed, coalesce(bad, false) AS bad, names, coalesce(supported, 0) = coalesce(required, 0) AS whole, coalesce(all_ok, true) AS gates FROM h LEFT JOIN n USING (hypothesis) LEFT JOIN gg USING (hypothesis) LEFT JOIN x USING (hypothesis)),
 k AS (SELECT *, CASE WHEN bad THEN 'contradicted' WHEN whole AND supported >= least AND gates THEN CASE WHEN valid THEN 'validated_for_domain' ELSE 'experimentally_supported' END WHEN supported > 0 AND whole THEN 'hypothesized' ELSE 'not_assessed' END AS level FROM j)"""
register(
    "i15_hypothesis_promotion",
    lambda s, d: rounded(promoted(s, d)),
    PROMOTED + " SELECT hypothesis, supported, required, gates_passed, level, concat_ws(',', CASE level WHEN 'contradicted' THEN 'critical_contradiction' WHEN 'validated_for_domain' THEN 'validation' END, names) AS reasons FROM k",
)
register(
    "i15_component_promotion",
    lambda s, d: components(s, d),
    PROMOTED + """, t AS (SELECT DISTINCT l_suppkey AS hypothesis, l_partkey % 50 AS component FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 45), w(level, n) AS (VALUES ('phenomenological', 0), ('hypothesized', 1), ('experimentally_supported', 2), ('validated_for_domain', 3)),
 y AS (SELECT hypothesis, component, CASE WHEN p_partkey IS NULL THEN 'hypothesized' ELSE (SELECT w.level FROM w WHERE n = p_partkey % 4) END AS prior, CASE WHEN k.level IN ('hypothesized', 'experimentally_supported', 'validated_for_domain') THEN k.level END AS target FROM t JOIN k USING (hypothesis) LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey < 50 AND p_partkey % 5 <> 0) p ON p.p_partkey = component)
 SELECT hypothesis, component, prior, target, CASE WHEN b.n > a.n THEN target ELSE prior END AS status FROM y JOIN w a ON a.level = prior LEFT JOIN w b ON b.level = target""",
)

RULES = [("fouling", "critical", True, 1, 3), ("shift", "watch", False, 1, 0), ("quiet", "info", False, 2, 0), ("late", "degraded", False, 1, 120), ("noted", "info", False, 0, 0)]
CONDITIONS = [
    ("fouling", "all", "click", "relative_increase", 0.02), ("fouling", "any", "view", "robust_z", 0.5), ("fouling", "any", "error", "trend_increasing", 0.1),
    ("shift", "any", "click", "log_ratio", 0.05), ("shift", "any", "view", "relative_decrease", 0.05), ("shift", "any", "purchase", "greater_than", 55.0),
    ("quiet", "all", "error", "less_than", 60.0), ("quiet", "all", "signup", "trend_decreasing", None), ("late", "all", "purchase", "robust_z", 0.2), ("noted", "all", "view", "level_present", None), ("noted", "any", "click", "warning_present", None), ("noted", "any", "error", "warning_present", None),
]
AREAS = {"click": "signal", "view": "dynamic", "error": "reference", "purchase": "calibration", "signup": "signal"}


def rule_inputs(s, d):
    """Means of each sensor's channels as features, in comparison with the channel over all sensors, and their weekly slopes. Means are taken in
    the order of the file, as they can lie exactly on a threshold."""
    r = in_order(readings(s, d), SERIES)
    f = written(r.groupBy(*SERIES).agg(F.avg("value").alias("m"), F.count("*").alias("n")), "means")
    area = F.create_map(*(F.lit(x) for kv in AREAS.items() for x in kv))
    features = f.where("n >= 3").select("sensor_id", F.col("channel").alias("feature"), F.when(F.col("n") >= 8, F.col("m")).alias("value"), F.when(F.col("n") < 12, "few").alias("warning"), F.element_at(area, F.col("channel")).alias("domain"))
    b = f.groupBy("channel").agg(F.avg("m").alias("bm"), F.stddev_samp("m").alias("bs"), F.count("*").alias("records"))
    c = f.join(b, "channel").select("sensor_id", F.col("channel").alias("feature"), ((F.col("m") - F.col("bm")) / F.col("bm")).alias("relative"), F.log(F.col("m") / F.col("bm")).alias("log_ratio"), F.when(F.col("bs") > 0, (F.col("m") - F.col("bm")) / F.col("bs")).alias("robust_z"), "records")
    weeks = written(r.groupBy(*SERIES, F.floor(F.col("t_s") / 604800).alias("x")).agg(F.avg("value").alias("y")), "weeks")
    slopes = S.ols(weeks, SERIES).select("sensor_id", F.col("channel").alias("feature"), "slope")
    rules = s.createDataFrame(RULES, "rule string, severity string, mechanistic boolean, minimum_domains int, minimum_records int")
    conditions = s.createDataFrame(CONDITIONS, "rule string, part string, feature string, operator string, threshold double")
    return rules, conditions, features, c, slopes


def with_trends(s, d):
    rules, conditions, features, c, slopes = rule_inputs(s, d)
    return A.evaluate_rules(rules, conditions, features, c, ["sensor_id"], trends=slopes)


def plain_rules(s, d):
    rules, conditions, features, c, slopes = rule_inputs(s, d)
    trends = slopes.select("sensor_id", F.concat(F.lit("trend."), "feature").alias("feature"), F.col("slope").alias("value"), F.lit(None).cast("string").alias("warning"), F.lit("drift").alias("domain"))
    counts = features.groupBy("sensor_id").agg((F.count("*") * 20).alias("records"))
    return A.evaluate_rules(rules, conditions, features.union(trends), c, ["sensor_id"], baselines=counts)


def _v(x):
    return "NULL" if x is None else repr(x) if not isinstance(x, bool) else str(x).lower()


def rule_sql(longitudinal: bool) -> str:
    rows = lambda data: ", ".join("(" + ", ".join(map(_v, x)) + ")" for x in data)
    area = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AREAS.items())
    short = "minimum_records > 0 AND records IS NULL OR records < minimum_records" if longitudinal else "false"
    up, down = ("slope > coalesce(v, 0)", "slope < -coalesce(v, 0)") if longitudinal else ("slope > 0", "slope < 0")
    lower = "CASE WHEN contradicted > 0 THEN 1 ELSE 0 END" if longitudinal else "0"
    # a week's slope counts here only for sensors with features: the plain form reads it as a feature of the sensor
    return R + f""", f AS (SELECT sensor_id, channel AS feature, avg(value) AS m, count(*) AS n FROM r GROUP BY ALL), ft AS (SELECT sensor_id, feature, CASE WHEN n >= 8 THEN m END AS value, CASE WHEN n < 12 THEN 'few' END AS warning, CASE feature {area} END AS domain FROM f WHERE n >= 3),
 b AS (SELECT feature, avg(m) AS bm, stddev_samp(m) AS bs, count(*) AS records FROM f GROUP BY feature), cp AS (SELECT sensor_id, feature, (m - bm) / bm AS relative, ln(m / bm) AS log_ratio, (m - bm) / bs AS z, records FROM f JOIN b USING (feature)),
 k AS (SELECT sensor_id, channel, CAST(floor(t_s / 604800) AS BIGINT) AS x, avg(value) AS y FROM r GROUP BY ALL), sl AS (SELECT sensor_id, channel AS feature, covar_pop(x, y) / var_pop(x) AS slope FROM k GROUP BY ALL HAVING count(*) >= 2 AND var_pop(x) > 0),
 w AS (SELECT * FROM (SELECT DISTINCT sensor_id FROM {'ft' if longitudinal else '(SELECT sensor_id FROM ft UNION SELECT sensor_id FROM sl)'}), (VALUES {rows(CONDITIONS)}) c(rule, part, feature, op, v) JOIN (VALUES {rows(RULES)}) u(rule, severity, mechanistic, least, minimum_records) USING (rule)),
 h AS (SELECT w.*, domain, CASE WHEN op IN ('relative_increase', 'relative_decrease', 'log_ratio', 'robust_z') AND ({short}) THEN NULL WHEN op = 'greater_than' THEN value > v WHEN op = 'less_than' THEN value < v WHEN op = 'relative_increase' THEN relative > v WHEN op = 'relative_decrease' THEN relative < -v WHEN op = 'log_ratio' THEN abs(log_ratio) > v
 WHEN op = 'robust_z' THEN abs(z) > v WHEN op = 'warning_present' AND domain IS NOT NULL THEN warning IS NOT NULL WHEN op = 'level_present' AND domain IS NOT NULL THEN value IS NOT NULL WHEN op = 'trend_increasing' THEN {up} WHEN op = 'trend_decreasing' THEN {down} END AS h FROM w LEFT JOIN ft USING (sensor_id, feature) LEFT JOIN cp USING (sensor_id, feature) LEFT JOIN sl USING (sensor_id, feature)),
 g AS (SELECT sensor_id, rule, any_value(severity) AS severity, any_value(mechanistic) AS mechanistic, any_value(least) AS least, any_value(minimum_records) AS minimum_records, count(*) FILTER (h) AS satisfied, count(*) FILTER (NOT h) AS contradicted, count(*) FILTER (h IS NULL) AS unavailable0, count(DISTINCT {"coalesce(domain, 'data_quality')" if longitudinal else 'domain'}) FILTER (h) AS domains,
 count(*) FILTER (part = 'all' AND h IS NOT TRUE) AS missed, count(*) FILTER (part = 'any') AS n_any, count(*) FILTER (part = 'any' AND h) AS one FROM h GROUP BY ALL), gg AS (SELECT g.*, unavailable0 + {'0' if longitudinal else "CASE WHEN coalesce((SELECT 20 * count(*) FROM ft WHERE ft.sensor_id = g.sensor_id), 0) < minimum_records THEN 1 ELSE 0 END"} AS unavailable FROM g),
 y AS (SELECT *, missed = 0 AND (n_any = 0 OR one > 0) AND unavailable = 0 AND domains >= greatest(least, CASE WHEN mechanistic THEN 2 ELSE 0 END) AS triggered, CASE WHEN domains >= 3 THEN 3 ELSE 2 END - {lower} AS grade FROM gg)
 SELECT sensor_id, rule, triggered, CASE WHEN NOT triggered THEN 'insufficient' WHEN grade = 3 THEN 'high' WHEN grade = 2 THEN 'moderate' ELSE 'low' END AS confidence, severity, satisfied, contradicted, CAST(unavailable AS BIGINT) AS unavailable, domains FROM y"""


register("i03_rule_operators", lambda s, d: rounded(plain_rules(s, d)), rule_sql(False))
register("i04_rules_with_trends", lambda s, d: rounded(with_trends(s, d)), rule_sql(True))
