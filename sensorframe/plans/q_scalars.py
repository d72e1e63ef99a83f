"""Registered string, map, labelling and transform queries, metadata join and grouped comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorframe.operators import series as S
from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import DR, OLS
from sensorframe.plans.q_series import drift_input as _drift
from sensorframe.sources.views import SERIES, readings, table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

register(
    "j_math_transforms",
    lambda s, d: rounded(readings(s, d).select("sensor_id", "row_idx", F.log(2.0, F.when(F.col("value") > 5, F.col("value"))).alias("log2"), (-F.log10(F.when(F.col("value") > 5, F.col("value")))).alias("neg_log10"), (2 * F.col("value") + 3).alias("linear"), F.format_string("%d*x + %d", F.lit(2), F.lit(3)).alias("term"))),
    "SELECT user_id AS sensor_id, event_id AS row_idx, round(CASE WHEN value > 5 THEN log2(value) END, 6) AS log2, round(-log10(CASE WHEN value > 5 THEN value END), 6) AS neg_log10, round(2 * value + 3, 6) AS linear, '2*x + 3' AS term FROM events",
)
register(
    "j_strings",
    lambda s, d: table(s, d, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")).alias("key"), F.regexp_extract("p_brand", r"#(\d+)$", 1).alias("tag"), F.contains(F.col("p_name"), F.lit("ring")).alias("is_ring"), F.element_at(F.split("p_type", " "), 1).alias("family")),
    "SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) AS key, regexp_extract(p_brand, '#(\\d+)$', 1) AS tag, contains(p_name, 'ring') AS is_ring, string_split(p_type, ' ')[1] AS family FROM part",
)
RULES = [(1, "ring", None, "ring_cell"), (2, None, "PROMO", "promo_cell"), (3, "small", None, "small_cell")]


def labelled(s, d):
    """The first rule that fits a name and a type; an explicit tag (size 1) wins, else the default."""
    rules = s.createDataFrame(RULES, "priority int, in_name string, in_type string, label string")
    p = table(s, d, "part")
    fits = (F.col("in_name").isNull() | F.col("p_name").contains(F.col("in_name"))) & (F.col("in_type").isNull() | F.col("p_type").contains(F.col("in_type")))
    hit = p.join(F.broadcast(rules), fits).groupBy("p_partkey").agg(F.min_by("label", "priority").alias("label"))
    return p.join(hit, "p_partkey", "left").select("p_partkey", F.when(F.col("p_size") == 1, "tagged").otherwise(F.coalesce("label", F.lit("default"))).alias("label"))


register(
    "j_rule_labels",
    labelled,
    "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'tagged' WHEN contains(p_name, 'ring') THEN 'ring_cell' WHEN contains(p_type, 'PROMO') THEN 'promo_cell' WHEN contains(p_name, 'small') THEN 'small_cell' ELSE 'default' END AS label FROM part",
)
register(
    "j_map_json",
    lambda s, d: table(s, d, "events").withColumn("m", F.from_json("props", "map<string,string>")).select("event_id", F.coalesce(F.col("m")["key"], F.col("m")["k"]).try_cast("bigint").alias("k"), F.size(F.map_filter("m", lambda k, v: v.cast("int") > 50)).cast("bigint").alias("over")),
    "SELECT event_id, TRY_CAST(coalesce(props ->> '$.key', props ->> '$.k') AS BIGINT) AS k, CASE WHEN CAST(props ->> '$.k' AS INTEGER) > 50 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS over FROM events",
)
register(
    "a08_metadata_join",
    lambda s, d: readings(s, d).join(table(s, d, "customer").select(F.col("c_custkey").alias("sensor_id"), F.col("c_mktsegment").alias("sensor_type")), "sensor_id", "left").groupBy("sensor_type", "channel").agg(F.count("*").alias("n")),
    "SELECT c_mktsegment AS sensor_type, event_type AS channel, count(*) AS n FROM events LEFT JOIN customer ON c_custkey = user_id GROUP BY ALL",
)
register(
    "d39_grouped_comparison",
    lambda s, d: rounded(S.describe(readings(s, d), SERIES).select(*SERIES, "mean", "sd").join(S.ols(_drift(s, d), SERIES).select(*SERIES, "slope"), SERIES, "left"), 5),
    DR + OLS + ", ds AS (SELECT sensor_id, channel, avg(y) AS mean, stddev_samp(y) AS sd FROM x GROUP BY ALL) SELECT ds.sensor_id, ds.channel, round(mean, 5) AS mean, round(sd, 5) AS sd, round(slope, 5) AS slope FROM ds LEFT JOIN l USING (sensor_id, channel)",
)
