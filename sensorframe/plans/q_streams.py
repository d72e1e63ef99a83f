"""Registered streaming queries: the given events as a stream, run to their end, and what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.plans.common import Registry, rounded
from sensorframe.plans.q_series import R
from sensorframe.sources.storage import fresh_path
from sensorframe.sources.views import SERIES, readings
from sensorframe.streaming import monitors as M

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def live(s: SparkSession, d: str) -> DataFrame:
    """The readings as a stream, with their time as ``ts``."""
    raw = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    ts = F.col("ts").cast("timestamp")
    return raw.select(F.col("user_id").alias("sensor_id"), F.col("event_type").alias("channel"), F.col("event_id").alias("row_idx"), (F.unix_micros(ts) / 1e6).alias("t_s"), "value", ts.alias("ts"))


def run(s: SparkSession, d: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All of the stream's rows, written to the shared folder. State is kept by RocksDB while it runs."""
    path, before = fresh_path(s, "stream"), s.conf.get(_PROVIDER, None)
    zone = s.conf.get("spark.sql.session.timeZone")
    s.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        out = plan(live(s, d))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

        q = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        schema = out.schema
    finally:
        s.conf.set("spark.sql.session.timeZone", zone)
        s.conf.unset(_PROVIDER) if before is None else s.conf.set(_PROVIDER, before)
    return s.read.schema(schema).parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/*")


register(
    "h01_sampling_monitor",
    lambda s, d: rounded(run(s, d, lambda r: M.sampling_monitor(r, SERIES, "1 day", "1 hour"), "complete").select(*SERIES, F.floor(F.unix_seconds("start") / 86400).alias("day"), "n", "dt_mean", "v_min", "v_max", "missing_share"), 4),
    R + """ SELECT sensor_id, channel, CAST(floor(t_s / 86400) AS BIGINT) AS day, count(*) AS n, round((max(t_s) - min(t_s)) / greatest(count(*) - 1, 1), 4) AS dt_mean, round(min(value), 4) AS v_min, round(max(value), 4) AS v_max, round((count(*) - count(value)) / count(*), 4) AS missing_share FROM r GROUP BY ALL""",
)


def scrambled(r: DataFrame) -> DataFrame:
    return r.withColumn("t_s", F.col("t_s") - F.when(F.col("row_idx") % 97 == 0, 86400.0).otherwise(0.0))


register(
    "h02_reset_segments",
    lambda s, d: rounded(run(s, d, lambda r: M.segment_resets(scrambled(r), SERIES, 3600.0, 0.5)).select(*SERIES, "row_idx", "segment")),
    R + """, x AS (SELECT sensor_id, channel, row_idx, t_s - CASE WHEN row_idx % 97 = 0 THEN 86400.0 ELSE 0.0 END AS t_s FROM r), p AS (SELECT *, lag(t_s) OVER (PARTITION BY sensor_id, channel ORDER BY row_idx) AS b FROM x)
 SELECT sensor_id, channel, row_idx, CAST(coalesce(sum(CASE WHEN b - t_s >= 3600 OR (t_s < b AND t_s <= b * 0.5) THEN 1 ELSE 0 END) OVER (PARTITION BY sensor_id, channel ORDER BY row_idx), 0) AS BIGINT) AS segment FROM p""",
)
register(
    "h03_causal_hampel",
    lambda s, d: rounded(run(s, d, lambda r: M.hampel(r, SERIES, 9, 3.0)).select(*SERIES, "row_idx", "z", "spike"), 4),
    R + """, w AS (SELECT *, median(value) OVER win AS m, list(value) OVER win AS v FROM r WINDOW win AS (PARTITION BY sensor_id, channel ORDER BY row_idx ROWS 8 PRECEDING)), k AS (SELECT *, list_median(list_transform(v, lambda x: abs(x - m))) AS mad FROM w),
 z AS (SELECT *, CASE WHEN mad > 0 THEN abs(value - m) / (1.4826 * mad) WHEN abs(value - m) > 0 THEN 1e12 ELSE 0.0 END AS z FROM k) SELECT sensor_id, channel, row_idx, round(z, 4) AS z, z > 3.0 AS spike FROM z""",
)


def with_events(s, d):
    events = readings(s, d).where("channel = 'error'").select("sensor_id", "t_s", "value")
    return run(s, d, lambda r: M.latest_event(r.where("channel = 'click'"), events, ["sensor_id"])).select("sensor_id", "row_idx", "event_t", "event_value")


register(
    "h06_event_stream_join",
    lambda s, d: rounded(with_events(s, d), 4),
    R + """, c AS (SELECT * FROM r WHERE channel = 'click'), e AS (SELECT * FROM r WHERE channel = 'error') SELECT c.sensor_id, c.row_idx, round(e.t_s, 4) AS event_t, round(e.value, 4) AS event_value FROM c ASOF LEFT JOIN e ON c.sensor_id = e.sensor_id AND c.t_s >= e.t_s""",
)


def repeated(r: DataFrame) -> DataFrame:
    """Every fifth reading comes twice, every seventh twice with another value."""
    copies = F.array(F.lit(0), F.when(F.col("row_idx") % 5 == 0, 1), F.when(F.col("row_idx") % 7 == 0, 2))
    r = r.withColumn("copy", F.explode(F.array_compact(copies)))
    return r.withColumns({"row_idx": F.col("row_idx") * 3 + F.col("copy"), "value": F.col("value") + F.when(F.col("copy") == 2, 1.0).otherwise(0.0)})


register(
    "h08_conflict_stream",
    lambda s, d: rounded(run(s, d, lambda r: M.part_conflicts(repeated(r), SERIES, "1 hour")).select(*SERIES, "row_idx", "value", "fate")),
    R + """, x AS (SELECT sensor_id, channel, t_s, row_idx * 3 AS i, value AS v, row_idx % 7 = 0 AS bad FROM r UNION ALL SELECT sensor_id, channel, t_s, row_idx * 3 + 1, value, row_idx % 7 = 0 FROM r WHERE row_idx % 5 = 0 AND row_idx % 7 = 0 UNION ALL SELECT sensor_id, channel, t_s, row_idx * 3 + 2, value + 1, true FROM r WHERE row_idx % 7 = 0)
 SELECT sensor_id, channel, i AS row_idx, round(v, 6) AS value, CASE WHEN bad THEN 'quarantined' ELSE 'kept' END AS fate FROM x WHERE t_s < (SELECT max(t_s) FROM r) - 3600""",
)


def sides(r: DataFrame) -> DataFrame:
    side = F.when(F.col("channel") == "click", "l").when(F.col("channel") == "view", "r")
    return r.select("sensor_id", side.alias("side"), F.col("row_idx").alias("id"), F.col("t_s").alias("x"), "ts").where("side IS NOT NULL")


register("h07_stream_matcher", lambda s, d: rounded(run(s, d, lambda r: M.match_ordered(sides(r), ["sensor_id"], 21600.0, "1 hour")), 4))
