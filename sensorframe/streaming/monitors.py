"""Streaming twins of the sequential series operators; each gives the rows of its batch form on ordered input.

Streams carry the columns of readings plus an event-time column ``ts``. State is one small value per series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from sensorframe.operators.estimation import FILTERED, GATES, filter_step


def sampling_monitor(stream: DataFrame, key: list[str], window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows, span, extremes and missing share of every series and tumbling window, by mergeable sums."""
    w = F.window("ts", window)
    rows = stream.withWatermark("ts", delay).groupBy(*key, w.alias("w"))
    rows = rows.agg(F.count("*").alias("n"), F.min("t_s").alias("t0"), F.max("t_s").alias("t1"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.count_if(F.col("value").isNull()).alias("missing"))
    return rows.select(*key, F.col("w.start").alias("start"), "n", ((F.col("t1") - F.col("t0")) / F.greatest(F.col("n") - 1, F.lit(1))).alias("dt_mean"), "v_min", "v_max", (F.col("missing") / F.col("n")).alias("missing_share"))


def _median(ordered: list[float]) -> float:
    n = len(ordered)
    return float("nan") if not n else ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


def _stateful(stream: DataFrame, key: list[str], step: Callable, state_schema: str, columns: str) -> DataFrame:
    """Runs ``step`` (state, t_s, value) -> (state, results) over the rows of a series in order of row_idx; states come and go with the rows."""
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in [*key, "row_idx", "t_s"])
    schema = StructType.fromDDL(f"{kinds}, {columns}")
    names = schema.names

    def run(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, made = tuple(state.get) if state.exists else None, []
        rows = [r for part in parts for r in zip(part["row_idx"].tolist(), part["t_s"].tolist(), part["value"].tolist(), strict=True)]
        for i, t, v in sorted(rows, key=lambda r: r[0]):
            kept, result = step(kept, float(t), v)
            made.append((*own, i, t, *result))
        state.update(kept)
        yield pd.DataFrame(made, columns=names)

    rows = stream.select(*key, "row_idx", "t_s", "value").groupBy(*key)
    return rows.applyInPandasWithState(run, schema, StructType.fromDDL(state_schema), "append", GroupStateTimeout.NoTimeout)


def segment_resets(stream: DataFrame, key: list[str], reset_s: float, fraction: float) -> DataFrame:
    """Numbers segments: a new one where time falls by ``reset_s`` or to ``fraction`` of the time before."""

    def step(state, t, v):
        before, segment = state or (t, 0)
        new = state is not None and (before - t >= reset_s or (t < before and t <= before * fraction))
        return (t, int(segment + new)), (int(segment + new),)

    return _stateful(stream, key, step, "t double, segment bigint", "segment bigint")


def hampel(stream: DataFrame, key: list[str], width: int, threshold: float) -> DataFrame:
    """Flags a value against the median and spread of the last ``width`` values, itself included; missing ones take no part."""

    def step(state, t, v):
        v = float("nan") if v is None else float(v)
        values = [*(state[0] if state else []), v][-width:]
        known = sorted(x for x in values if x == x)
        m = _median(known)
        gap, mad = abs(v - m), _median(sorted(abs(x - m) for x in known))
        z = gap / (1.4826 * mad) if mad > 0 else 1e12 if gap > 0 else 0.0
        return (values,), (float(z), bool(z > threshold))

    return _stateful(stream, key, step, "v array<double>", "z double, spike boolean")


def scalar_filter(stream: DataFrame, key: list[str], q: float, r: float, confidence: float = 0.99) -> DataFrame:
    """The recursive filter of the batch operator."""
    gate = GATES[confidence]
    return _stateful(stream, key, lambda state, t, v: filter_step(state, t, None if pd.isna(v) else float(v), q, r, gate), "t double, x double, p double", FILTERED)


def drop_late_duplicates(stream: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """Identical repeated rows within the watermark are dropped; conflicting ones (same time, other value) pass on;
    :func:`part_conflicts` holds them back."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*key, "t_s", "value"])


def part_conflicts(stream: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """Rows with a fate, the twin of ``operators.assess.part_conflicts``: of rows with one key, time and value the first by row_idx is kept,
    all rows of a time with different values are quarantined. ``ts`` is ``t_s`` as a timestamp. A time's rows come out once the watermark has
    passed it; state is kept per key and time, so a busy key is spread. Rows later than ``delay``, and times up to 1970, are dropped by the watermark."""
    value = F.col("value").cast("double")
    one = F.struct(F.col("row_idx").cast("bigint").alias("row_idx"), F.when(~F.isnan(value), value).alias("value"))
    held = stream.withWatermark("ts", delay).groupBy(*key, "t_s", "ts").agg(F.sort_array(F.collect_list(one)).alias("_rows"))
    conflict = F.size(F.array_distinct(F.col("_rows.value"))) > 1
    out = held.select(*key, "t_s", F.when(conflict, "quarantined").otherwise("kept").alias("fate"), F.explode(F.when(conflict, F.col("_rows")).otherwise(F.slice("_rows", 1, 1))).alias("_r"))
    return out.select(*key, "t_s", "_r.row_idx", "_r.value", "fate")


class OrderedMatcher(StatefulProcessor):
    """Pairs left rows with their nearest unused right rows in order of time, each once the watermark is a tolerance past it."""

    def __init__(self, out: list[str], tolerance: float):
        self.out, self.tolerance = out, tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left, self.right = (handle.getListState(name, "x double, id bigint") for name in ("left", "right"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for side, kept in (("l", self.left), ("r", self.right)):
                own = part[part["side"] == side]
                if len(own):
                    kept.appendList([(float(r.x), int(r.id)) for r in own.itertuples(index=False)])
            if (part["side"] == "l").any():
                self._wake(part.loc[part["side"] == "l", "x"].min())
        yield pd.DataFrame()

    def _wake(self, x: float) -> None:
        """When the earliest waiting left row is due; then the next one's time is set."""
        self.handle.registerTimer(int((x + self.tolerance) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        left = sorted(tuple(r) for r in self.left.get()) if self.left.exists() else []
        due = [r for r in left if r[0] + self.tolerance <= now]
        if left[len(due) :]:
            self._wake(left[len(due)][0])
        if due:
            right = sorted(tuple(r) for r in self.right.get()) if self.right.exists() else []
            made = []
            for x, li in due:
                near = min(((abs(x - rx), rx, ri) for rx, ri in right if abs(x - rx) <= self.tolerance), default=None)
                if near:
                    right.remove(near[1:])
                    made.append((*key, li, near[2], near[0]))
            # later left rows are at the watermark or after it, waiting ones less than a tolerance before it
            for kept, rows in ((self.left, left[len(due) :]), (self.right, [r for r in right if r[0] >= now - 2 * self.tolerance])):
                kept.put(rows) if rows else kept.clear()
            yield pd.DataFrame(made, columns=self.out)

    def close(self) -> None:
        pass


def match_ordered(stream: DataFrame, key: list[str], tolerance: float, delay: str = "10 minutes") -> DataFrame:
    """Pairs (li, ri, d), the twin of ``operators.estimation.match_ordered``, of a stream with key, side (l or r), id, x (seconds since 1970) and
    ts, the same as a timestamp. A left row is decided once the watermark is ``tolerance`` past it; the last ones of a stream that ends
    wait. State holds a key's rows of twice the tolerance and the delay."""
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in key)
    schema = StructType.fromDDL(f"{kinds}, li bigint, ri bigint, d double")
    rows = stream.withWatermark("ts", delay).select(*key, "side", F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), "ts")
    return rows.groupBy(*key).transformWithStateInPandas(statefulProcessor=OrderedMatcher(schema.names, tolerance), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def latest_event(stream: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Each reading with the latest event of a static table at or before it, as event_t and event_value; nulls before the first.

    An event reigns until the next one: reigns that ended are met by equi joins on their day buckets, the last one of a key, which
    never ends, by a join on the key alone.
    """
    from pyspark.sql import Window as W

    day = 86400.0
    e = events.select(*key, F.col("t_s").alias("_from"), F.col("value").alias("_value"), F.lead("t_s").over(W.partitionBy(key).orderBy("t_s")).alias("_until"))
    past = e.where("_until > _from").withColumn("_b", F.explode(F.sequence(F.floor(F.col("_from") / day), F.floor(F.col("_until") / day))))
    last = e.where("_until IS NULL").select(*key, F.struct("_from", "_value").alias("_last"))
    s = stream.withColumn("_b", F.floor(F.col("t_s") / day)).alias("s")
    on = [F.col(f"s.{k}") == F.col(f"p.{k}") for k in [*key, "_b"]] + [F.col("s.t_s") >= F.col("_from"), F.col("s.t_s") < F.col("_until")]
    s = s.join(past.alias("p"), on, "left").select("s.*", "_from", "_value").drop("_b").join(last, key, "left")
    reigns = F.col("t_s") >= F.col("_last._from")
    return s.withColumns({"event_t": F.when(reigns, F.col("_last._from")).otherwise(F.col("_from")), "event_value": F.when(reigns, F.col("_last._value")).otherwise(F.col("_value"))}).drop("_from", "_value", "_last")
