"""Evidence for hypotheses: joins in time, coverage of conditions by independent evidence, promotion of hypotheses and components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How two supports can meet, by their kinds.
MODES = {"point_point": ("point", "point"), "point_window": ("point", "window"), "window_point": ("window", "point"), "window_window": ("window", "window"), "event_event": ("event", "event")}


@dataclass(frozen=True)
class TemporalLimits:
    """``policy`` says which steady shares are allowed: all_steady (1), minimum (``minimum_steady``) or worst_case (whichever of the steady and
    equilibrium shares is known is 1); ``quasi_equilibrium`` lets the equilibrium share stand in for an unknown steady one."""

    point_tolerance_s: float = 0.0
    minimum_classified: float = 0.0
    minimum_equilibrium: float = 0.0
    policy: str = "worst_case"
    quasi_equilibrium: bool = False
    minimum_steady: float = 1.0
    reject_if_disturbed: bool = False


def _meets(left: str, right: str, mode: Column, tolerance: float) -> Column:
    a = lambda n: F.col(left + n)
    b = lambda n: F.col(right + n)
    return (
        F.when(mode == "point_point", F.abs(a("start_s") - b("start_s")) <= tolerance)
        .when(mode == "point_window", (a("start_s") >= b("start_s")) & (a("start_s") <= b("end_s")))
        .when(mode == "window_point", (b("start_s") >= a("start_s")) & (b("start_s") <= a("end_s")))
        .when(mode == "window_window", F.greatest(a("start_s"), b("start_s")) < F.least(a("end_s"), b("end_s")))
        .when(mode == "event_event", (a("event_id") != "") & (a("event_id") == b("event_id")))
    )


def assess_temporal(requests: DataFrame, supports: DataFrame, limits: TemporalLimits = TemporalLimits()) -> DataFrame:
    """Each request (left_id, right_id, mode) with outcome (eligible, ineligible, indeterminate), reason, and the shares of both sides together.

    ``supports`` has id, scope, clock, kind (point, window, event), start_s, end_s, event_id, classified, equilibrium and steady, one row an id.
    Indeterminate are supports of other kinds than the mode's, other scopes, other or unknown clocks, unknown ids, and requests that meet
    but of which no share is known; a missing time or event id does not meet. Shares are the smaller of both sides, null where one is.
    """
    columns = ["id", "scope", "clock", "kind", "start_s", "end_s", "event_id", "classified", "equilibrium", "steady"]
    s = supports.select(columns)
    d = requests.join(s.select([F.col(c).alias(f"l_{c}") for c in columns]), F.col("left_id") == F.col("l_id"), "left")
    d = d.join(s.select([F.col(c).alias(f"r_{c}") for c in columns]), F.col("right_id") == F.col("r_id"), "left")
    kinds = F.create_map(*(F.lit(x) for m, k in MODES.items() for x in (m, " ".join(k))))
    d = d.withColumn("_meets", F.coalesce(_meets("l_", "r_", F.col("mode"), limits.point_tolerance_s), F.lit(False)))
    shares = {n: F.when(F.col(f"l_{n}").isNotNull() & F.col(f"r_{n}").isNotNull(), F.least(f"l_{n}", f"r_{n}")) for n in ("classified", "equilibrium", "steady")}
    d = d.withColumns(shares)
    steady, quasi = F.col("steady"), F.col("equilibrium")
    observed = F.coalesce(steady, quasi)
    stand_in = F.coalesce(steady, quasi) if limits.quasi_equilibrium else steady
    allowed = {"all_steady": stand_in >= 1.0, "minimum": (stand_in >= limits.minimum_steady) & ((stand_in >= 1.0) | F.lit(not limits.reject_if_disturbed)), "worst_case": observed >= 1.0}[limits.policy]
    reason = (
        F.when(F.col("left_id") == F.col("right_id"), "same_evidence")
        .when(F.col("l_id").isNull() | F.col("r_id").isNull(), "unknown_evidence")
        .when(F.concat_ws(" ", "l_kind", "r_kind") != F.coalesce(F.element_at(kinds, F.col("mode")), F.lit("")), "mode_support_mismatch")
        .when(~F.col("l_scope").eqNullSafe(F.col("r_scope")), "scope_mismatch")
        .when(~F.col("l_clock").eqNullSafe(F.col("r_clock")), F.when(F.col("l_clock").isNotNull() & F.col("r_clock").isNotNull(), "clock_mismatch").otherwise("clock_unknown"))
        .when(~F.col("_meets") & (F.col("mode") == "point_point"), "point_tolerance_exceeded")
        .when(~F.col("_meets") & (F.col("mode") == "window_window"), "no_positive_overlap")
        .when(~F.col("_meets") & (F.col("mode") == "event_event"), "event_mismatch")
        .when(~F.col("_meets"), "point_outside_window")
        .when(F.col("classified") < limits.minimum_classified, "classified_below_minimum")
        .when(F.col("equilibrium") < limits.minimum_equilibrium, "equilibrium_below_minimum")
        .when(~F.coalesce(allowed, F.lit(False)), F.when(observed.isNotNull(), "not_steady").otherwise("steadiness_unknown"))
    )
    doubtful = ["same_evidence", "unknown_evidence", "mode_support_mismatch", "scope_mismatch", "clock_mismatch", "clock_unknown", "steadiness_unknown"]
    d = d.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNull(), "eligible").when(F.col("reason").isin(doubtful), "indeterminate").otherwise("ineligible")
    met = F.col("_meets") & ~F.coalesce(F.col("reason").isin(doubtful[:-1]), F.lit(False))
    return d.select(*requests.columns, outcome.alias("outcome"), "reason", *(F.when(met, F.col(n)).alias(n) for n in shares))


def meeting_pairs(left: DataFrame, right: DataFrame, *, tolerance_s: float = 0.0, base_s: float = 60.0, levels: int = 24) -> DataFrame:
    """All pairs (left_id, right_id, mode) of supports of one scope and clock that meet in time or by event id, each once.

    Windows meet in buckets: a window of a length up to base_s 2^k lies in at most two buckets of that size, and is entered at that level and
    all coarser ones; two windows meet at the coarser of their levels, in the bucket that holds the later start. So a long window is
    never dealt into many buckets, and all joins are equi joins. Longer windows than the last level's go to that level's buckets.
    Windows without length meet no window.
    """
    parts = []
    for side, df in (("l", left), ("r", right)):
        d = df.select("id", "scope", "clock", "kind", F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "event_id")
        slack = F.when(F.col("kind") == "point", tolerance_s if side == "l" else 0.0).otherwise(0.0)
        d = d.withColumns({"lo": F.col("start_s") - slack, "hi": F.when(F.col("kind") == "point", F.col("start_s") + slack).otherwise(F.col("end_s"))})
        parts.append(d.select([F.col(c).alias(f"{side}_{c}") for c in d.columns]))

    def timed(d: DataFrame, side: str) -> DataFrame:
        lo, hi = F.col(f"{side}_lo"), F.col(f"{side}_hi")
        own = F.least(F.greatest(F.ceil(F.log2(F.greatest(hi - lo, F.lit(1e-9)) / base_s)), F.lit(0)), F.lit(levels)).cast("int")
        d = d.where((F.col(f"{side}_kind") != "event") & (hi >= lo)).withColumn(f"{side}_level", own).withColumn("level", F.explode(F.sequence(own, F.lit(levels))))
        width = base_s * F.pow(F.lit(2.0), F.col("level"))
        return d.withColumn("bucket", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))

    on = ["level", "bucket", "scope", "clock"]
    a, b = (timed(d, side).withColumnsRenamed({f"{side}_scope": "scope", f"{side}_clock": "clock"}) for d, side in zip(parts, "lr", strict=True))
    p = a.join(b, on).where(F.col("level") == F.greatest("l_level", "r_level"))
    width = base_s * F.pow(F.lit(2.0), F.col("level"))
    p = p.where(F.col("bucket") == F.floor(F.greatest("l_lo", "r_lo") / width)).withColumn("mode", F.concat_ws("_", "l_kind", "r_kind"))
    p = p.where(_meets("l_", "r_", F.col("mode"), tolerance_s)).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "mode")
    events = parts[0].where("l_kind = 'event' AND l_event_id <> ''").join(parts[1].where("r_kind = 'event'"), (F.col("l_event_id") == F.col("r_event_id")) & (F.col("l_scope") == F.col("r_scope")) & (F.col("l_clock") == F.col("r_clock")))
    return p.union(events.select("l_id", "r_id", F.lit("event_event")))


def condition_coverage(conditions: DataFrame, roles: DataFrame, evidence: DataFrame, protocols: DataFrame) -> DataFrame:
    """Per protocol: (protocol, required, passed, passed_conditions, families, satisfied, reason).

    ``conditions`` (protocol, condition, scope, requirement) has a row per requirement of a condition; one with a null requirement asks for
    nothing. ``roles`` (protocol, requirement, id, role); ``evidence`` (id, scope, independent, families: array), a null scope being not a
    single one; ``protocols`` (protocol, minimum_families). A condition passes when each of its requirements has independent
    evidence in the role ``validation`` with the condition's scope (relational division by counts). Reasons: passed, unknown_family where
    a candidate is not independent, else missing_evidence.
    """
    candidates = roles.where("role = 'validation'").select("protocol", "requirement", "id").distinct().join(evidence, "id")
    good = candidates.where("independent")
    met = good.select("protocol", "requirement", "scope").distinct().withColumn("_met", F.lit(1))
    c = conditions.join(met, ["protocol", "requirement", "scope"], "left")
    c = c.groupBy("protocol", "condition").agg(F.bool_and(F.col("requirement").isNull() | F.col("_met").isNotNull()).alias("passes"))
    c = c.groupBy("protocol").agg(F.count("*").alias("required"), F.count_if("passes").alias("passed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("passes"), F.col("condition")))), ",").alias("passed_conditions"))
    names = good.select("protocol", F.explode("families").alias("f")).groupBy("protocol").agg(F.count_distinct("f").alias("families"))
    doubt = candidates.groupBy("protocol").agg((~F.bool_and("independent")).alias("_doubt"))
    out = protocols.join(c, "protocol", "left").join(names, "protocol", "left").join(doubt, "protocol", "left").fillna(0, ["required", "passed", "families"]).fillna("", ["passed_conditions"])
    satisfied = (F.col("passed") == F.col("required")) & (F.col("families") >= F.col("minimum_families"))
    reason = F.when(satisfied, "passed").when(F.coalesce("_doubt", F.lit(False)), "unknown_family").otherwise("missing_evidence")
    return out.select("protocol", "required", "passed", "passed_conditions", "families", satisfied.alias("satisfied"), reason.alias("reason"))


#: Levels of a hypothesis, and of what it says of a component, from none to most.
LEVELS = ["not_assessed", "hypothesized", "experimentally_supported", "validated_for_domain"]


def promote(hypotheses: DataFrame, requirements: DataFrame, support: DataFrame, gates: DataFrame, contradictions: DataFrame, validations: DataFrame) -> DataFrame:
    """Per hypothesis: (hypothesis, supported, required, gates_passed, level, reasons).

    ``hypotheses`` (hypothesis, minimum_support); ``requirements`` (hypothesis, requirement, stage, gate), of which required ones of the stages
    support and support_and_validation count; ``support`` (hypothesis, requirement, id); ``gates`` (hypothesis, kind, gate, satisfied)
    with a row per gate that a hypothesis declares, kinds timescale, amplitude, repeatability and identifiability, a null being not
    satisfied; ``contradictions`` (hypothesis, strong_critical); ``validations`` (hypothesis, satisfied).

    Hypothesized: some requirement is supported and none lacks support. Experimentally supported: besides, as many as ``minimum_support``
    and every gate satisfied. Validated: besides, its validation is satisfied. A strong critical contradiction overrides all.
    """
    need = requirements.where("stage IN ('support', 'support_and_validation') AND gate = 'required'").select("hypothesis", "requirement").distinct()
    has = support.select("hypothesis", "requirement").distinct().withColumn("_has", F.lit(1))
    need = need.join(has, ["hypothesis", "requirement"], "left").groupBy("hypothesis").agg(F.count("*").alias("required"), F.count("_has").alias("supported"))
    kinds = ["timescale", "amplitude", "repeatability", "identifiability"]
    ok = F.coalesce("satisfied", F.lit(False))
    gate = gates.groupBy("hypothesis").agg(F.bool_and(ok).alias("_gates"), F.count_if(ok).alias("gates_passed"), *(F.bool_and(F.when(F.col("kind") == k, ok)).alias(f"_{k}") for k in kinds))
    no = contradictions.groupBy("hypothesis").agg(F.sum("strong_critical").alias("_no"))
    valid = validations.groupBy("hypothesis").agg(F.bool_or("satisfied").alias("_valid"))
    h = hypotheses.join(need, "hypothesis", "left").join(gate, "hypothesis", "left").join(no, "hypothesis", "left").join(valid, "hypothesis", "left")
    h = h.fillna(0, ["required", "supported", "gates_passed", "_no"]).fillna(False, ["_valid"])
    all_supported = F.col("supported") == F.col("required")
    experimental = all_supported & (F.col("supported") >= F.col("minimum_support")) & F.coalesce("_gates", F.lit(True))
    level = F.when(F.col("_no") > 0, "contradicted").when(experimental & F.col("_valid"), LEVELS[3]).when(experimental, LEVELS[2]).when((F.col("supported") > 0) & all_supported, LEVELS[1]).otherwise(LEVELS[0])
    h = h.withColumn("level", level)
    reasons = [F.when(F.col("level") == "contradicted", "critical_contradiction"), F.when(F.col("level") == LEVELS[3], "validation"), *(F.when(F.col(f"_{k}"), k) for k in kinds)]
    return h.select("hypothesis", "supported", "required", "gates_passed", "level", F.concat_ws(",", *reasons).alias("reasons"))


def promote_components(assessed: DataFrame, targets: DataFrame, prior: DataFrame) -> DataFrame:
    """(hypothesis, component, prior, target, status): a component's prior status (hypothesized where unknown) raised to its hypothesis's level
    where that is higher; contradicted and not assessed hypotheses raise nothing."""
    rank = F.create_map(*(F.lit(x) for i, n in enumerate(["phenomenological", *LEVELS[1:]]) for x in (n, i)))
    d = targets.join(assessed.select("hypothesis", "level"), "hypothesis").join(prior, "component", "left")
    d = d.withColumn("prior", F.coalesce("status", F.lit("hypothesized"))).withColumn("target", F.when(F.col("level").isin(LEVELS[1:]), F.col("level")))
    status = F.when(F.element_at(rank, F.col("target")) > F.element_at(rank, F.col("prior")), F.col("target")).otherwise(F.col("prior"))
    return d.select("hypothesis", "component", "prior", "target", status.alias("status"))
