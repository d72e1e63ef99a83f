"""Assessments with limits as arguments: comparability, quality gates, dimension scores, trend rules, predictions, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNKS = 64


def content_digest(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """A SHA-256 per key over all its rows' ``order`` (integer) and ``columns``: numbers count to a millionth, nulls as such.

    Rows are dealt by ``order`` into ``CHUNKS`` parts that are digested each in order; the digest of a key is that of its parts'
    digests. The same rows in another order or partitioning give the same digest.
    """

    def text(c: str) -> Column:
        exact = rows.schema[c].dataType.typeName() not in ("double", "float")
        shown = F.col(c).cast("string") if exact else F.floor(F.col(c) * 1e6 + 0.5).cast("long").cast("string")
        return F.coalesce(shown, F.lit("null"))

    line = F.concat_ws("|", F.lpad(F.col(order).cast("string"), 19, "0"), *map(text, columns))
    parts = rows.groupBy(*key, F.pmod(order, F.lit(CHUNKS)).alias("_chunk")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("_part"))
    whole = F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "_part"))), lambda x: x["_part"])
    return parts.groupBy(key).agg(F.sha2(F.array_join(whole, "\n"), 256).alias("digest"))


def part_conflicts(rows: DataFrame, key: list[str], time: str = "t_s", value: str = "value", order: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): of rows with one key, time and value the first by ``order`` stays; all rows of a time that has different
    values go to quarantine."""
    once = rows.groupBy(*key, time, value).agg(F.min(order).alias(order))
    told = once.groupBy(*key, time).agg((F.count("*") > 1).alias("_conflict"))
    quarantined = rows.join(told.where("_conflict"), [*key, time], "left_semi")
    return once.join(told.where("_conflict"), [*key, time], "left_anti"), quarantined


def comparability(pairs: DataFrame, same: dict[str, str], tolerance: float, last: dict[str, str] | None = None, degrees: str = "temperature_k") -> DataFrame:
    """Adds ``comparability`` and ``reason``: a row has the current context in its columns and the baseline's in ``b_`` columns.

    Columns of ``same`` must be equal (two nulls are), then temperatures known on both sides must differ by ``tolerance`` at most,
    then columns of ``last`` must be equal; the first that fails names its reason. Temperatures that differ within the tolerance
    give comparable_with_warnings.
    """
    gap = F.abs(F.col(degrees) - F.col(f"b_{degrees}"))
    reason = F.lit(None).cast("string")
    tests = [(~F.col(c).eqNullSafe(F.col(f"b_{c}")), why) for c, why in same.items()] + [(F.coalesce(gap > tolerance, F.lit(False)), "temperature")]
    tests += [(~F.col(c).eqNullSafe(F.col(f"b_{c}")), why) for c, why in (last or {}).items()]
    for fails, why in reversed(tests):
        reason = F.when(fails, why).otherwise(reason)
    near = F.coalesce(gap > 0, F.lit(False))
    return pairs.withColumn("_fails", reason).withColumns({
        "comparability": F.when(F.col("_fails").isNotNull(), "not_comparable").when(near, "comparable_with_warnings").otherwise("comparable"),
        "reason": F.coalesce("_fails", F.when(near, "temperature within tolerance")),
    }).drop("_fails")


def quality_gate(summary: DataFrame, *, least_samples: int, most_missing: float, most_cv: float, most_duplicates: int, most_backward: int, most_gap: float | None = None) -> DataFrame:
    """Adds ``state`` (adequate, poor or indeterminate) and ``reason`` to rows of n, missing_share, dt_cv, duplicates, backward, dt_max.

    A missing share or spread of intervals that is null is absent, one that is not finite invalid; any limit passed is poor. Without
    ``most_gap`` gaps of any length are allowed.
    """
    need = ("missing_share", "dt_cv")
    absent = F.greatest(*(F.col(c).isNull().cast("int") for c in need)) == 1
    invalid = F.greatest(*((F.isnan(c) | (F.abs(c) == float("inf"))).cast("int") for c in need)) == 1
    bad = (F.col("n") < least_samples) | (F.col("missing_share") > most_missing) | (F.col("dt_cv") > most_cv) | (F.col("duplicates") > most_duplicates) | (F.col("backward") > most_backward)
    if most_gap is not None:
        bad = bad | F.coalesce(F.col("dt_max") > most_gap, F.lit(False))
    state = F.when(absent, F.lit("poor")).when(invalid, "indeterminate").when(bad, "poor").otherwise("adequate")
    reason = F.when(absent, F.lit("absent")).when(invalid, "invalid").when(bad, "limit").otherwise("within")
    return summary.withColumns({"state": state, "reason": reason})


def dimension_scores(metrics: DataFrame, thresholds: DataFrame, record: list[str]) -> DataFrame:
    """Per record and dimension the worst level (0 fine to 3 critical) of its metrics, the metric that is worst and what is absent.

    ``metrics`` is long (record, metric, value); ``thresholds`` (dimension, metric, watch, degraded, critical) lists every metric that
    a dimension needs, also those of which a record has no row. A dimension with nothing known has a null level.
    """
    wanted = metrics.select(record).distinct().join(thresholds)
    m = wanted.join(metrics, [*record, "metric"], "left")
    level = F.when(F.col("value") >= F.col("critical"), 3).when(F.col("value") >= F.col("degraded"), 2).when(F.col("value") >= F.col("watch"), 1).when(F.col("value").isNotNull(), 0)
    m = m.withColumn("_level", level)
    g = m.groupBy(*record, "dimension").agg(F.max("_level").alias("level"), F.min(F.when(F.col("_level").isNotNull(), F.struct(-F.col("_level"), F.col("metric").alias("metric")))).alias("_worst"), F.count_if(F.col("_level").isNull()).alias("absent"))
    return g.select(*record, "dimension", "level", F.col("_worst.metric").alias("worst"), "absent")


def trend_rules(conditions: DataFrame, record: list[str], needed_domains: int) -> DataFrame:
    """Rules over feature trends, per record and rule: (triggered, confidence, satisfied, contradicted, unavailable, domains).

    ``conditions`` has a row per condition: part (all or any), slope, sign (1 rising, -1 falling), threshold and domain. A condition
    without a slope is unavailable. A rule triggers when all of ``all`` and one of ``any`` (where it has some) hold, nothing is
    unavailable and the conditions that hold are of ``needed_domains`` domains; three domains make confidence high, else moderate,
    and a condition that does not hold lowers it one step.
    """
    c = conditions.withColumn("_holds", F.col("sign") * F.col("slope") > F.col("threshold"))
    g = c.groupBy(*record, "rule").agg(
        F.count_if("_holds").alias("satisfied"), F.count_if(~F.col("_holds")).alias("contradicted"), F.count_if(F.col("_holds").isNull()).alias("unavailable"),
        F.count_distinct(F.when(F.col("_holds"), F.col("domain"))).alias("domains"), F.count_if((F.col("part") == "all") & ~F.coalesce("_holds", F.lit(False))).alias("_missed"),
        F.count_if(F.col("part") == "any").alias("_any"), F.count_if((F.col("part") == "any") & F.coalesce("_holds", F.lit(False))).alias("_one"),
    )
    g = g.withColumn("triggered", (F.col("_missed") == 0) & ((F.col("_any") == 0) | (F.col("_one") > 0)) & (F.col("unavailable") == 0) & (F.col("domains") >= needed_domains))
    grade = F.when(F.col("domains") >= 3, 3).otherwise(2) - F.when(F.col("contradicted") > 0, 1).otherwise(0)
    return g.withColumn("confidence", F.when(~F.col("triggered"), "insufficient").when(grade == 3, "high").when(grade == 2, "moderate").otherwise("low")).drop("_missed", "_any", "_one")


def line_models(observations: DataFrame, key: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Least-squares lines per key with what predictions need: n, e0, slope, rmse, x_mean, sxx, x_min, x_max; three points at least."""
    o = observations.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = o.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("_my"), (F.var_pop(x) * F.count("*")).alias("sxx"), (F.covar_pop(x, y) * F.count("*")).alias("_sxy"),
        (F.var_pop(y) * F.count("*")).alias("_syy"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
    ).where("n >= 3 AND sxx > 0")
    g = g.withColumn("slope", F.col("_sxy") / F.col("sxx"))
    rss = F.greatest(F.lit(0.0), F.col("_syy") - F.col("slope") * F.col("_sxy"))
    return g.select(*key, "n", (F.col("_my") - F.col("slope") * F.col("x_mean")).alias("e0"), "slope", F.sqrt(rss / F.col("n")).alias("rmse"), "x_mean", "sxx", "x_min", "x_max")


def _beyond(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.col("x_min") - x, x - F.col("x_max"))


def predict_potential(inputs: DataFrame, models: DataFrame, key: list[str], activity: str = "activity") -> DataFrame:
    """Adds potential, its standard error on the line, distance beyond the calibrated range of log10 activity and a reason: inputs
    without a model, or an activity that is not positive, have no potential."""
    d = inputs.join(models, key, "left")
    a = F.col(activity)
    x = F.when((a > 0) & (a < float("inf")), F.log10(a))
    error = F.col("rmse") * F.sqrt(1 / F.col("n") + F.pow(x - F.col("x_mean"), 2) / F.col("sxx"))
    reason = F.when(F.col("slope").isNull(), "model").when(x.isNull(), "activity").when(_beyond(x) > 0, "extrapolated")
    return d.select(*inputs.columns, (F.col("e0") + F.col("slope") * x).alias("potential"), error.alias("potential_se"), _beyond(x).alias("distance"), reason.alias("reason"))


DIGITS = 307  # powers of ten that a double holds


def predict_activity(inputs: DataFrame, models: DataFrame, key: list[str], potential: str = "potential", z: float = 1.96) -> DataFrame:
    """Adds activity and its interval (``z`` residual errors through the slope), their log10, the distance beyond the calibrated range
    and a reason. An activity that no double holds is null (not_finite); its log10 stays."""
    d = inputs.join(models, key, "left")
    v = F.col(potential)
    x = F.when(F.col("slope") != 0, (v - F.col("e0")) / F.col("slope"))
    half = z * F.col("rmse") / F.abs("slope")
    reason = F.when(F.col("slope").isNull(), "model").when(v.isNull() | F.isnan(v), "potential").when(x.isNull(), "slope").when(F.abs(x) >= DIGITS, "not_finite").when(_beyond(x) > 0, "extrapolated")
    ends = {"": x, "_lower": x - half, "_upper": x + half}
    held = [F.when(F.abs(e) < DIGITS, F.pow(F.lit(10.0), e)).alias(f"activity{n}") for n, e in ends.items()]
    return d.select(*inputs.columns, *held, *(e.alias(f"log10_activity{n}") for n, e in ends.items()), _beyond(x).alias("distance"), reason.alias("reason"))


def component_levels(evidence: DataFrame, definitions: DataFrame) -> DataFrame:
    """Level of each hypothesis (hypothesis, least_replicates) from evidence rows (hypothesis, role: supports | contradicts |
    missing, replicate): contradictory, weak below the replicates or with something missing, insufficient without support, else
    moderate; never more."""
    g = evidence.groupBy("hypothesis").agg(
        F.count_if(F.col("role") == "supports").alias("supporting"), F.count_if(F.col("role") == "contradicts").alias("contradicting"),
        F.count_if(F.col("role") == "missing").alias("missing"), F.count_distinct(F.when(F.col("role") == "supports", F.col("replicate"))).alias("replicates"),
    )
    d = definitions.join(g, "hypothesis", "left").fillna(0, ["supporting", "contradicting", "missing", "replicates"])
    level = F.when(F.col("contradicting") > 0, "contradictory").when((F.col("missing") > 0) | (F.col("replicates") < F.col("least_replicates")), "weak").when(F.col("supporting") == 0, "insufficient").otherwise("moderate")
    return d.select("hypothesis", "supporting", "contradicting", "missing", "replicates", level.alias("level"))


def priors(results: DataFrame, mapping: DataFrame, key: list[str]) -> DataFrame:
    """Prior values by a mapping table (source, path, component, parameter): one row per key and mapped parameter, null where no
    result has the path. ``results`` has key, source, path and value."""
    wanted = results.select(key).distinct().join(mapping)
    return wanted.join(results, [*key, "source", "path"], "left").select(*key, "component", "parameter", "value")


#: Operators of a rule's condition on a feature, what they read, and when they hold for a threshold ``v``.
OPERATORS = {
    "greater_than": lambda v: F.col("value") > v, "less_than": lambda v: F.col("value") < v,
    "relative_increase": lambda v: F.col("relative") > v, "relative_decrease": lambda v: F.col("relative") < -v,
    "log_ratio": lambda v: F.abs("log_ratio") > v, "robust_z": lambda v: F.abs("robust_z") > v,
    "warning_present": lambda v: F.when(F.col("_found"), F.col("warning").isNotNull()), "level_present": lambda v: F.when(F.col("_found"), F.col("value").isNotNull()),
    "trend_increasing": lambda v: F.col("slope") > F.coalesce(v, F.lit(0.0)), "trend_decreasing": lambda v: F.col("slope") < -F.coalesce(v, F.lit(0.0)),
}
#: Operators that compare with a baseline.
AGAINST_BASELINE = ["relative_increase", "relative_decrease", "log_ratio", "robust_z"]
#: Domains of features without a row, by how their names begin; then by ``drift`` in the name, else data_quality.
DOMAINS = {"transient": "dynamic_response", "calibration": "calibration", "eis": "impedance", "mechanism": "mechanism_evidence"}


def evaluate_rules(
    rules: DataFrame, conditions: DataFrame, features: DataFrame, comparisons: DataFrame, record: list[str], *, trends: DataFrame | None = None,
    baselines: DataFrame | None = None, mechanistic_domains: int = 2,
) -> DataFrame:
    """Every rule for every record of ``features``: (record, rule, triggered, confidence, severity, satisfied, contradicted, unavailable, domains).

    ``rules``: rule, severity, mechanistic, minimum_domains, minimum_records. ``conditions``: rule, part (all or any), feature, operator (one of
    ``OPERATORS``), threshold. ``features``: record, feature, value, warning, domain, one row a feature. ``comparisons``: record, feature,
    relative, log_ratio, robust_z, records (of its baseline). ``baselines``: record, records; ``trends``: record, feature, slope.

    A condition holds, does not hold, or is unavailable where what it reads is not there. A rule triggers when all its ``all`` conditions and
    one of its ``any`` conditions (where it has some) hold, none is unavailable, and those that hold are of as many domains as it needs
    (mechanistic rules: ``mechanistic_domains`` at least). Confidence is high from three domains on, else moderate.

    Without ``trends`` a rule needs ``minimum_records`` records in the record's baseline, one unavailable item where it has fewer, and trends are
    features named ``trend.<feature>`` that are over or under 0. With ``trends`` each comparison with a baseline of fewer records is
    unavailable by itself, slopes are held against the threshold, features without a row have a domain by their name, and a
    condition that does not hold lowers confidence one step.
    """
    if trends is None:
        trends = features.where("feature LIKE 'trend.%'").select(*record, F.expr("substring(feature, 7)").alias("feature"), F.col("value").alias("slope"))
        longitudinal = False
    else:
        longitudinal = True
    listed = conditions.join(rules, "rule")  # a configuration: as many rows as its rules have conditions
    asked = features.select(record).distinct().join(listed)
    on = [*record, "feature"]
    c = asked.join(features.select(*on, "value", "warning", "domain", F.lit(True).alias("_found")), on, "left")
    c = c.join(comparisons.select(*on, "relative", "log_ratio", "robust_z", F.col("records").alias("_compared")), on, "left").join(trends.select(*on, "slope"), on, "left")
    v = F.col("threshold") if longitudinal else F.when(F.col("operator").startswith("trend_"), 0.0).otherwise(F.col("threshold"))
    holds = F.lit(None).cast("boolean")
    for name, test in OPERATORS.items():
        holds = F.when(F.col("operator") == name, test(v)).otherwise(holds)
    if longitudinal:
        short = F.col("operator").isin(AGAINST_BASELINE) & (F.col("minimum_records") > 0) & ~F.coalesce(F.col("_compared") >= F.col("minimum_records"), F.lit(False))
        holds = F.when(~short, holds)
        domain = F.when(F.col("feature").contains("drift"), "drift").otherwise("data_quality")
        for start, name in DOMAINS.items():
            domain = F.when(F.col("feature").startswith(start), name).otherwise(domain)
        c = c.withColumn("domain", F.coalesce("domain", domain))
    c = c.withColumn("_holds", holds)
    g = c.groupBy(*record, "rule").agg(
        F.count_if("_holds").alias("satisfied"), F.count_if(~F.col("_holds")).alias("contradicted"), F.count_if(F.col("_holds").isNull()).alias("unavailable"),
        F.count_distinct(F.when(F.col("_holds"), F.col("domain"))).alias("domains"), F.count_if((F.col("part") == "all") & ~F.coalesce("_holds", F.lit(False))).alias("_missed"),
        F.count_if(F.col("part") == "any").alias("_any"), F.count_if((F.col("part") == "any") & F.coalesce("_holds", F.lit(False))).alias("_one"),
        *(F.first(x).alias(x) for x in ("severity", "mechanistic", "minimum_domains", "minimum_records")),
    )
    if not longitudinal:
        g = g.join(baselines.select(*record, "records"), record, "left") if baselines is not None else g.withColumn("records", F.lit(0))
        g = g.withColumn("unavailable", F.col("unavailable") + F.when(F.coalesce("records", F.lit(0)) < F.col("minimum_records"), 1).otherwise(0))
    needed = F.greatest("minimum_domains", F.when(F.col("mechanistic"), mechanistic_domains).otherwise(0))
    g = g.withColumn("triggered", (F.col("_missed") == 0) & ((F.col("_any") == 0) | (F.col("_one") > 0)) & (F.col("unavailable") == 0) & (F.col("domains") >= needed))
    grade = F.when(F.col("domains") >= 3, 3).otherwise(2) - (F.when(F.col("contradicted") > 0, 1).otherwise(0) if longitudinal else F.lit(0))
    confidence = F.when(~F.col("triggered"), "insufficient").when(grade == 3, "high").when(grade == 2, "moderate").otherwise("low")
    return g.select(*record, "rule", "triggered", confidence.alias("confidence"), "severity", "satisfied", "contradicted", "unavailable", "domains")
