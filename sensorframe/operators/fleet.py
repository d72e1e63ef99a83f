"""Fleet baselines, deviation scores, three-valued rules and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def baseline(features: DataFrame, key: list[str]) -> DataFrame:
    """Distribution of each feature over the baseline's records."""
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    b = features.groupBy(key).agg(F.count("value").alias("records"), F.avg("value").alias("b_mean"), F.stddev_samp("value").alias("b_sd"), q.alias("_q"), F.min("value").alias("b_min"), F.max("value").alias("b_max"))
    mad = features.join(b.select(*key, F.col("_q")[1].alias("_m")), key).groupBy(key).agg(F.percentile(F.abs(F.col("value") - F.col("_m")), F.lit(0.5)).alias("b_mad"))
    return b.join(mad, key).select("*", F.col("_q")[0].alias("b_q1"), F.col("_q")[1].alias("b_median"), F.col("_q")[2].alias("b_q3")).drop("_q")


RANGES = 256


def empirical_share(current: DataFrame, reference: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """Adds to (key, value) rows ``share``: the part of the reference values of the key that are at or below each, for keys of ``base``.

    Equal values are counted first. Approximate quantiles of the different values cut each key into about ``RANGES`` ranges of as many values,
    however far apart they lie; running counts are taken inside a range and over a key's ranges, so no task or cell holds all values of a key.
    """
    counts = reference.where(F.col("value").isNotNull()).groupBy(*key, "value").agg(F.count("*").alias("_n"))
    shares = F.array(*(F.lit(i / RANGES) for i in range(1, RANGES)))
    cuts = counts.groupBy(key).agg(F.percentile_approx("value", shares, 4 * RANGES).alias("_cuts"))
    asked = current.join(base.select(key), key, "left_semi").select(*key, "value").where(F.col("value").isNotNull()).distinct().withColumn("_n", F.lit(0).cast("long"))
    where = F.size(F.filter("_cuts", lambda c: c < F.col("value"))).alias("_range")
    rows = counts.unionByName(asked).join(cuts, key).select(*key, "value", "_n", where)
    per = rows.groupBy(*key, "_range").agg(F.sum("_n").alias("_in"))
    before = per.select(*key, "_range", (F.sum("_in").over(W.partitionBy(key).orderBy("_range")) - F.col("_in")).alias("_before"), F.sum("_in").over(W.partitionBy(key)).alias("_all"))
    run = F.sum("_n").over(W.partitionBy(*key, "_range").orderBy("value").rangeBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_run", run).join(before, [*key, "_range"]).groupBy(*key, "value").agg(F.max((F.col("_before") + F.col("_run")) / F.col("_all")).alias("share"))
    return current.join(rows, [*key, "value"], "left")


def deviations(current: DataFrame, reference: DataFrame, key: list[str], least_records: int = 3) -> DataFrame:
    """Absolute, relative, log, z, robust z, empirical share and range position of each current value, against the distribution
    of the reference values."""
    base = baseline(reference, key)
    d = empirical_share(current, reference, base, key).join(base, key)
    v, enough = F.col("value"), F.col("records") >= least_records
    return d.withColumns({
        "absolute": v - F.col("b_median"), "relative": F.when(F.col("b_median") != 0, (v - F.col("b_median")) / F.col("b_median")),
        "log_ratio": F.when((v > 0) & (F.col("b_median") > 0), F.log(v / F.col("b_median"))), "z": F.when(enough & (F.col("b_sd") > 0), (v - F.col("b_mean")) / F.col("b_sd")),
        "robust_z": F.when(enough & (F.col("b_mad") > 0), (v - F.col("b_median")) / (1.4826 * F.col("b_mad"))),
        "position": F.when(F.col("b_max") > F.col("b_min"), (v - F.col("b_min")) / (F.col("b_max") - F.col("b_min"))),
    })


def severity(value: Column, watch: float, degraded: float, critical: float) -> Column:
    """0 fine, 1 watch, 2 degraded, 3 critical; null for a missing value."""
    return F.when(value >= critical, 3).when(value >= degraded, 2).when(value >= watch, 1).when(value.isNotNull(), 0)


def rules(conditions: DataFrame, record: str, rule: str) -> DataFrame:
    """Three-valued rule per record from rows (part: all | any | none, holds: nullable boolean, domain).

    True if all ``all`` hold, one ``any`` holds (or there is none) and no ``none`` holds; false if a part fails for certain;
    otherwise unavailable.
    """

    def part(p: str, test: Column) -> Column:
        return F.count_if((F.col("part") == p) & test)

    yes, no, unknown = F.col("holds"), ~F.col("holds"), F.col("holds").isNull()
    g = conditions.groupBy(record, rule).agg(
        part("all", no).alias("a_no"), part("all", unknown).alias("a_un"), part("any", yes).alias("y_yes"), part("any", unknown).alias("y_un"), F.count_if(F.col("part") == "any").alias("y_n"),
        part("none", yes).alias("n_yes"), part("none", unknown).alias("n_un"), F.count_distinct(F.when(F.col("holds"), F.col("domain"))).alias("domains"),
    )
    fails = (F.col("a_no") > 0) | (F.col("n_yes") > 0) | ((F.col("y_n") > 0) & (F.col("y_yes") == 0) & (F.col("y_un") == 0))
    holds = (F.col("a_un") == 0) & (F.col("n_un") == 0) & ((F.col("y_n") == 0) | (F.col("y_yes") > 0))
    return g.select(record, rule, F.when(fails, "false").when(holds, "true").otherwise("unavailable").alias("outcome"), "domains")
