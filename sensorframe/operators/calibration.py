"""Weighted linear calibration, its diagnostics and cross-validation, all from sums per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.operators import linear


def weighted_sums(obs: DataFrame, key: list[str], x: str = "x", y: str = "y", w: str = "w") -> DataFrame:
    """Weighted sums per key, with x and y centred on their plain means for accuracy."""
    m = obs.groupBy(key).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    d = obs.join(m, key).withColumns({"_dx": F.col(x) - F.col("_mx"), "_dy": F.col(y) - F.col("_my"), "_w": F.col(w)})
    return d.groupBy(key).agg(
        F.count("*").alias("n"), F.first("_mx").alias("mx"), F.first("_my").alias("my"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_dx")).alias("wx"), F.sum(F.col("_w") * F.col("_dy")).alias("wy"),
        F.sum(F.col("_w") * F.col("_dx") ** 2).alias("wxx"), F.sum(F.col("_w") * F.col("_dx") * F.col("_dy")).alias("wxy"), F.sum(F.col("_w") * F.col("_dy") ** 2).alias("wyy"),
    )


def solve(sums: DataFrame) -> DataFrame:
    """Adds slope, intercept, weighted rss and standard errors to rows of sums; keys with fewer than 3 points or one x go."""
    det = F.col("w") * F.col("wxx") - F.col("wx") ** 2
    s = sums.where("n >= 3").withColumn("det", det).where("det > 1e-12")
    s = s.withColumn("slope", (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / F.col("det"))
    s = s.withColumn("c0", (F.col("wy") - F.col("slope") * F.col("wx")) / F.col("w"))
    s = s.withColumn("wrss", F.greatest(F.col("wyy") - F.col("slope") * F.col("wxy") - F.col("c0") * F.col("wy"), F.lit(2.220446049250313e-16)))
    s = s.withColumn("intercept", F.col("my") + F.col("c0") - F.col("slope") * F.col("mx"))
    var = F.col("wrss") / (F.col("n") - 2)
    return s.withColumns({"slope_se": F.sqrt(var * F.col("w") / F.col("det")), "intercept_se": F.sqrt(var * (F.col("wxx") - 2 * F.col("mx") * -F.col("wx") + F.col("mx") ** 2 * F.col("w")) / F.col("det"))})


def influence(obs: DataFrame, fits: DataFrame, key: list[str]) -> DataFrame:
    """Leverage, residual and Cook's distance of each observation."""
    d = obs.join(fits, key)
    xbar = F.col("mx") + F.col("wx") / F.col("w_sum")
    lever = F.col("w_obs") * (1 / F.col("w_sum") + (F.col("x") - xbar) ** 2 * F.col("w_sum") / F.col("det"))
    r = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    s2 = F.col("wrss") / (F.col("n") - 2)
    return d.withColumns({"residual": r, "leverage": lever}).withColumn("cook", F.when(F.col("leverage") < 1, F.col("w_obs") * F.col("residual") ** 2 / (2 * s2) * F.col("leverage") / (1 - F.col("leverage")) ** 2))


def cross_validate(obs: DataFrame, key: list[str], fold: list[str]) -> DataFrame:
    """Each fold predicted by the line of the others: training sums are the totals less the fold's own, so nothing is refitted.

    Unweighted; folds whose training rows number under 3 or have one x are left out. Adds ``predicted`` and ``error``.
    """
    m = obs.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d = obs.join(m, key).withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})
    terms = {"n": F.lit(1.0), "sx": F.col("dx"), "sy": F.col("dy"), "sxx": F.col("dx") ** 2, "sxy": F.col("dx") * F.col("dy")}
    own = d.groupBy(*key, *fold).agg(*(F.sum(t).alias(f"f_{c}") for c, t in terms.items()))
    total = d.groupBy(key).agg(*(F.sum(t).alias(f"t_{c}") for c, t in terms.items()))
    t = own.join(total, key).select(*key, *fold, *((F.col(f"t_{c}") - F.col(f"f_{c}")).alias(c) for c in terms))
    t = t.withColumn("det", F.col("n") * F.col("sxx") - F.col("sx") ** 2).where("n >= 3 AND det > 1e-12")
    t = t.withColumn("slope", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.col("det")).withColumn("_c0", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))
    p = d.join(t.select(*key, *fold, "slope", "_c0"), [*key, *fold])
    return p.withColumn("predicted", F.col("my") + F.col("_c0") + F.col("slope") * F.col("dx")).withColumn("error", F.col("y") - F.col("predicted"))


def fit_calibrations(rows: DataFrame, key: list[str], level: list[str], criterion: str = "aicc") -> DataFrame:
    """All candidate models of every calibration, validated by leaving one concentration level out, scored, and one selected.

    ``rows`` are observations exploded by :func:`sensorframe.operators.linear.expand`; they are summed once for all fits and folds."""
    return linear.choose(linear.fit_and_validate(rows, key, level), key, criterion)


def selected_intervals(rows: DataFrame, fits: DataFrame, key: list[str], block: Column, order: list[str], *, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Bootstrap intervals of each calibration's selected model; see :func:`sensorframe.operators.linear.bootstrap`."""
    best = fits.where("selected")
    out = linear.bootstrap(rows, best, key, block, order, replicates=replicates, seed=seed)
    return out.join(best.select(*key, "model"), key).select(*key, "model", "succeeded", *(f"{c}_{end}" for c in ("intercept", "b1", "b2") for end in ("lower", "upper")))
