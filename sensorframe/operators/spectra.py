"""Spectrum preparation, scoring of candidate shapes, residual and feature summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ID = "spectrum_id"


def bode(spectra: DataFrame) -> DataFrame:
    """Adds derived magnitude and phase in degrees."""
    return spectra.withColumns({"magnitude": F.hypot("z_re", "z_im"), "phase_deg": F.degrees(F.atan2("z_im", "z_re"))})


def prepare(spectra: DataFrame) -> DataFrame:
    """Finite points of positive frequency of spectra with at least 3: omega, weight and rank by falling frequency."""
    ok = (F.col("freq_hz") > 0) & ~F.isnan("z_re") & ~F.isnan("z_im") & (F.abs("z_re") < float("inf")) & (F.abs("z_im") < float("inf"))
    p = spectra.where(ok).withColumn("_n", F.count("*").over(W.partitionBy(ID))).where("_n >= 3").drop("_n")
    rank = F.row_number().over(W.partitionBy(ID).orderBy(F.desc("freq_hz")))
    return p.withColumns({"omega": 2 * math.pi * F.col("freq_hz"), "weight": F.greatest(F.hypot("z_re", "z_im"), F.lit(1.0)), "rank": rank})


def score_shapes(points: DataFrame, grid: list[tuple[str, float, float]]) -> DataFrame:
    """Every spectrum against every shape s0 + s1 / (1 + (i w tau)^alpha) of a grid of (name, tau, alpha).

    Impedance is linear in both scales, so each (spectrum, shape) needs a few sums and a 2 x 2 solution; the grid is exploded and
    aggregated with partial sums, and no spectrum is gathered. Returns scales, rss over real and imaginary parts, AIC and BIC.
    """
    shapes = F.array(*(F.struct(F.lit(n).alias("shape"), F.lit(t).alias("tau"), F.lit(a).alias("alpha")) for n, t, a in grid))
    g = points.select(ID, "omega", "z_re", "z_im", F.explode(shapes).alias("g")).select(ID, "omega", "z_re", "z_im", "g.*")
    m = F.pow(F.col("omega") * F.col("tau"), F.col("alpha"))
    u, v = 1 + m * F.cos(math.pi / 2 * F.col("alpha")), m * F.sin(math.pi / 2 * F.col("alpha"))
    g = g.withColumns({"a": u / (u * u + v * v), "b": -v / (u * u + v * v)})
    s = g.groupBy(ID, "shape", "tau", "alpha").agg(
        F.count("*").alias("n"), F.sum("a").alias("sa"), F.sum(F.expr("a * a + b * b")).alias("saa"), F.sum("z_re").alias("sy"),
        F.sum(F.expr("a * z_re + b * z_im")).alias("say"), F.sum(F.expr("z_re * z_re + z_im * z_im")).alias("syy"),
    )
    s = s.withColumn("det", F.expr("n * saa - sa * sa")).where("det > 1e-12").withColumn("s1", F.expr("(n * say - sa * sy) / det")).withColumn("s0", F.expr("(sy - s1 * sa) / n"))
    s = s.withColumn("rss", F.greatest(F.expr("syy - s0 * sy - s1 * say"), F.lit(1e-9)))
    return s.withColumns({"aic": F.expr("2 * n * ln(rss / (2 * n)) + 8"), "bic": F.expr("2 * n * ln(rss / (2 * n)) + 4 * ln(2 * n)")}).drop("sa", "saa", "sy", "say", "syy", "det")


def best_shape(scores: DataFrame, criterion: str = "bic") -> DataFrame:
    """The best shape of each spectrum; ties go to the lower rss, then the name, then the smaller tau."""
    w = W.partitionBy(ID).orderBy(criterion, "rss", "shape", "tau", "alpha")
    return scores.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def residuals(points: DataFrame, fits: DataFrame) -> DataFrame:
    """Fitted minus measured, with the fit's shape evaluated at each point."""
    p = points.join(fits.select(ID, "tau", "alpha", "s0", "s1"), ID)
    m = F.pow(F.col("omega") * F.col("tau"), F.col("alpha"))
    u, v = 1 + m * F.cos(math.pi / 2 * F.col("alpha")), m * F.sin(math.pi / 2 * F.col("alpha"))
    p = p.withColumns({"fit_re": F.col("s0") + F.col("s1") * u / (u * u + v * v), "fit_im": -F.col("s1") * v / (u * u + v * v)})
    return p.withColumns({"d_re": F.col("fit_re") - F.col("z_re"), "d_im": F.col("fit_im") - F.col("z_im")})


def fit_metrics(res: DataFrame) -> DataFrame:
    """Weighted errors, plain errors, legacy score and the largest modulus error of each spectrum."""
    sq = F.col("d_re") ** 2 + F.col("d_im") ** 2
    wss = F.sum(sq / F.col("weight") ** 2)
    n = F.count("*")
    return res.groupBy(ID).agg(
        n.alias("n"), wss.alias("weighted_sse"), F.sqrt(wss / (2 * n)).alias("weighted_rmse"), (2 * n * F.log(F.greatest(wss, F.lit(1e-30)) / (2 * n)) + 8).alias("aic_weighted"),
        F.sqrt(F.avg(F.col("d_re") ** 2)).alias("rmse_re"), F.sqrt(F.avg(F.col("d_im") ** 2)).alias("rmse_im"), F.max(F.abs(F.hypot("fit_re", "fit_im") - F.hypot("z_re", "z_im"))).alias("max_modulus_error"),
        F.sum(sq / F.hypot("z_re", "z_im")).alias("legacy_score"), F.avg((F.abs("d_re") + F.abs("d_im")) / 2).alias("mae"),
    )


def residual_summary(res: DataFrame) -> DataFrame:
    """Mean residuals and the bias of the low- and high-frequency halves."""
    half = F.col("rank") <= F.floor(F.count("*").over(W.partitionBy(ID)) / 2)
    r = res.withColumn("high", half)
    return r.groupBy(ID).agg(F.avg("d_re").alias("mean_re"), F.avg("d_im").alias("mean_im"), F.avg(F.when(F.col("high"), F.col("d_re"))).alias("high_bias"), F.avg(F.when(~F.col("high"), F.col("d_re"))).alias("low_bias"))


def initial_features(points: DataFrame) -> DataFrame:
    """Series resistance from the five highest frequencies, the arc's peak and its angular frequency, the low-frequency tail."""
    n = F.count("*").over(W.partitionBy(ID))
    p = points.withColumn("_n", n)
    return p.groupBy(ID).agg(
        F.avg(F.when(F.col("rank") <= 5, F.col("z_re"))).alias("series_resistance"), F.max(-F.col("z_im")).alias("peak"), F.max_by("omega", F.struct(-F.col("z_im"), F.col("omega"))).alias("peak_omega"),
        F.avg(F.when(F.col("rank") > F.col("_n") - 3, -F.col("z_im") * F.sqrt("omega"))).alias("tail_sigma"), (F.max("z_re") - F.min("z_re")).alias("diameter"),
    )


def select_positions(points: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(selected, refused): each spectrum's points at the requested positions (request, position from 1, in ``rank`` order), repeats allowed.

    A spectrum that lacks any requested position is refused whole: refused has its number of points and the first position that is missing.
    """
    sizes = points.groupBy(ID).agg(F.count("*").alias("points"))
    asked = sizes.join(requests.select("request", "position"))  # a request list is a configuration
    bad = asked.where((F.col("position") < 1) | (F.col("position") > F.col("points")) | F.col("position").isNull())
    refused = bad.groupBy(ID).agg(F.first("points").alias("points"), F.min_by(F.coalesce("position", F.lit(0)), "request").alias("position"))
    selected = requests.select("request", "position").join(points.withColumnRenamed("rank", "position"), "position").join(refused.select(ID), ID, "left_anti")
    return selected, refused


def reassign(points: DataFrame, values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(points with ``column`` replaced by position, refused): ``values`` has the spectrum's id, rank and value. Spectra without values stay as they
    are; one whose values are not exactly one for each of its points is refused with both counts and left out."""
    n = points.groupBy(ID).agg(F.count("*").alias("points"), F.max("rank").alias("_last"))
    v = values.groupBy(ID).agg(F.count("*").alias("values"), F.count_distinct("rank").alias("_ranks"), F.min("rank").alias("_low"), F.max("rank").alias("_high"))
    both = n.join(v, ID)
    whole = (F.col("points") == F.col("values")) & (F.col("_ranks") == F.col("values")) & (F.col("_low") == 1) & (F.col("_high") == F.col("_last"))
    refused = both.where(~whole).select(ID, "points", "values")
    out = points.join(refused.select(ID), ID, "left_anti").join(values.withColumnRenamed("value", "_new"), [ID, "rank"], "left")
    return out.withColumn(column, F.coalesce("_new", column)).drop("_new"), refused
