"""Characteristic timescales of fitted circuits, with their uncertainty and where they lie in the measured band."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements whose second parameter is a time constant.
DIRECT = ["Wo", "Ws", "G", "Gs", "K", "Zarc"]
#: Standard normal quantiles by confidence, from the highest on.
Z = ((0.99, 2.576), (0.95, 1.96), (0.0, 1.645))


def circuit_timescales(topology: DataFrame, fits: DataFrame, parameters: DataFrame, covariance: DataFrame, *, margin: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """All timescales of all fits: (record, timescale, kind, value_s, se_s, ci_low_s, ci_high_s, validity, warnings).

    ``topology``: circuit, element, kind and parallel, the parallel group whose direct branch an element is (null in series). ``fits``: record,
    circuit, f_min, f_max. ``parameters``: record, element, slot (from 0), value. ``covariance``: record, element, slot, other, other_slot,
    covariance, both ways for two different parameters; a record without rows has no standard errors.

    A timescale is the second parameter of a ``DIRECT`` element, R C of each resistor and capacitor that are branches of one parallel group, and
    (R Q)^(1 / alpha) of a resistor and a constant-phase element. Values that are not positive, and alphas outside (0, 1], give
    none. Standard errors are by the delta method. Warnings: outside_band and band_edge, by the characteristic frequency 1 / (2 pi tau)
    against the measured band and ``margin`` of its width, and missing_covariance for pairs.
    """
    p = parameters.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select("record", "element", "slot", "value")
    e = fits.select("record", "circuit").join(topology, "circuit").select("record", "element", "kind", "parallel")
    c = F.col
    own = e.where(c("kind").isin(DIRECT)).join(p.where("slot = 1 AND value > 0"), ["record", "element"])
    gradient = F.array(F.struct("element", F.lit(1).alias("slot"), F.lit(1.0).alias("g")))
    direct = own.select("record", F.concat_ws("/", "element", F.lit("direct")).alias("timescale"), "kind", c("value").alias("value_s"), gradient.alias("gradient"))

    branch = e.where("parallel IS NOT NULL")
    r = branch.where("kind = 'R'").join(p.where("slot = 0 AND value > 0"), ["record", "element"]).select("record", "parallel", c("element").alias("r_el"), c("value").alias("r"))
    q = branch.where("kind IN ('C', 'CPE')").join(p.where("slot = 0 AND value > 0"), ["record", "element"]).select("record", "parallel", c("element").alias("c_el"), "kind", c("value").alias("q"))
    alpha = p.where("slot = 1").select("record", c("element").alias("c_el"), c("value").alias("alpha"))
    pairs = r.join(q, ["record", "parallel"]).join(alpha, ["record", "c_el"], "left").withColumn("alpha", F.when(c("kind") == "C", 1.0).otherwise(c("alpha"))).where("alpha > 0 AND alpha <= 1")
    pairs = pairs.withColumn("value_s", F.pow(c("r") * c("q"), 1 / c("alpha"))).where("value_s > 0 AND value_s < double('infinity')")
    parts = F.array(
        F.struct(c("r_el").alias("element"), F.lit(0).alias("slot"), (c("value_s") / (c("alpha") * c("r"))).alias("g")), F.struct(c("c_el").alias("element"), F.lit(0).alias("slot"), (c("value_s") / (c("alpha") * c("q"))).alias("g")),
        F.when(c("kind") == "CPE", F.struct(c("c_el").alias("element"), F.lit(1).alias("slot"), (-c("value_s") * F.log(c("r") * c("q")) / (c("alpha") * c("alpha"))).alias("g"))),
    )
    both = pairs.select("record", F.concat_ws("/", "parallel", "r_el", "c_el").alias("timescale"), F.concat(F.lit("R-"), "kind").alias("kind"), "value_s", F.array_compact(parts).alias("gradient"))

    found = direct.unionByName(both)
    g = found.select("record", "timescale", F.explode("gradient").alias("x")).select("record", "timescale", "x.*")
    other = g.select("record", "timescale", c("element").alias("other"), c("slot").alias("other_slot"), c("g").alias("other_g"))
    v = g.join(covariance.select("record", "element", "slot", "other", "other_slot", "covariance"), ["record", "element", "slot"]).join(other, ["record", "timescale", "other", "other_slot"])
    v = v.groupBy("record", "timescale").agg(F.sum(c("g") * c("covariance") * c("other_g")).alias("_v"))
    known = covariance.select("record").distinct().withColumn("_known", F.lit(True))
    out = found.join(v, ["record", "timescale"], "left").join(known, "record", "left").join(fits.select("record", "f_min", "f_max"), "record")
    f, width = 1 / (2 * math.pi * c("value_s")), F.greatest(c("f_max") - c("f_min"), F.lit(2.2250738585072014e-308))
    outside = (f < c("f_min")) | (f > c("f_max"))
    edge = ((f - c("f_min")) / width < margin) | ((c("f_max") - f) / width < margin)
    told = F.concat_ws(",", F.when(outside, "outside_band").when(edge, "band_edge"), F.when(c("_known").isNull() & c("kind").startswith("R-"), "missing_covariance"))
    out = out.withColumns({"se_s": F.when(c("_v") >= 0, F.sqrt("_v")), "warnings": told})
    z = next(z for least, z in Z if confidence >= least)
    return out.select(
        "record", "timescale", "kind", "value_s", "se_s", (c("value_s") - z * c("se_s")).alias("ci_low_s"), (c("value_s") + z * c("se_s")).alias("ci_high_s"),
        F.when(c("warnings") == "", "valid").otherwise("valid_with_warnings").alias("validity"), "warnings",
    )
