"""Model fits against numpy, and planted responses, topologies of evidence and lineages against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import assess, evidence, kramers_kronig, linear, lineage, transient

KEY = ["k"]


def test_fits_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(4):
        for i in range(30):
            a, b, c = rng.normal(size=3) + [5, 0, 1]
            rows.append((k, i, i % 6, float(a), float(b), float(c), float(2 + 3 * a - b + 0.5 * c + rng.normal() * 0.1), float(rng.uniform(0.5, 2))))
    rows += [(9, i, i, 1.0, 2.0, 3.0, 4.0, 1.0) for i in range(5)] + [(0, 99, 0, None, 1.0, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, i int, level int, a double, b double, c double, y double, w double")
    models = [linear.Model("none"), linear.Model("one", ("a",), offset="2 * b"), linear.Model("prior", ("a",), prior=(1.0, 0.05)), linear.Model("three", ("a", "b", "c"))]
    ex = linear.expand(df, models, "y", "w", ["k", "i", "level"])
    got = {(r.k, r.model): r for r in linear.fit_and_validate(ex, KEY, ["level"]).collect()}
    for k in range(4):
        d = np.array([r[3:] for r in rows if r[0] == k and r[3] is not None])
        level = np.array([r[2] for r in rows if r[0] == k and r[3] is not None])
        designs = {"none": ([], d[:, 3]), "one": ([0], d[:, 3] - 2 * d[:, 1]), "prior": ([0], d[:, 3]), "three": ([0, 1, 2], d[:, 3])}
        for name, (cols, t) in designs.items():
            x, w = np.column_stack([np.ones(len(d)), d[:, cols]]), np.sqrt(d[:, 4])

            def solved(keep):
                xs, ts = (x * w[:, None])[keep], (t * w)[keep]
                if name == "prior":
                    xs, ts = np.vstack([xs, [0, 20.0]]), np.append(ts, 20.0)
                return np.linalg.lstsq(xs, ts, rcond=None)[0], xs, ts

            beta, xs, ts = solved(np.ones(len(d), bool))
            r = got[k, name]
            assert np.allclose([r.intercept, *(r[f"b{j + 1}"] for j in range(len(cols)))], beta)
            s2 = np.sum((ts - xs @ beta) ** 2) / (len(ts) - x.shape[1])
            assert np.allclose([r.intercept_se, *(r[f"b{j + 1}_se"] for j in range(len(cols)))], np.sqrt(np.diag(s2 * np.linalg.inv(xs.T @ xs))))
            assert np.isclose(r.rss, np.sum((t - x @ beta) ** 2)) and r.n == 30 and r.parameters == x.shape[1]
            errors = np.concatenate([x[level == f] @ solved(level != f)[0] - t[level == f] for f in range(6)])
            assert np.isclose(r.cv_rmse, np.sqrt(np.mean(errors**2))) and np.isclose(r.cv_bias, errors.mean()) and (r.cv_n, r.cv_failed) == (30, 0)
    assert got[9, "none"].intercept == 4.0 and got[9, "one"].intercept is None and got[9, "three"].b1 is None and got[9, "one"].cv_failed == 5


def test_names_that_clash_are_told(spark):
    with pytest.raises(ValueError, match="intercept"):
        linear.expand(spark.createDataFrame([(1, 1.0, 1.0)], "intercept int, y double, w double"), [linear.Model("none")], "y", "w", ["intercept"])
    with pytest.raises(ValueError, match="beta"):
        transient.fit_responses(spark.createDataFrame([(1, 1.0, 1.0)], "beta int, local double, v double"), ["beta"])


def test_choice_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i % 3)) for i in range(12)], "k int, level int, x double, y double").withColumn("w", F.lit(1.0))
    ex = linear.expand(df, [linear.Model("first", ("x",)), linear.Model("again", ("x",))], "y", "w", ["k", "level"])
    got = linear.choose(linear.fit(ex, KEY).withColumn("cv_rmse", F.lit(1.0)), KEY).collect()
    assert {r.model: r.selected for r in got} == {"first": False, "again": True} and all(abs(r.weight - 0.5) < 1e-9 for r in got)


def test_numbers_go_on_over_blocks(spark):
    d = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    out = linear.numbered(d, KEY, F.floor(F.col("o") / 10), ["o"], "i").collect()
    assert all(r.i == r.o // 2 for r in out)


PLANTED = {
    "single": lambda t: 5 + 2 * np.exp(-t / 40), "double": lambda t: 1 + 3 * np.exp(-t / 12) - 2 * np.exp(-t / 150),
    "double_drift": lambda t: 1 + 3 * np.exp(-t / 12) - 2 * np.exp(-t / 150) + 0.01 * t, "stretched": lambda t: 4 - 3 * np.exp(-((t / 60) ** 0.5)),
}


@pytest.fixture(scope="module")
def responses(spark):
    t = np.linspace(0, 400, 200)
    rng = np.random.default_rng(3)
    rows = [(name, float(x), float(y)) for name, f in PLANTED.items() for x, y in zip(t, f(t) + rng.normal(size=len(t)) * 0.01)]
    rows += [("short", float(i), 1.0 * i) for i in range(4)] + [("single", -5.0, 100.0), ("single", None, 1.0), ("single", 3.0, None), ("single", 3.0, float("nan")), ("still", 0.0, 1.0), ("still", 0.0, 2.0)]
    return spark.createDataFrame(rows, "k string, local double, v double").cache()


def test_planted_responses_are_recovered(responses):
    got = {(r.k, r.model): r for r in transient.analyze_transients(responses, KEY, criterion="bic").collect()}
    assert not any(k in ("short", "still") for k, _ in got)
    for name in PLANTED:
        assert [r.model for (k, _), r in got.items() if k == name and r.selected] == [name]
    assert math.isclose(got["single", "single"].tau_fast, 40, rel_tol=0.03) and math.isclose(got["single", "single"].a_fast, 2, rel_tol=0.02)
    d = got["double", "double"]
    assert math.isclose(d.tau_fast, 12, rel_tol=0.1) and math.isclose(d.tau_slow, 150, rel_tol=0.1) and math.isclose(d.a_slow, -2, rel_tol=0.1) and not d.poor_separation
    s = got["stretched", "stretched"]
    assert math.isclose(s.beta, 0.5, abs_tol=0.05) and s.initial_rate is None
    assert got["double_drift", "double_drift"].drift == pytest.approx(0.01, rel=0.3)
    assert got["single", "single"].total_amplitude == pytest.approx(-2, rel=0.02)


def test_times_to_fractions(spark):
    """One exponential has a closed form; a response at rest takes no time; a drift away never comes near."""
    rows = [("single", 10.0, None, None, 0.0, 2.0, None, None, 100.0), ("still", 10.0, None, None, 0.0, 0.0, None, None, 100.0), ("away", 10.0, 20.0, None, 0.0, 1.0, 1.0, 1.0, 100.0)]
    df = spark.createDataFrame(rows, "k string, tau_fast double, tau_slow double, beta double, e_infinity double, a_fast double, a_slow double, drift double, duration double")
    got = {r.k: r for r in df.select("k", *(transient.time_to_fraction(q).alias(f"q{int(q * 1000)}") for q in (0.632, 0.9, 0.95))).collect()}
    for q in (0.632, 0.9, 0.95):
        assert got["single"][f"q{int(q * 1000)}"] == pytest.approx(-10 * math.log(1 - q), rel=2e-3)
    assert got["still"].q900 == 0.0 and got["away"].q950 is None


def test_kramers_kronig_stop(spark):
    rng = np.random.default_rng(4)
    rows, f = [], np.logspace(-1, 5, 60)
    for k in range(3):
        w = 2 * np.pi * f
        z = 100 + 500 / (1 + 1j * w * 1e-3) + 300 / (1 + (1j * w * 0.1) ** 0.8) + rng.normal(size=60) * (0, 1, 30)[k] + 1j * rng.normal(size=60) * (0, 1, 30)[k]
        rows += [(k, float(x), float(y.real), float(y.imag)) for x, y in zip(f, z)]
    rows += [(8, 10.0, 1.0, 1.0), (8, 10.0, 1.0, 2.0), (0, -1.0, 1.0, 1.0), (0, None, 1.0, 1.0), (1, 5.0, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k int, freq_hz double, z_re double, z_im double").repartition(5)
    got = {r.k: r for r in kramers_kronig.kramers_kronig(df, KEY, stop=0.5, most=12).collect()}
    assert set(got) == {0, 1, 2}
    for k in range(3):
        p = np.array([r[1:] for r in rows if r[0] == k and r[1] and r[1] > 0 and not math.isnan(r[2])])
        w = 2 * np.pi * p[:, 0]
        for m in range(3, 13):
            taus = np.exp(np.linspace(np.log(1 / w.max()), np.log(1 / w.min()), m))
            wt = w[:, None] * taus
            a = np.vstack([np.column_stack([np.ones(len(w)), 1 / (1 + wt**2)]), np.column_stack([np.zeros(len(w)), -wt / (1 + wt**2)])])
            x = np.linalg.lstsq(a, np.concatenate([p[:, 1], p[:, 2]]), rcond=None)[0]
            neg = -x[1:][x[1:] < 0].sum()
            mu = 1 - x[1:][x[1:] >= 0].sum() / neg if neg > 1e-12 else -1.0
            if mu < 0.5:
                break
        assert got[k].m == m and got[k].mu == pytest.approx(mu, rel=1e-6) and np.allclose(got[k].resistances, x[1:], rtol=1e-5, atol=1e-6)
    fits = kramers_kronig.kramers_kronig(df, KEY, stop=float("-inf"), most=12)
    res = kramers_kronig.residuals(df.where("k = 0 AND freq_hz > 0"), fits, KEY).agg(F.max(F.abs("res_re")).alias("r")).first().r
    assert res < 0.05


def test_supports_meet_once_whatever_their_length(spark):
    rng = random.Random(5)
    rows = []
    for i in range(220):
        kind, start = rng.choice(["point", "window", "window", "event"]), rng.choice([rng.uniform(0, 5000), float(rng.randrange(0, 5000, 60))])
        end = start + rng.choice([0, 1, 60, 600, 5000, 10**7])
        rows.append((i, rng.randrange(2), rng.choice([0, 0, None]), kind, None if kind == "event" else start, end if kind == "window" else None, rng.choice(["", "a", "b"]) if kind == "event" else None))
    df = spark.createDataFrame(rows, "id int, scope int, clock int, kind string, start_s double, end_s double, event_id string")
    got = [tuple(r) for r in evidence.meeting_pairs(df, df, tolerance_s=45.0, base_s=10.0, levels=8).collect()]

    def meets(a, b):
        if a[1] != b[1] or a[2] is None or a[2] != b[2]:
            return False
        if a[3] == b[3] == "event":
            return a[6] != "" and a[6] == b[6]
        if "event" in (a[3], b[3]):
            return False
        if a[3] == b[3] == "point":
            return abs(a[4] - b[4]) <= 45
        if a[3] == "point":
            return b[4] <= a[4] <= b[5]
        if b[3] == "point":
            return a[4] <= b[4] <= a[5]
        return max(a[4], b[4]) < min(a[5], b[5])

    want = {(a[0], b[0], f"{a[3]}_{b[3]}") for a, b in itertools.product(rows, rows) if meets(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("policy,shares,outcome", [
    ("all_steady", (1.0, 1.0), "eligible"), ("all_steady", (0.9, 1.0), "ineligible"), ("all_steady", (None, 1.0), "ineligible"), ("minimum", (0.7, 1.0), "eligible"),
    ("minimum", (0.5, 1.0), "ineligible"), ("worst_case", (None, 1.0), "eligible"), ("worst_case", (None, None), "indeterminate"), ("worst_case", (0.9, 1.0), "ineligible"),
])
def test_policies_of_mixed_states(spark, policy, shares, outcome):
    rows = [(i, "s", 1, "point", 5.0, None, None, 1.0, shares[1], shares[0]) for i in (1, 2)]
    s = spark.createDataFrame(rows, "id int, scope string, clock int, kind string, start_s double, end_s double, event_id string, classified double, equilibrium double, steady double")
    ask = spark.createDataFrame([(1, 2, "point_point"), (1, 1, "point_point"), (1, 7, "point_point")], "left_id int, right_id int, mode string")
    got = {(r.left_id, r.right_id): r for r in evidence.assess_temporal(ask, s, evidence.TemporalLimits(policy=policy, minimum_steady=0.6)).collect()}
    assert got[1, 2].outcome == outcome and got[1, 1].reason == "same_evidence" and got[1, 7].reason == "unknown_evidence"


def test_lineages(spark):
    """A diamond, a missing parent, a cycle, a self-reference, and unknown families that absorb."""
    edges = [("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("m", "gone"), ("m", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), ("u", "q"), ("gone2", "a"), ("d", "b")]
    nodes = [("a", ["f1"]), ("b", []), ("c", ["f2", "f1"]), ("d", ["f3"]), ("m", []), ("x", ["f4"]), ("y", []), ("z", []), ("s", []), ("u", ["f9"]), ("q", None), ("alone", [])]
    got = {r.id: tuple(r)[1:] for r in lineage.resolve(spark.createDataFrame(nodes, "id string, families array<string>"), spark.createDataFrame(edges, "child string, parent string")).collect()}
    assert got == {
        "a": ("complete", 0, "", "f1"), "b": ("complete", 1, "", "f1"), "c": ("complete", 1, "", "f1,f2"), "d": ("complete", 3, "", "f1,f2,f3"), "m": ("incomplete", 2, "gone", "f1"), "x": ("cycle", 2, "", "f4"),
        "y": ("cycle", 2, "", "f4"), "z": ("cycle", 2, "", "f4"), "s": ("cycle", 1, "", ""), "u": ("complete", 1, "", None), "q": ("complete", 0, "", None), "alone": ("complete", 0, "", ""),
    }


def test_promotion_levels(spark):
    h = spark.createDataFrame([(x, 1) for x in "abcdef"], "hypothesis string, minimum_support int")
    need = spark.createDataFrame([(x, r, "support", "required") for x in "abcde" for r in (1, 2)] + [("a", 3, "validation", "required"), ("b", 3, "support", "optional")], "hypothesis string, requirement int, stage string, gate string")
    support = spark.createDataFrame([(x, r, 1) for x in "abcd" for r in (1, 2)] + [("e", 1, 1)], "hypothesis string, requirement int, id int")
    gates = spark.createDataFrame([("a", "timescale", 1, True), ("b", "timescale", 1, True), ("b", "amplitude", 2, True), ("c", "timescale", 1, None), ("d", "amplitude", 1, True)], "hypothesis string, kind string, gate int, satisfied boolean")
    no = spark.createDataFrame([("d", 1), ("a", 0)], "hypothesis string, strong_critical int")
    valid = spark.createDataFrame([("a", True), ("c", True), ("d", True)], "hypothesis string, satisfied boolean")
    got = {r.hypothesis: (r.level, r.reasons) for r in evidence.promote(h, need, support, gates, no, valid).collect()}
    assert got == {
        "a": ("validated_for_domain", "validation,timescale"), "b": ("experimentally_supported", "timescale,amplitude"), "c": ("hypothesized", ""), "d": ("contradicted", "critical_contradiction,amplitude"),
        "e": ("not_assessed", ""), "f": ("not_assessed", ""),
    }
    parts = evidence.promote_components(evidence.promote(h, need, support, gates, no, valid), spark.createDataFrame([("a", "m"), ("b", "n"), ("d", "n"), ("c", "n")], "hypothesis string, component string"), spark.createDataFrame([("n", "validated_for_domain")], "component string, status string"))
    assert {(r.hypothesis, r.component): r.status for r in parts.collect()} == {("a", "m"): "validated_for_domain", ("b", "n"): "validated_for_domain", ("d", "n"): "validated_for_domain", ("c", "n"): "validated_for_domain"}


def test_rules_with_unavailable_conditions(spark):
    rules = spark.createDataFrame([("r", "watch", True, 1, 0), ("q", "info", False, 0, 5)], "rule string, severity string, mechanistic boolean, minimum_domains int, minimum_records int")
    conditions = spark.createDataFrame([("r", "all", "a", "greater_than", 1.0), ("r", "any", "b", "trend_increasing", 0.5), ("r", "any", "calibration.x", "log_ratio", 0.1), ("q", "all", "a", "warning_present", None)], "rule string, part string, feature string, operator string, threshold double")
    features = spark.createDataFrame([(1, "a", 2.0, "w", "signal"), (1, "b", 1.0, None, "drift"), (2, "a", 2.0, None, "signal"), (3, "a", None, "w", "signal")], "rec int, feature string, value double, warning string, domain string")
    comparisons = spark.createDataFrame([(1, "calibration.x", 0.0, 0.05, 0.0, 9), (2, "calibration.x", 0.0, -0.5, 0.0, 9)], "rec int, feature string, relative double, log_ratio double, robust_z double, records int")
    trends = spark.createDataFrame([(1, "b", 0.6), (2, "b", 0.4)], "rec int, feature string, slope double")
    got = {(r.rec, r.rule): (r.triggered, r.confidence, r.satisfied, r.contradicted, r.unavailable, r.domains) for r in assess.evaluate_rules(rules, conditions, features, comparisons, ["rec"], trends=trends).collect()}
    assert got[1, "r"] == (True, "low", 2, 1, 0, 2) and got[2, "r"] == (True, "low", 2, 1, 0, 2) and got[3, "r"][4] == 3 and not got[3, "r"][0]
    assert got[1, "q"][:2] == (True, "moderate") and got[2, "q"][:2] == (False, "insufficient")
    plain = {(r.rec, r.rule): (r.triggered, r.unavailable) for r in assess.evaluate_rules(rules, conditions, features, comparisons, ["rec"], baselines=spark.createDataFrame([(1, 5), (3, 4)], "rec int, records int")).collect()}
    assert plain[1, "q"] == (True, 0) and plain[3, "q"] == (False, 1) and plain[1, "r"][0] is False
