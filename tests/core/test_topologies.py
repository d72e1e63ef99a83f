"""Planted circuits are recovered from noisy spectra."""

import math

import numpy as np

from sensorframe.operators import topologies

F_HZ = np.logspace(-2, 5, 70)
S = 2j * np.pi * F_HZ
PLANTED = {
    "randles": 20 + 100 / (1 + (S * 1e-3) ** 0.8), "randles_warburg": 20 + 100 / (1 + (S * 1e-3) ** 0.9) + 40 / np.sqrt(S), "double_arc": 10 + 80 / (1 + (S * 2e-5) ** 0.9) + 60 / (1 + (S * 0.05) ** 0.9),
    "gerischer": 15 + 200 / np.sqrt(1 + S * 0.1), "randles_open": 20 + 100 / (1 + (S * 1e-4) ** 0.9) + 50 / (np.sqrt(S * 2.0) * np.tanh(np.sqrt(S * 2.0))),
}


def test_planted_topologies(spark):
    rng = np.random.default_rng(2)
    rows = [(name, float(f), float(v.real + rng.normal() * 0.2), float(v.imag + rng.normal() * 0.2)) for name, z in PLANTED.items() for f, v in zip(F_HZ, z)]
    rows += [("one", 1.0, 2.0, 3.0), ("randles", -1.0, 0.0, 0.0), ("randles", None, 0.0, 0.0), ("randles", 3.0, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "name string, freq_hz double, z_re double, z_im double").repartition(4)
    got = topologies.score_topologies(df, ["name"]).collect()
    best = {r.name: r for r in got if r.delta == 0}
    assert set(best) == set(PLANTED) and {n: r.topology for n, r in best.items()} == {n: n for n in PLANTED}
    r = best["randles"]
    assert math.isclose(r.r0, 20, rel_tol=0.05) and math.isclose(r.terms[0].tau, 1e-3, rel_tol=0.15) and math.isclose(r.terms[0].scale, 100, rel_tol=0.05) and r.n == 70
    two = best["double_arc"].terms
    assert [math.isclose(t.tau, want, rel_tol=0.3) for t, want in zip(two, (2e-5, 0.05))] == [True, True]
    for x in got:  # the sums give what the points give
        z = x.r0 + sum(t.scale * topologies.SHAPES[t.kind][1](S, t.tau, t.alpha) for t in x.terms)
        p = np.array([q[1:] for q in rows if q[0] == x.name and q[1] and q[1] > 0 and q[2] == q[2]])
        assert math.isclose(x.rss, np.sum((z.real - p[:, 1]) ** 2 + (z.imag - p[:, 2]) ** 2), rel_tol=1e-3, abs_tol=1e-3)
