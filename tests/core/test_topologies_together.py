import math

import numpy as np

from sensorframe.operators import topologies as G


def test_short_and_long_spectra_are_scored_alike(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f, float(20 + k + 500 / (1 + (f * 0.1 * (k + 1)) ** 2) + rng.normal()), float(-50 * f / (1 + f * f) + rng.normal())) for k in range(3) for f in (10 ** (i / 4) for i in range(16))]
    points = spark.createDataFrame(rows, "name int, freq_hz double, z_re double, z_im double")
    grid = G.Grid(steps=4, rounds=1)
    one, two = (G.score_topologies(points, ["name"], grid=grid, together=n).orderBy("name", "topology").collect() for n in (100, 0))
    assert len(one) > 6 and [(r.name, r.topology) for r in one] == [(r.name, r.topology) for r in two]
    for a, b in zip(one, two, strict=True):
        assert math.isclose(a.rss, b.rss, rel_tol=1e-6) and [t.kind for t in a.terms] == [t.kind for t in b.terms]


def test_candidates_that_cannot_be_told_apart_are_passed_over():
    shapes = [("arc", 1.0, 1.0), ("arc", 1.0 + 1e-9, 1.0), ("arc", 30.0, 1.0)]
    a = G._columns(np.logspace(-3, 2, 30), shapes)
    y = a @ np.array([1.0, 2.0, 0.5, 0.7])
    gram = (lambda x: x.T @ x)(np.column_stack([a, y]))
    rss, at, scales = G._best(gram, shapes, ("arc", "arc"))
    assert at.tolist() in ([0, 1, 3], [0, 2, 3]) and np.allclose(scales, [1, 2.5, 0.7], rtol=1e-4)
