"""Assessments and graph operators against brute force, with the cases that the registered tables do not hold."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import assess, estimation, fleet, lineage
from sensorframe.plans.q_assess import supplier_links
from sensorframe.plans import registry

SF = "/root/testdata/sf0.001"


def test_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 302), (302, 300)]
    got = {(r.id, r.ancestor): r.depth for r in lineage.ancestors(spark.createDataFrame(chain, "child int, parent int")).collect()}
    want = {(i, j): j - i for i in range(200) for j in range(i + 1, 201)} | {(300 + i, 300 + (i + d) % 3): d for i in range(3) for d in (1, 2, 3)}
    assert got == want
    assert lineage.ancestors(spark.createDataFrame([], "child int, parent int")).count() == 0


def brute_largest(ids, pairs):
    for n in range(len(ids), 0, -1):
        for some in combinations(sorted(ids), n):
            if not any((a, b) in pairs or (b, a) in pairs for a, b in combinations(some, 2)):
                return list(some)
    return []


@pytest.mark.parametrize("seed", range(3))
def test_independent_subset(spark, seed):
    rng = np.random.default_rng(seed)
    items = [(g, 100 * g + i) for g in range(6) for i in range(int(rng.integers(1, 10)))]
    pairs = {(int(a), int(b)) for a, b in rng.choice([i for _, i in items], (25, 2))}
    frames = spark.createDataFrame(items, "g int, id int"), spark.createDataFrame(list(pairs), "a int, b int")
    got = {g: sorted(r.id for r in rows) for g, rows in _by(lineage.independent_subset(*frames, ["g"]).collect(), "g")}
    assert got == {g: brute_largest([i for k, i in items if k == g], pairs) for g in {g for g, _ in items}}
    # beyond the exact size: in id order, what depends on nothing taken before
    got = {g: sorted(r.id for r in rows) for g, rows in _by(lineage.independent_subset(*frames, ["g"], exact=0).collect(), "g")}
    want = {}
    for g, i in sorted(items):
        if not any((i, j) in pairs or (j, i) in pairs for j in want.setdefault(g, [])):
            want[g].append(i)
    assert got == want


def _by(rows, name):
    return [(k, [r for r in rows if r[name] == k]) for k in {r[name] for r in rows}]


def test_independent_subset_of_suppliers(spark):
    items = {}
    for r in spark.read.parquet(f"{SF}/supplier.parquet").collect():
        items.setdefault(r.s_nationkey, []).append(r.s_suppkey)
    pairs = {(r.a, r.b) for r in supplier_links(spark, SF).collect()}
    got = {g: sorted(r.id for r in rows) for g, rows in _by(registry.queries()["f06_independent_subset"](spark, SF).collect(), "site")}
    assert got == {g: brute_largest(ids, pairs) for g, ids in items.items()}


def test_match_ordered(spark):
    rng = np.random.default_rng(3)
    left = [(s, i, float(x)) for s in range(3) for i, x in enumerate(np.sort(rng.uniform(0, 30, 60)))]
    right = [(s, i, float(x)) for s in range(3) for i, x in enumerate(np.sort(rng.uniform(0, 30, 50)))]
    frames = (spark.createDataFrame(x, "s int, id int, x double") for x in (left, right))
    got = {(r.s, r.li, r.ri) for r in estimation.match_ordered(*frames, ["s"], 0.2).collect()}
    want, used = set(), set()
    for s, i, x in left:
        near = [(abs(x - y), j) for t, j, y in right if t == s and (s, j) not in used and abs(x - y) <= 0.2]
        if near:
            used.add((s, min(near)[1]))
            want.add((s, i, min(near)[1]))
    assert got == want


def test_empirical_share(spark):
    rng = np.random.default_rng(4)
    ref = [("a", float(x)) for x in np.round(rng.normal(0, 1, 500), 2)] + [("b", 5.0)] * 3 + [("a", None)]
    now = [("a", float(x)) for x in (-9, -0.5, 0, 0.01, 2, 9)] + [("b", 4.9), ("b", 5.0), ("b", 6.0), ("b", None)]
    ref_frame, frame = (spark.createDataFrame(x, "k string, value double") for x in (ref, now))
    got = {(r.k, r.value): r.share for r in fleet.empirical_share(frame, ref_frame, fleet.baseline(ref_frame, ["k"]), ["k"]).collect()}
    for k, v in now:
        of = [x for j, x in ref if j == k and x is not None]
        assert got[(k, v)] == (None if v is None else pytest.approx(sum(x <= v for x in of) / len(of)))


def test_quality_gate_reasons(spark):
    rows = [(1, 20, 0.0, 0.1, 0, 0, 5.0), (2, 20, None, 0.1, 0, 0, 5.0), (3, 20, float("inf"), 0.1, 0, 0, 5.0), (4, 20, 0.0, 0.1, 1, 0, 5.0), (5, 20, 0.0, 0.1, 0, 0, 50.0)]
    summary = spark.createDataFrame(rows, "id int, n int, missing_share double, dt_cv double, duplicates int, backward int, dt_max double")
    limits = {"least_samples": 10, "most_missing": 0.1, "most_cv": 0.5, "most_duplicates": 0, "most_backward": 0}
    got = {r.id: (r.state, r.reason) for r in assess.quality_gate(summary, **limits, most_gap=10.0).collect()}
    assert got == {1: ("adequate", "within"), 2: ("poor", "absent"), 3: ("indeterminate", "invalid"), 4: ("poor", "limit"), 5: ("poor", "limit")}
    assert assess.quality_gate(summary, **limits).where("id = 5 AND state = 'adequate'").count() == 1


def test_digest_follows_values(spark):
    rows = [(1, i, float(i)) for i in range(200)]
    schema, digest = "s int, i long, v double", lambda x: assess.content_digest(spark.createDataFrame(x, schema), ["s"], "i", ["v"]).first().digest
    assert digest(rows) == digest(rows[::-1]) != digest([*rows[:-1], (1, 199, 198.5)]) != digest([*rows[:-1], (1, 199, None)])


def test_predictions_without_a_model(spark):
    fits = assess.line_models(spark.createDataFrame([("a", float(x), 2.0 * x + 1) for x in range(5)] + [("b", 1.0, 1.0)], "k string, x double, y double"), ["k"])
    new = spark.createDataFrame([("a", 100.0), ("a", -1.0), ("b", 1.0), ("a", 1e6)], "k string, activity double")
    got = {(r.k, r.activity): (r.potential and round(r.potential, 9), r.distance, r.reason) for r in assess.predict_potential(new, fits, ["k"]).collect()}
    assert got[("a", 100.0)] == (5.0, 0.0, None) and got[("a", -1.0)][::2] == (None, "activity") and got[("b", 1.0)][::2] == (None, "model") and got[("a", 1e6)] == (13.0, 2.0, "extrapolated")
    back = assess.predict_activity(spark.createDataFrame([("a", 5.0), ("b", 1.0), ("a", None)], "k string, potential double"), fits, ["k"])
    assert [(r.activity and round(r.activity, 6), r.reason) for r in back.orderBy(F.col("potential").desc_nulls_last()).collect()] == [(100.0, None), (None, "model"), (None, "potential")]


def test_shares_with_a_far_outlier(spark):
    """One value far from all others must not put the others into one range."""
    ref = spark.range(20_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") % 5000).cast("double").alias("value"))
    asked = spark.createDataFrame([(1, -1.0), (1, 0.0), (1, 2499.0), (1, 2499.5), (1, 5000.0), (1, 1e12), (2, 1.0)], "k int, value double")
    got = {r.value: r.share for r in fleet.empirical_share(asked, ref, fleet.baseline(ref, ["k"]), ["k"]).collect() if r.k == 1}
    values = [1e12 if i == 0 else float(i % 5000) for i in range(20_000)]
    assert got == {v: sum(x <= v for x in values) / 20_000 for v in got}
