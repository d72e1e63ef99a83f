"""Circuit topologies scored on spectra: sums of a resistance and up to three relaxations or diffusion terms, on grids of their constants.

A term is a scale times a shape, so all candidates of a spectrum are least squares on columns from one list of shapes. Points are reduced to the
sums of products of all those columns, once; every candidate of every topology is a small block of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.sources.storage import dealt

#: Shapes of (angular frequency times i, time constant, exponent), with the number of constants that are fitted beside the scale.
SHAPES = {
    "arc": (2, lambda s, tau, alpha: 1 / (1 + (s * tau) ** alpha)), "gerischer": (1, lambda s, tau, alpha: 1 / np.sqrt(1 + s * tau)), "warburg": (0, lambda s, tau, alpha: 1 / np.sqrt(s)),
    "open": (1, lambda s, tau, alpha: 1 / (np.sqrt(s * tau) * np.tanh(np.sqrt(s * tau)))), "short": (1, lambda s, tau, alpha: np.tanh(np.sqrt(s * tau)) / np.sqrt(s * tau)),
}
#: Topologies as the terms in series with a resistance.
TOPOLOGIES = {
    "randles": ("arc",), "randles_warburg": ("arc", "warburg"), "randles_open": ("arc", "open"), "randles_short": ("arc", "short"), "gerischer": ("gerischer",), "arc_gerischer": ("arc", "gerischer"),
    "double_gerischer": ("gerischer", "gerischer"), "double_arc": ("arc", "arc"), "double_arc_warburg": ("arc", "arc", "warburg"), "double_arc_open": ("arc", "arc", "open"), "double_arc_short": ("arc", "arc", "short"),
    "arc_gerischer_warburg": ("arc", "gerischer", "warburg"),
}


@dataclass(frozen=True)
class Grid:
    """Time constants spread evenly in their logarithm over the measured band; exponents of arcs; rounds of finer constants around each
    topology's best, in which the step shrinks by ``ratio``."""

    steps: int = 12
    alphas: tuple[float, ...] = (0.6, 0.8, 1.0)
    rounds: int = 5
    ratio: float = 3.0


def _coarse(tau_min: float, tau_max: float, grid: Grid) -> list[tuple[str, float, float]]:
    taus = np.exp(np.linspace(math.log(tau_min), math.log(tau_max), grid.steps + 1)).tolist()
    one = [(kind, t, 1.0) for kind in ("gerischer", "open", "short") for t in taus]
    return [("arc", t, a) for t in taus for a in grid.alphas] + one + [("warburg", 0.0, 1.0)]


def _finer(terms: list[tuple[str, float, float]], tau_min: float, tau_max: float, grid: Grid, round_: int) -> list[tuple[str, float, float]]:
    step = math.log(tau_max / tau_min) / grid.steps / grid.ratio**round_
    gap = 0.2 / grid.ratio**round_
    out = set()
    for kind, tau, alpha in terms:
        if kind == "warburg":
            out.add((kind, tau, alpha))
            continue
        alphas = sorted({min(1.0, max(0.3, alpha + gap * i)) for i in (-1, 0, 1)}) if kind == "arc" else [1.0]
        out |= {(kind, tau * math.exp(step * i), a) for i in (-2, -1, 0, 1, 2) for a in alphas}
    return sorted(out)


def _columns(omega: np.ndarray, shapes: list[tuple[str, float, float]]) -> np.ndarray:
    """Real over imaginary rows of the resistance and all shapes."""
    s, z = 1j * omega[:, None], np.ones((len(omega), len(shapes) + 1), complex)
    for kind in {k for k, _, _ in shapes}:
        of = [i for i, x in enumerate(shapes, 1) if x[0] == kind]
        z[:, of] = SHAPES[kind][1](s, *(np.array([shapes[i - 1][j] for i in of]) for j in (1, 2)))
    return np.vstack([z.real, z.imag])


def _candidates(terms: tuple[str, ...], shapes: list[tuple[str, float, float]]) -> np.ndarray:
    """Places of the columns of each candidate, the resistance first; terms of one kind are in the order of their time constants."""
    of = [[i + 1 for i, s in enumerate(shapes) if s[0] == kind] for kind in terms]
    rows = np.stack(np.meshgrid(*of, indexing="ij"), -1).reshape(-1, len(terms)).astype(np.int64)
    tau = np.array([0.0, *(s[1] for s in shapes)])
    for i in range(len(terms) - 1):
        if terms[i] == terms[i + 1]:
            rows = rows[tau[rows[:, i]] < tau[rows[:, i + 1]]]
    return np.hstack([np.zeros((len(rows), 1), np.int64), rows])


def _solved(g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Scales of all candidates together, by factoring their blocks of the Gram as L D L' without pivots."""
    p, c = at.shape[1], at.T
    w, low, d, y = {}, {}, [], []
    for i in range(p):
        for j in range(i):
            w[i, j] = g[c[i], c[j]] - sum(low[j, k] * w[i, k] for k in range(j))
            low[i, j] = w[i, j] / d[j]
        d.append(g[c[i], c[i]] - sum(low[i, k] * w[i, k] for k in range(i)))
        y.append(g[c[i], -1] - sum(low[i, k] * y[k] for k in range(i)))
    x: list = [None] * p
    for i in reversed(range(p)):
        x[i] = y[i] / d[i] - sum(low[k, i] * x[k] for k in range(i + 1, p))
    return x


def _best(gram: np.ndarray, shapes: list[tuple[str, float, float]], terms: tuple[str, ...]) -> tuple[float, np.ndarray, np.ndarray] | None:
    """(rss, columns, scales) of the best candidate whose scales are all positive and whose columns are told apart (condition under 1e9). The
    measured spectrum is the Gram's last column."""
    at = _candidates(terms, shapes)
    if not len(at):
        return None
    size = np.append(np.sqrt(np.diagonal(gram)[:-1]), 1.0)
    with np.errstate(all="ignore"):
        g = gram / np.outer(size, size)
        x = _solved(g, at)
        rss = np.maximum(gram[-1, -1] - sum(v * g[at[:, i], -1] for i, v in enumerate(x)), 0)
        fits = x[0] >= 0
        for v in x[1:]:
            fits &= v > 0
    rss = np.where(fits & ~np.isnan(rss), rss, np.inf)
    apart = lambda rows: np.linalg.cond(g[rows[:, :, None], rows[:, None, :]]) < 1e9
    i = int(rss.argmin())
    if np.isfinite(rss[i]) and not apart(at[i : i + 1])[0]:
        # the condition of all is only looked at where the best one's fails
        left = np.flatnonzero(np.isfinite(rss))
        rss[left[~apart(at[left])]] = np.inf
        i = int(rss.argmin())
    return (float(rss[i]), at[i], np.array([v[i] for v in x]) / size[at[i]]) if np.isfinite(rss[i]) else None


#: Points of a spectrum that are fitted in the memory of a task; longer spectra are reduced batch by batch and round by round.
TOGETHER = 1 << 16


def score_topologies(points: DataFrame, key: list[str], *, topologies: tuple[str, ...] = tuple(TOPOLOGIES), grid: Grid = Grid(), together: int = TOGETHER) -> DataFrame:
    """Per spectrum and topology the best candidate: key, topology, n, k, r0, terms (kind, tau, alpha, scale), rss, aic, bic, and delta to the
    spectrum's lowest bic. ``points`` has freq_hz, z_re and z_im; points without a positive frequency or a value are left out.

    Spectra of up to ``together`` points go through all rounds in one visit of a task; longer ones' points are summed by batches in each round.
    A spectrum needs points at two frequencies. Topologies that no candidate with positive scales fits have no row. Time constants are as exact as
    the last round's step."""
    ok = (F.col("freq_hz") > 0) & (F.col("freq_hz") < float("inf")) & F.col("z_re").isNotNull() & F.col("z_im").isNotNull() & ~F.isnan("z_re") & ~F.isnan("z_im")
    p = points.where(ok).select(*key, "freq_hz", "z_re", "z_im")
    ends = p.groupBy(key).agg((1 / (2 * math.pi * F.max("freq_hz"))).alias("tau_min"), (1 / (2 * math.pi * F.min("freq_hz"))).alias("tau_max"), F.count("*").alias("n")).where("tau_min < tau_max")
    p = p.join(ends, key)
    kinds = ", ".join(f"{k} {p.schema[k].dataType.simpleString()}" for k in key)
    found = "topology string, shapes array<struct<kind:string,tau:double,alpha:double>>, scales array<double>, rss double"

    def listed(rows: pd.DataFrame) -> list[tuple[str, float, float]]:
        return [(x["kind"], x["tau"], x["alpha"]) for x in rows["listed"].iloc[0]]

    def grams(shapes_of) -> DataFrame:
        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for own, g in batch.groupby([*key, "topology"], sort=False, dropna=False):
                    shapes = shapes_of(g)
                    a = np.column_stack([_columns(2 * math.pi * g["freq_hz"].to_numpy(), shapes), np.concatenate([g["z_re"], g["z_im"]])])
                    out.append((*own, g["tau_min"].iloc[0], g["tau_max"].iloc[0], [dict(zip(("kind", "tau", "alpha"), s, strict=True)) for s in shapes], (a.T @ a).ravel().tolist()))
                yield pd.DataFrame(out, columns=[*key, "topology", "tau_min", "tau_max", "listed", "gram"])

        return reduce

    def choose(own: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shapes = listed(rows)
        gram = np.sum([np.reshape(g, (len(shapes) + 2,) * 2) for g in rows["gram"]], axis=0)
        out = []
        for name in topologies if own[-1] == "" else [own[-1]]:
            if best := _best(gram, shapes, TOPOLOGIES[name]):
                rss, at, scales = best
                out.append((*own[:-1], name, [dict(zip(("kind", "tau", "alpha"), shapes[i - 1], strict=True)) for i in at[1:]], scales.tolist(), rss))
        return pd.DataFrame(out, columns=[*key, "topology", "shapes", "scales", "rss"])

    def whole(own: tuple, rows: pa.Table) -> pa.Table:
        omega, re, im, tau_min, tau_max = (rows[c].to_numpy() for c in ("freq_hz", "z_re", "z_im", "tau_min", "tau_max"))
        omega, measured, ends = 2 * math.pi * omega, np.concatenate([re, im]), (tau_min[0], tau_max[0])

        def scored(shapes: list, names: tuple) -> dict:
            a = np.column_stack([_columns(omega, shapes), measured])
            gram = a.T @ a
            found = {name: _best(gram, shapes, TOPOLOGIES[name]) for name in names}
            return {name: ([shapes[j - 1] for j in x[1][1:]], x[2].tolist(), x[0]) for name, x in found.items() if x}

        best = scored(_coarse(*ends, grid), topologies)
        for i in range(1, grid.rounds + 1):
            best = {k: v for name, (terms, _, _) in best.items() for k, v in scored(_finer(terms, *ends, grid, i), (name,)).items()}
        shapes = [[dict(zip(("kind", "tau", "alpha"), t, strict=True)) for t in terms] for terms, _, _ in best.values()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("tau", pa.float64()), ("alpha", pa.float64())]))
        own_columns = [pa.repeat(k, len(best)) for k in own]
        return pa.table(
            [*own_columns, pa.array(list(best), pa.string()), pa.array(shapes, kind), pa.array([x[1] for x in best.values()], pa.list_(pa.float64())), pa.array([x[2] for x in best.values()], pa.float64())],
            [*key, "topology", "shapes", "scales", "rss"],
        )

    short = dealt(p.where(F.col("n") <= together).select(*key, "freq_hz", "z_re", "z_im", "tau_min", "tau_max"), key)  # few bytes, but much work
    best = short.groupBy(key).applyInArrow(whole, f"{kinds}, {found}")
    if not ends.where(F.col("n") > together).isEmpty():
        gram_schema = f"{kinds}, topology string, tau_min double, tau_max double, listed array<struct<kind:string,tau:double,alpha:double>>, gram array<double>"
        first = p.where(F.col("n") > together).withColumn("topology", F.lit("")).mapInPandas(grams(lambda g: _coarse(g["tau_min"].iloc[0], g["tau_max"].iloc[0], grid)), gram_schema)
        long = first.groupBy(*key, "topology").applyInPandas(choose, f"{kinds}, {found}")
        for i in range(1, grid.rounds + 1):
            each = p.join(long.select(*key, "topology", F.col("shapes").alias("terms")), key)

            def around(g: pd.DataFrame, i: int = i) -> list[tuple[str, float, float]]:
                terms = [(x["kind"], x["tau"], x["alpha"]) for x in g["terms"].iloc[0]]
                return _finer(terms, g["tau_min"].iloc[0], g["tau_max"].iloc[0], grid, i)

            long = each.mapInPandas(grams(around), gram_schema).groupBy(*key, "topology").applyInPandas(choose, f"{kinds}, {found}")
        best = best.union(long)
    extra = F.create_map(*(F.lit(x) for name, terms in TOPOLOGIES.items() for x in (name, 1 + sum(1 + SHAPES[t][0] for t in terms))))
    out = best.join(ends.select(*key, "n"), key).withColumn("k", F.element_at(extra, F.col("topology")))
    terms = F.transform("shapes", lambda s, i: F.struct(s["kind"].alias("kind"), s["tau"].alias("tau"), s["alpha"].alias("alpha"), F.get("scales", i + 1).alias("scale")))
    fit = 2 * F.col("n") * F.log(F.greatest("rss", F.lit(1e-12)) / (2 * F.col("n")))
    out = out.select(*key, "topology", "n", F.col("k").cast("bigint").alias("k"), F.get("scales", F.lit(0)).alias("r0"), terms.alias("terms"), "rss", (fit + 2 * F.col("k")).alias("aic"), (fit + F.col("k") * F.log(2.0 * F.col("n"))).alias("bic"))
    return out.withColumn("delta", F.col("bic") - F.min("bic").over(W.partitionBy(key)))  # a row a topology
