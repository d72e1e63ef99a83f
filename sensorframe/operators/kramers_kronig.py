"""Linear Kramers-Kronig test: spectra fitted by growing numbers of relaxations, without gathering a spectrum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Singular values up to this are none: directions that the points do not determine get no resistance.
LEAST = 1e-9


def _design(omega: np.ndarray, tau_min: float, tau_max: float, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary rows of a series resistance and ``m`` relaxations with time constants spaced evenly in their logarithm."""
    taus = np.exp(np.log(tau_min) + np.arange(m) / (m - 1) * np.log(tau_max / tau_min))
    wt = omega[:, None] * taus
    return np.hstack([np.ones((len(omega), 1)), 1 / (1 + wt**2)]), np.hstack([np.zeros((len(omega), 1)), -wt / (1 + wt**2)])


def _triangle(rows: np.ndarray) -> np.ndarray:
    """A square upper triangle with the same sums of squares and products of columns."""
    r = np.linalg.qr(rows, mode="r")
    out = np.zeros((rows.shape[1], rows.shape[1]))
    out[: len(r)] = r
    return out


def _solution(r: np.ndarray) -> tuple[np.ndarray, float]:
    """(coefficients, residual sum of squares) of the least squares whose rows, with the target last, have the triangle ``r``."""
    u, s, vt = np.linalg.svd(r[:, :-1], full_matrices=False)
    keep = s > LEAST
    x = vt[keep].T @ ((u[:, keep].T @ r[:, -1]) / s[keep])
    return x, float(np.sum((r[:, :-1] @ x - r[:, -1]) ** 2))


def mu(resistances: np.ndarray) -> float:
    """1 less the sum of positive over that of negative resistances; -1 without negative ones."""
    negative = -resistances[resistances < 0].sum()
    return 1 - resistances[resistances >= 0].sum() / negative if negative > 1e-12 else -1.0


def kramers_kronig(points: DataFrame, key: list[str], *, stop: float = 0.85, first: int = 3, most: int = 20) -> DataFrame:
    """Per spectrum: (key, m, mu, series, resistances, rss, n, tau_min, tau_max), of the first number of relaxations m from ``first`` on whose mu is
    under ``stop``, or of ``most``. ``points`` has freq_hz, z_re and z_im.

    Time constants lie between 1 / (2 pi f) of the highest and the lowest frequency. Each batch of points is reduced to a triangle for each m
    (as many numbers as (m + 2)^2, whatever its points), the few triangles of a spectrum are stacked and reduced again, and only then
    solved; that is as exact as solving from the points. Points without a positive finite frequency or with values that are no
    numbers are left out; spectra of one frequency have no row.
    """
    ok = (F.col("freq_hz") > 0) & (F.col("freq_hz") < float("inf")) & ~F.isnan("z_re") & ~F.isnan("z_im") & F.col("z_re").isNotNull() & F.col("z_im").isNotNull()
    p = points.where(ok).select(*key, "freq_hz", "z_re", "z_im")
    ends = p.groupBy(key).agg((1 / (2 * math.pi * F.max("freq_hz"))).alias("tau_min"), (1 / (2 * math.pi * F.min("freq_hz"))).alias("tau_max"), F.count("*").alias("n")).where("tau_min < tau_max")
    p = p.join(ends, key)
    kinds = ", ".join(f"{k} {p.schema[k].dataType.simpleString()}" for k in key)

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, g in batch.groupby(key, sort=False, dropna=False):
                omega = 2 * math.pi * g["freq_hz"].to_numpy()
                for m in range(first, most + 1):
                    re, im = _design(omega, g["tau_min"].iloc[0], g["tau_max"].iloc[0], m)
                    rows = np.vstack([np.column_stack([re, g["z_re"]]), np.column_stack([im, g["z_im"]])])
                    out.append((*own, m, _triangle(rows).ravel().tolist()))
            yield pd.DataFrame(out, columns=[*key, "m", "triangle"])

    def choose(own: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = None
        for m in range(first, most + 1):
            r = np.vstack([np.reshape(t, (m + 2, m + 2)) for t in rows.loc[rows["m"] == m, "triangle"]])
            x, rss = _solution(_triangle(r))
            found = (*own, m, mu(x[1:]), x[0], x[1:].tolist(), rss)
            if found[len(own) + 1] < stop:
                break
        return pd.DataFrame([found], columns=[*key, "m", "mu", "series", "resistances", "rss"])

    triangles = p.mapInPandas(reduce, f"{kinds}, m int, triangle array<double>")
    best = triangles.groupBy(key).applyInPandas(choose, f"{kinds}, m int, mu double, series double, resistances array<double>, rss double")
    return best.join(ends, key)


def residuals(points: DataFrame, fits: DataFrame, key: list[str]) -> DataFrame:
    """Each point with its fitted impedance and the residuals as shares of the measured magnitude: fit_re, fit_im, res_re, res_im."""
    w = 2 * math.pi * F.col("freq_hz")

    def part(share):
        tau = lambda i: F.exp(F.log("tau_min") + i / (F.col("m") - 1) * F.log(F.col("tau_max") / F.col("tau_min")))
        return F.aggregate(F.transform("resistances", lambda r, i: r * share(w * tau(i))), F.lit(0.0), lambda a, x: a + x)

    d = points.join(fits, key).withColumns({"fit_re": F.col("series") + part(lambda x: 1 / (1 + x * x)), "fit_im": part(lambda x: -x / (1 + x * x))})
    size = F.hypot("z_re", "z_im")
    return d.select(*points.columns, "fit_re", "fit_im", F.when(size > 0, (F.col("z_re") - F.col("fit_re")) / size).alias("res_re"), F.when(size > 0, (F.col("z_im") - F.col("fit_im")) / size).alias("res_im"))
