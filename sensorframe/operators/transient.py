"""Responses to events: four relaxation models fitted per segment by variable projection, their choice, features and warnings.

For given time constants a model is linear, so its best amplitudes come from sums, over a grid of time constants that is coarse and then finer
around the segment's best. Points are dealt by segment once, and a task takes many short segments through all rounds together. The points
of a long segment are exploded over the grid and reduced in one aggregation a round; it is not gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sensorframe.operators import linear
from sensorframe.sources.storage import dealt, written

#: Models in the order that decides between equal scores, with their number of parameters.
MODELS = {"single": 3, "double": 5, "double_drift": 6, "stretched": 4}


#: The part of a regressor that the others must leave unexplained: nearly equal time constants determine no amplitudes.
LEAST = 1e-6
#: Points of a segment that are fitted in the memory of a task; longer segments are exploded and reduced in each round.
TOGETHER = 1 << 16
#: Points of short segments that a task fits together, and numbers of one array of theirs.
_POINTS, _AT_ONCE = 1 << 13, 1 << 18


@dataclass(frozen=True)
class Grid:
    """Time constants as powers of ten of the segment's duration, from ``low`` to ``high`` in ``steps`` intervals; exponents of the stretched
    model; ``finer`` rounds of half-steps around the best, each dividing the step by ``ratio``."""

    low: float = -2.0
    high: float = 1.0
    steps: int = 12
    betas: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9)
    beta_low: float = 0.05
    beta_high: float = 1.0
    rounds: int = 5
    ratio: float = 3.0

    @property
    def step(self) -> float:
        return (self.high - self.low) / self.steps


@dataclass(frozen=True)
class Limits:
    """When a fit is flagged."""

    tau_to_window: float = 1.0
    tau_ratio: float = 3.0
    amplitude_share: float = 0.05
    autocorrelation: float = 0.8


def _coarse(models: list[str], grid: Grid) -> list[tuple[str, float, float, float]]:
    """(model, log10 of the fast and of the slow time constant, exponent); 0 stands for what a model has not."""
    taus = [grid.low + grid.step * i for i in range(grid.steps + 1)]
    out = []
    for m in models:
        if m == "single":
            out += [(m, a, 0.0, 1.0) for a in taus]
        elif m == "stretched":
            out += [(m, a, 0.0, b) for a in taus for b in grid.betas]
        else:
            out += [(m, a, b, 1.0) for a in taus for b in taus if a < b]
    return out


def _candidate(model: Column, fast: Column, slow: Column, beta: Column) -> Column:
    return F.struct(model.alias("model"), fast.alias("fast"), slow.alias("slow"), beta.alias("beta"))


def _around(best: DataFrame, key: list[str], grid: Grid, round_: int) -> DataFrame:
    """Candidates beside each segment's best of every model."""
    step = grid.step / grid.ratio**round_
    moves = F.array(*(F.lit(step * i) for i in range(-2, 3)))
    none = F.array(F.lit(0.0))
    two, bent = F.col("model").startswith("double"), F.col("model") == "stretched"
    c = best.withColumn("_f", F.explode(moves)).withColumn("_s", F.explode(F.when(two, moves).otherwise(none)))
    betas = F.array(*(F.lit(0.2 / grid.ratio**round_ * i) for i in range(-2, 3)))
    c = c.withColumn("_b", F.explode(F.when(bent, betas).otherwise(none)))
    beta = F.greatest(F.lit(grid.beta_low), F.least(F.lit(grid.beta_high), F.col("beta") + F.col("_b")))
    c = c.select(*key, "model", (F.col("fast") + F.col("_f")).alias("fast"), (F.col("slow") + F.col("_s")).alias("slow"), F.when(bent, beta).otherwise(1.0).alias("beta"))
    return c.where(~F.col("model").startswith("double") | (F.col("fast") < F.col("slow"))).distinct()


def _reduced(points: DataFrame, key: list[str]) -> DataFrame:
    """Fits of points exploded by candidate: one row per key and candidate."""
    span, t = F.col("_span"), F.col("_t")
    tau = {n: F.pow(F.lit(10.0), F.col(n)) * span for n in ("fast", "slow")}
    two = F.col("model").startswith("double")
    p = points.withColumns({
        "z1": F.exp(-F.when(F.col("model") == "stretched", F.pow(t / tau["fast"], F.col("beta"))).otherwise(t / tau["fast"])),
        "z2": F.when(two, F.exp(-t / tau["slow"])).otherwise(0.0), "z3": F.when(F.col("model") == "double_drift", t / span).otherwise(0.0),
    })
    by = [*key, "model", "fast", "slow", "beta"]
    n, names = F.count("*").cast("double"), {"1": "z1", "2": "z2", "3": "z3", "t": "_v"}
    pairs = [("1", "1"), ("1", "2"), ("1", "3"), ("2", "2"), ("2", "3"), ("3", "3"), ("1", "t"), ("2", "t"), ("3", "t"), ("t", "t")]
    sums = {a + b: n * F.covar_pop(names[a], names[b]) for a, b in pairs}
    g = p.groupBy(by).agg(n.alias("u"), F.first("_span").alias("span"), *(F.avg(z).alias(f"m{i}") for i, z in names.items()), *(s.alias(f"u{c}") for c, s in sums.items()))
    regressors = F.when(F.col("model") == "double_drift", 3).when(two, 2).otherwise(1)
    zero = {f"u{c}": F.lit(0.0) for c in names}  # sums are around the means already
    g = linear.solve(g.withColumns({"p": regressors, "precision": F.lit(0.0), "prior": F.lit(0.0), **zero}), "u", ("u",), LEAST)
    g = g.withColumns({"n": F.col("u").cast("bigint"), "rss": F.col("ss_u")})
    return g.withColumns({"rmse": F.sqrt(F.col("rss") / F.col("u")), "r2": F.when(F.col("utt") > 0, 1 - F.col("rss") / F.col("utt"))})


_FITTED = ["fast", "slow", "beta", "span", "n", "intercept", "b1", "b2", "b3", "rss", "rmse", "r2"]


class _Segments:
    """Points of several segments, one after another, and the best fit of a model to each by a list of candidates."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([len(t) for t, _ in parts])
        self.starts = np.append(0, np.cumsum(self.n)[:-1])
        self.t, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.span = np.maximum.reduceat(self.t, self.starts)
        self.mean = self.sums(v) / self.n
        self.v = v - self.each(self.mean)
        self.total = self.sums(self.v * self.v)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=-1)

    def each(self, x: np.ndarray) -> np.ndarray:
        return np.repeat(x, self.n, axis=-1)

    def best(self, model: str, fast: np.ndarray, slow: np.ndarray, beta: np.ndarray) -> dict[str, np.ndarray]:
        """Of candidates (rows) of every segment (columns) the first with the least squared residuals, infinite where none is determined."""
        found = {c: np.zeros(len(self.n)) for c in ("fast", "slow", "beta", "intercept", "b1", "b2", "b3")} | {"rss": np.full(len(self.n), np.inf)}
        step = max(1, _AT_ONCE // len(self.t))
        for at in range(0, len(fast), step):
            own = {"fast": fast[at : at + step], "slow": slow[at : at + step], "beta": beta[at : at + step]}
            own |= self._tried(model, **own)
            i, columns = own["rss"].argmin(0), np.arange(len(self.n))
            better = own["rss"][i, columns] < found["rss"]
            for c, x in found.items():
                found[c] = np.where(better, own[c][i, columns], x)
        return found

    def _tried(self, model: str, fast: np.ndarray, slow: np.ndarray, beta: np.ndarray) -> dict[str, np.ndarray]:
        r = self.t / self.each(10.0**fast * self.span)
        z = [np.exp(-(r ** self.each(beta) if model == "stretched" else r))]
        if model.startswith("double"):
            z.append(np.exp(-self.t / self.each(10.0**slow * self.span)))
        if model == "double_drift":
            z.append(np.broadcast_to(self.t / self.each(self.span), r.shape))
        means = [self.sums(x) / self.n for x in z]
        z = [x - self.each(m) for x, m in zip(z, means, strict=True)]
        # each regressor is freed of those before it point by point: sums of products alone lose half the digits of nearly alike ones
        p, left, low, y, fine = len(z), self.v, {}, [], fast < slow if len(z) > 1 else np.ones(fast.shape, bool)
        for k in range(p):
            whole = self.sums(z[k] * z[k])
            for j in range(k):
                low[k, j] = self.sums(z[j] * z[k]) / self.sums(z[j] * z[j])
                z[k] = z[k] - self.each(low[k, j]) * z[j]
            d = self.sums(z[k] * z[k])
            fine &= d > (1e-12 if k == 0 else LEAST * np.maximum(whole, 1))
            y.append(self.sums(z[k] * left) / d)
            left = left - self.each(y[k]) * z[k]
        b: list = [None] * p
        for k in reversed(range(p)):
            b[k] = y[k] - sum(low[j, k] * b[j] for j in range(k + 1, p))
        rss = self.sums(left * left)
        out = {f"b{j + 1}": b[j] if j < p else np.zeros(fast.shape) for j in range(3)}
        return out | {"intercept": self.mean - sum(x * m for x, m in zip(b, means, strict=True)), "rss": np.where(fine & np.isfinite(rss), rss, np.inf)}

    def fitted(self, model: str, grid: Grid) -> dict[str, np.ndarray]:
        """The best of the coarse grid and then of the finer ones around it."""
        first = [x[:, None] for x in np.array([x[1:] for x in _coarse([model], grid)]).T]
        found = self.best(model, *(np.broadcast_to(x, (len(x), len(self.n))) for x in first))
        two, bent, moves = model.startswith("double"), model == "stretched", np.arange(-2, 3)
        for i in range(1, grid.rounds + 1):
            step, gap = grid.step / grid.ratio**i, 0.2 / grid.ratio**i
            a, b = (x.reshape(-1, 1) for x in np.meshgrid(moves, moves if two or bent else 0, indexing="ij"))
            beta = np.clip(found["beta"] + gap * b, grid.beta_low, grid.beta_high) if bent else np.broadcast_to(found["beta"], (len(a), len(self.n)))
            found = self.best(model, found["fast"] + step * a, found["slow"] + step * b * two, beta)
        return found


def _fitted_in_tasks(points: DataFrame, key: list[str], models: list[str], grid: Grid, together: int) -> DataFrame:
    """Best fits of segments of up to ``together`` points. A task holds one segment, or short ones of some thousand points."""
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in key)
    rows = dealt(points.select(*key, "_t", "_v"), key).sortWithinPartitions(*key, "_t", "_v")
    names, least = [*key, "model", *_FITTED], min(MODELS[m] for m in models) + 2

    def fits(keys: list[tuple], parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            for m in models:
                of = [i for i, (t, _) in enumerate(parts) if len(t) >= MODELS[m] + 2]
                if not of:
                    continue
                s = _Segments([parts[i] for i in of])
                found = s.fitted(m, grid)
                keep = np.flatnonzero(np.isfinite(found["rss"]))
                found |= {"span": s.span, "n": s.n, "rmse": np.sqrt(found["rss"] / s.n), "r2": np.where(s.total > 0, 1 - found["rss"] / s.total, np.nan)}
                own = [pa.array([keys[of[i]][j].as_py() for i in keep], keys[0][j].type) for j in range(len(key))]
                columns = [pa.array(found[c][keep], mask=np.isnan(found[c][keep]) if c == "r2" else None) for c in _FITTED]
                yield pa.RecordBatch.from_arrays([*own, pa.array([m] * len(keep), pa.string()), *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held, now, open_, size = [], [], 0, None, [], 0

        def close() -> None:
            nonlocal held
            if least <= size <= together:
                t, v = (np.concatenate(x) for x in zip(*open_, strict=True))
                if t.max() > 0:
                    keys.append(now)
                    parts.append((t, v))
                    held += size

        for batch in batches:
            t, v = (batch.column(len(key) + i).to_numpy() for i in range(2))
            new = np.zeros(batch.num_rows, bool)
            for i in range(len(key)):
                code = batch.column(i).dictionary_encode().indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            starts = [0, *np.flatnonzero(new), batch.num_rows] if batch.num_rows else []
            for a, b in zip(starts, starts[1:], strict=False):
                own = tuple(batch.column(i)[a] for i in range(len(key)))
                if own != now:
                    close()
                    now, open_, size = own, [], 0
                    if held >= _POINTS:
                        yield from fits(keys, parts)
                        keys, parts, held = [], [], 0
                size += b - a
                if size <= together:
                    open_.append((t[a:b].copy(), v[a:b].copy()))
                else:
                    open_ = []
        close()
        if parts:
            yield from fits(keys, parts)

    return rows.mapInArrow(run, f"{kinds}, model string, " + ", ".join(f"{c} {'bigint' if c == 'n' else 'double'}" for c in _FITTED))


def _fitted_by_rounds(d: DataFrame, spans: DataFrame, key: list[str], models: list[str], grid: Grid) -> DataFrame:
    """Best fits of the segments in ``spans`` by an aggregation of exploded points in each round."""
    d = d.join(spans, key)
    first = F.array(*(_candidate(*map(F.lit, c)) for c in _coarse(models, grid)))
    need = F.create_map(*(F.lit(x) for m, k in MODELS.items() for x in (m, k + 2)))
    d = d.select(*key, "_t", "_v", "_span", "_n")
    each = d.withColumn("_c", F.explode(first)).select(*key, "_t", "_v", "_span", "_n", "_c.*").where(F.col("_n") >= F.element_at(need, F.col("model"))).drop("_n")
    best = _best(_reduced(each, key), key)
    for i in range(1, grid.rounds + 1):
        each = d.join(_around(best, key, grid, i), key)
        best = _best(_reduced(each.drop("_n"), key), key)
    return best


def fit_responses(points: DataFrame, key: list[str], *, t: str = "local", y: str = "v", models: tuple[str, ...] = tuple(MODELS), grid: Grid = Grid(), together: int = TOGETHER) -> DataFrame:
    """The best fit of every model to each segment: key, model, n, parameters, duration, tau_fast, tau_slow, beta, e_infinity, a_fast, a_slow, drift,
    rss, rmse, r2, adj_r2, aic, aicc, bic. The response is e_infinity + a_fast exp(-(t / tau_fast)^beta) + a_slow exp(-t / tau_slow) +
    drift t; parameters that a model has not are null.

    Points with null or negative times or values that are no numbers are left out, and those of null keys. A model needs two points more than it has
    parameters, and candidates that the points do not determine drop out; a segment without any fit of a model has no row for it. Time
    constants are as exact as the last grid's step (by default 10^(0.25 / 243), 0.3 %). Segments of up to ``together`` points go through all
    rounds in one visit of a task; longer ones' points are exploded and reduced in each round."""
    if taken := (linear.RESERVED | {"fast", "slow", "beta", "span"}) & set(key):
        raise ValueError(f"columns of these names are made here, rename yours: {sorted(taken)}")
    d = points.where((F.col(t) >= 0) & ~F.isnan(t) & F.col(y).isNotNull() & ~F.isnan(y)).where(" AND ".join(f"`{c}` IS NOT NULL" for c in key)).select(*key, F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_v"))
    best = _fitted_in_tasks(d, key, list(models), grid, together)
    long = d.groupBy(key).agg(F.max("_t").alias("_span"), F.count("*").alias("_n")).where((F.col("_span") > 0) & (F.col("_n") > together))
    if not long.isEmpty():
        best = best.unionByName(_fitted_by_rounds(d, long, key, list(models), grid))
    c, two = F.col, F.col("model").startswith("double")
    tau = lambda name: F.pow(F.lit(10.0), c(name)) * c("span")
    k = F.element_at(F.create_map(*(F.lit(x) for m in MODELS.items() for x in m)), c("model"))
    n, rss = c("n"), F.greatest("rss", F.lit(linear.EPSILON))
    aic = n * F.log(rss / n) + 2 * k
    return best.select(
        *key, "model", "n", k.cast("bigint").alias("parameters"), c("span").alias("duration"), tau("fast").alias("tau_fast"), F.when(two, tau("slow")).alias("tau_slow"), F.when(c("model") == "stretched", c("beta")).alias("beta"),
        c("intercept").alias("e_infinity"), c("b1").alias("a_fast"), F.when(two, c("b2")).alias("a_slow"), F.when(c("model") == "double_drift", c("b3") / c("span")).alias("drift"), "rss", "rmse", "r2",
        F.when((n > k + 1) & c("r2").isNotNull(), 1 - (1 - c("r2")) * (n - 1) / (n - k - 1)).alias("adj_r2"), aic.alias("aic"), F.when(n > k + 1, aic + 2.0 * k * (k + 1) / (n - k - 1)).alias("aicc"), (aic - 2 * k + k * F.log(n)).alias("bic"),
    )


def _best(fits: DataFrame, key: list[str]) -> DataFrame:
    fits = fits.where("intercept IS NOT NULL").groupBy(*key, "model").agg(F.min_by(F.struct(*_FITTED), F.struct("rss", "fast", "slow", "beta")).alias("_b"))
    return fits.select(*key, "model", "_b.*")


def response(time: Column, prefix: str = "") -> Column:
    """The fitted response at a time, from the columns of :func:`fit_responses`."""
    c = lambda n: F.col(prefix + n)
    fast = c("a_fast") * F.exp(-F.pow(time / c("tau_fast"), F.coalesce(c("beta"), F.lit(1.0))))
    slow = F.coalesce(c("a_slow") * F.exp(-time / c("tau_slow")), F.lit(0.0))
    return c("e_infinity") + fast + slow + F.coalesce(c("drift") * time, F.lit(0.0))


def select_model(fits: DataFrame, key: list[str], criterion: str = "aic") -> DataFrame:
    """Adds delta, weight, ``selected`` (the lowest score; ties go to the first of ``MODELS``) and ``weak_support`` (delta over 10)."""
    place = F.element_at(F.create_map(*(F.lit(x) for i, m in enumerate(MODELS) for x in (m, i))), F.col("model"))
    w = W.partitionBy(key)  # a row a model
    f = fits.withColumn("delta", F.col(criterion) - F.min(criterion).over(w)).withColumn("_e", F.exp(-F.col("delta") / 2))
    first = F.row_number().over(w.orderBy(F.col(criterion).asc_nulls_last(), place)) == 1
    return f.withColumns({"weight": F.col("_e") / F.sum("_e").over(w), "selected": first, "weak_support": F.col("delta") > 10}).drop("_e")


def residual_statistics(points: DataFrame, fits: DataFrame, key: list[str], *, t: str = "local", y: str = "v", order: tuple[str, ...] = ()) -> DataFrame:
    """mae, max_abs, durbin_watson and lag1 of each fit's residuals in order of time (and ``order``)."""
    d = points.join(fits, key).withColumn("_r", F.col(y) - response(F.col(t)))
    d = d.withColumn("_before", F.lag("_r").over(W.partitionBy(*key, "model").orderBy(t, *order)))
    r, before = F.col("_r"), F.col("_before")
    rss = F.sum(r * r)
    return d.groupBy(*key, "model").agg(
        F.avg(F.abs(r)).alias("mae"), F.max(F.abs(r)).alias("max_abs"), F.when(F.count("*") > 1, F.sum((r - before) ** 2) / F.greatest(rss, F.lit(2.2250738585072014e-308))).alias("durbin_watson"),
        F.when((F.count("*") > 1) & (rss > linear.EPSILON), F.sum(r * before) / rss).alias("lag1"),
    )


def time_to_fraction(fraction: float, steps: int = 2000) -> Column:
    """When the fitted response has come a fraction of its way to e_infinity: the first crossing on a curve of ``steps`` points up to 20
    times the largest of time constant, window and one second, linear between points; 0 for a response that starts there, null without
    a crossing. The curves of a few hundred rows at a time are made in numpy."""

    @F.pandas_udf("double")
    def crossing(fast: pd.Series, slow: pd.Series, beta: pd.Series, a: pd.Series, b: pd.Series, drift: pd.Series, upper: pd.Series) -> pd.Series:
        out = np.full(len(fast), np.nan)
        share = np.arange(steps + 1) / steps
        for at in range(0, len(fast), 256):
            f, s, e, x, y, d, u = (c.to_numpy(float)[at : at + 256, None] for c in (fast, slow, beta, a, b, drift, upper))
            with np.errstate(all="ignore"):
                t = u * share
                r = t / f
                bent = (e != 1).ravel()
                r[bent] = r[bent] ** e[bent]
                away = np.abs(x * np.exp(-r) + y * np.exp(-t / s) + d * t)
                target = away[:, :1] * (1 - fraction)
                hit = away[:, 1:] <= target
                i = hit.argmax(1) + 1
                row = np.arange(len(i))
                before, after = away[row, i - 1], away[row, i]
                part = (before - target[:, 0]) / np.maximum(before - after, 2.2250738585072014e-308)
                found = t[row, i - 1] + (t[row, i] - t[row, i - 1]) * part
            found[~hit.any(1)] = np.nan
            found[away[:, 0] <= linear.EPSILON] = 0.0
            out[at : at + 256] = found
        return pd.Series(out)

    one, none = F.lit(1.0), F.lit(0.0)
    upper = 20.0 * F.greatest(F.coalesce("tau_slow", "tau_fast"), "duration", one)
    at = crossing("tau_fast", F.coalesce("tau_slow", one), F.coalesce("beta", one), "a_fast", F.coalesce("a_slow", none), F.coalesce("drift", none), upper)
    return F.nanvl(at, F.lit(None).cast("double"))


def features(fits: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds derived features (total_amplitude, initial_rate, t63, t90, t95) and flags: long_time_constant, poor_separation,
    negligible_amplitude, no_aicc, and high_autocorrelation where ``fits`` has lag1. A flag that does not apply to a model is false."""
    c = F.col
    largest = F.coalesce("tau_slow", "tau_fast")
    total = F.abs("a_fast") + F.abs("a_slow")
    share = F.least(F.abs("a_fast"), F.abs("a_slow")) / total
    rate = F.when(c("beta") < 1, None).otherwise(-c("a_fast") / c("tau_fast") - F.coalesce(c("a_slow") / c("tau_slow"), F.lit(0.0)) + F.coalesce("drift", F.lit(0.0)))
    flag = lambda x: F.coalesce(x, F.lit(False))
    out = fits.withColumns({
        "total_amplitude": c("e_infinity") - response(F.lit(0.0)), "initial_rate": rate, "t63": time_to_fraction(0.632), "t90": time_to_fraction(0.9), "t95": time_to_fraction(0.95),
        "long_time_constant": flag(largest / c("duration") > limits.tau_to_window), "poor_separation": flag(c("tau_slow") / c("tau_fast") < limits.tau_ratio),
        "negligible_amplitude": flag((total > 0) & (share < limits.amplitude_share)), "no_aicc": c("aicc").isNull(),
    })
    return out.withColumn("high_autocorrelation", flag(F.abs("lag1") > limits.autocorrelation)) if "lag1" in fits.columns else out


def analyze_transients(points: DataFrame, key: list[str], *, t: str = "local", y: str = "v", order: tuple[str, ...] = (), models: tuple[str, ...] = tuple(MODELS), grid: Grid = Grid(), criterion: str = "aic", limits: Limits = Limits(), together: int = TOGETHER) -> DataFrame:
    """Fits, residual statistics, choice, features and flags of every segment and model. Give a written table of points: it is read by
    the fits and by the statistics."""
    fits = written(fit_responses(points, key, t=t, y=y, models=models, grid=grid, together=together), "responses")
    fits = fits.join(residual_statistics(points, fits, key, t=t, y=y, order=order), [*key, "model"])
    return features(select_model(fits, key, criterion), limits)
