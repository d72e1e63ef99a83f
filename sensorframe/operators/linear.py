"""Least-squares fits of many small models at once: moments by aggregation, systems of up to three regressors solved a batch at a time.

A model is an intercept and up to three regressors. Rows of observations are exploded by model and summed once into cells of (key, model,
fold); a fit of all rows, of all but one fold, or of a penalised model is arithmetic on those sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

P = 3
EPSILON = 2.220446049250313e-16
_PAIRS = [(j, k) for j in range(1, P + 1) for k in range(j, P + 1)]
_TERMS = ["", *(f"{j}" for j in range(1, P + 1)), "t", *(f"{j}{k}" for j, k in _PAIRS), *(f"{j}t" for j in range(1, P + 1)), "tt"]
SUMS = [kind + term for kind in ("w", "u") for term in _TERMS]


#: Names of columns that sums and fits add.
RESERVED = {*SUMS, "model", "place", "p", "precision", "prior", "z1", "z2", "z3", "t", "m1", "m2", "m3", "mt", "a0", "b1", "b2", "b3", "intercept", "n", "parameters", "rss", "wrss", "s2"}


@dataclass(frozen=True)
class Model:
    """Regressors and the part of the target that is known are SQL expressions of an observation; ``prior`` is a value and standard
    deviation for the first regressor's coefficient, which counts as one more observation."""

    name: str
    regressors: tuple[str, ...] = ()
    offset: str = "0.0"
    prior: tuple[float, float] | None = None


def expand(obs: DataFrame, models: list[Model], y: str, w: str, keep: list[str]) -> DataFrame:
    """A row per observation and model: ``keep``, model, place (the model's number), p (regressors), z1 to z3 (0 beyond p), t, w, and the
    prior's precision and value. Rows that lack a value of their model go."""

    if taken := RESERVED & set(keep):
        raise ValueError(f"columns of these names are made here, rename yours: {sorted(taken)}")

    def one(i: int, m: Model) -> Column:
        z = [F.expr(r) for r in m.regressors] + [F.lit(0.0)] * (P - len(m.regressors))
        precision, value = (1 / m.prior[1] ** 2, m.prior[0]) if m.prior else (0.0, 0.0)
        return F.struct(
            F.lit(m.name).alias("model"), F.lit(i).alias("place"), F.lit(len(m.regressors)).alias("p"), *(c.cast("double").alias(f"z{j}") for j, c in enumerate(z, 1)),
            (F.col(y) - F.expr(m.offset)).cast("double").alias("t"), F.lit(precision).alias("precision"), F.lit(value).alias("prior"),
        )

    out = obs.withColumn("_m", F.explode(F.array(*(one(i, m) for i, m in enumerate(models))))).select(*keep, F.col(w).cast("double").alias("w"), "_m.*")
    return out.where(reduce(Column.__and__, (F.col(c).isNotNull() & ~F.isnan(c) for c in ("w", "t", "z1", "z2", "z3"))) & (F.col("w") > 0))


def cells(rows: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Sums of the exploded rows per ``by``, weighted (w...) and plain (u...), around the plain means per ``key`` and model, which are returned as
    m1 to m3 and mt. ``by`` holds ``key`` and model; sums of cells with one centre add up.

    All steps need the rows by ``key`` alone: observations that were dealt by it before they were exploded are not dealt again."""
    constant = ("place", "p", "precision", "prior")
    means = rows.groupBy(*key, "model").agg(*(F.avg(f"z{j}").alias(f"m{j}") for j in range(1, P + 1)), F.avg("t").alias("mt"), *(F.first(c).alias(c) for c in constant))
    centre = [*(f"m{j}" for j in range(1, P + 1)), "mt", *constant]
    # as many entries as there are models
    means = means.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct(*centre)))).alias("_c"))
    used = list(dict.fromkeys([*by, "w", "t", *(f"z{j}" for j in range(1, P + 1))]))
    d = rows.select(used).join(means.hint("shuffle_hash"), key).withColumn("_c", F.element_at("_c", F.col("model"))).select(*used, "_c.*")
    v = {str(j): F.col(f"z{j}") - F.col(f"m{j}") for j in range(1, P + 1)} | {"t": F.col("t") - F.col("mt")}
    sums = [F.sum(reduce(Column.__mul__, (v[c] for c in name[1:]), F.col("w") if name[0] == "w" else F.lit(1.0))).alias(name) for name in SUMS]
    return d.groupBy(by).agg(*sums, *(F.first(c).alias(c) for c in (*constant, "m1", "m2", "m3", "mt")))


SOLVED = ["a0", "b1", "b2", "b3", "intercept", "v11", "v12", "v13", "v22", "v23", "v33"]


def solve(sums: DataFrame, kind: str = "w", squares: tuple[str, ...] = ("u", "w"), least: float = 1e-12) -> DataFrame:
    """From the sums of one kind: adds b1 to b3 (0 for what a model has not), a0 (the intercept around the means), intercept, v11 to v33
    (the inverse of the system without the intercept) and, for each prefix in ``squares``, ss_<prefix>, the sum of squared residuals
    over the sums named so. All are null where the regressors do not determine them (a regressor's part that
    the others do not explain is under ``least``), or the rows are fewer than the coefficients.

    The intercept is eliminated first, then the system is factored as L D L', for a batch of rows of sums at a time."""
    names = [*SOLVED, *(f"ss_{x}" for x in squares)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema] + [f"{n} double" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names) if pa.types.is_floating(batch.schema.types[i]) or c == "p"}
            with np.errstate(all="ignore"):
                out = _solved(at, kind, squares, least)
            fine = np.isfinite(out[3])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, mask=~(fine & np.isfinite(x))) for x in out)], [*batch.schema.names, *names])

    return sums.mapInArrow(run, ", ".join(fields))


def _solved(at: dict[str, np.ndarray], kind: str, squares: tuple[str, ...], least: float) -> list[np.ndarray]:
    p, w, c = at["p"], at[kind], {}
    for j, k in _PAIRS:
        c[j, k] = at[f"{kind}{j}{k}"] - at[f"{kind}{j}"] * at[f"{kind}{k}"] / w + (at["precision"] if (j, k) == (1, 1) else 0)
        c[j, k] = np.where(p >= k, c[j, k], float(j == k))
    t = [at[f"{kind}{j}t"] - at[f"{kind}{j}"] * at[f"{kind}t"] / w + (at["precision"] * at["prior"] if j == 1 else 0) for j in range(1, P + 1)]
    t = [np.where(p >= j, x, 0.0) for j, x in enumerate(t, 1)]
    l21, l31 = c[1, 2] / c[1, 1], c[1, 3] / c[1, 1]
    d2, e32 = c[2, 2] - l21 * c[1, 2], c[2, 3] - l31 * c[1, 2]
    l32 = e32 / d2
    d3 = c[3, 3] - l31 * c[1, 3] - l32 * e32
    fine = (c[1, 1] > 1e-12) & (d2 > least * np.maximum(c[2, 2], 1)) & (d3 > least * np.maximum(c[3, 3], 1)) & (at["u"] >= p + 1)
    y2 = t[1] - l21 * t[0]
    b3 = np.where(fine, (t[2] - l31 * t[0] - l32 * y2) / d3, np.nan)
    b2 = y2 / d2 - l32 * b3
    b1 = t[0] / c[1, 1] - l21 * b2 - l31 * b3
    b, n31 = (b1, b2, b3), l32 * l21 - l31
    v = [1 / c[1, 1] + l21 * l21 / d2 + n31 * n31 / d3, -l21 / d2 - n31 * l32 / d3, n31 / d3, 1 / d2 + l32 * l32 / d3, -l32 / d3, 1 / d3]
    a0 = (at[f"{kind}t"] - sum(x * at[f"{kind}{j}"] for j, x in enumerate(b, 1))) / w
    intercept = at["mt"] + a0 - sum(x * at[f"m{j}"] for j, x in enumerate(b, 1))
    out = [a0, b1, b2, b3, intercept, *v]
    for prefix in squares:
        s = lambda term, prefix=prefix: at[prefix + term]
        total = s("tt") - 2 * a0 * s("t") + a0 * a0 * s("")
        for j, x in enumerate(b, 1):
            total = total - 2 * x * s(f"{j}t") + 2 * a0 * x * s(f"{j}")
        for j, k in _PAIRS:
            total = total + (1 if j == k else 2) * b[j - 1] * b[k - 1] * s(f"{j}{k}")
        out.append(np.maximum(total, 0))
    return out


def fit(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row per key and model of :func:`expand`: n, parameters, intercept, b1 to b3 with their standard errors, rss, wrss, rmse, r2, adj_r2,
    aic, aicc, bic. Models that the rows do not determine have nulls."""
    by = [*key, "model"]
    return described(solve(cells(rows, by, key)))


def described(s: DataFrame) -> DataFrame:
    c, n = F.col, F.col("u")
    s = s.withColumn("parameters", (c("p") + 1).cast("bigint")).withColumnsRenamed({"ss_u": "rss", "ss_w": "wrss"})
    penalty = c("precision") * (c("b1") - c("prior")) ** 2
    s = s.withColumn("_free", n + F.when(c("precision") > 0, 1).otherwise(0) - c("parameters")).withColumn("s2", F.when(c("_free") > 0, (c("wrss") + penalty) / c("_free")).otherwise(0.0))
    m = {j: c(f"m{j}") + c(f"w{j}") / c("w") for j in range(1, P + 1)}
    at_zero = 1 / c("w") + sum((1 if j == k else 2) * F.when(c("p") >= k, m[j] * m[k] * c(f"v{j}{k}")).otherwise(0.0) for j, k in _PAIRS)
    s = s.withColumn("intercept_se", F.sqrt(c("s2") * at_zero)).withColumns({f"b{j}_se": F.when(c("p") >= j, F.sqrt(c("s2") * c(f"v{j}{j}"))) for j in range(1, P + 1)})
    s = s.withColumns({f"b{j}": F.when(c("p") >= j, c(f"b{j}")) for j in range(1, P + 1)})
    k, aic = c("parameters"), n * F.log(F.greatest(c("rss"), F.lit(EPSILON)) / n) + 2 * F.col("parameters")
    total = c("utt") - c("ut") * c("ut") / n
    s = s.withColumns({
        "n": n.cast("bigint"), "rmse": F.sqrt(c("rss") / n), "aic": aic, "aicc": F.when(n > k + 1, aic + 2.0 * k * (k + 1) / (n - k - 1)), "bic": aic - 2 * k + k * F.log(n),
        "r2": F.when(total > 0, 1 - c("rss") / total), "adj_r2": F.when((total > 0) & (n > k + 1), 1 - c("rss") / total * (n - 1) / (n - k - 1)),
    })
    return s.drop("_free")



def fit_and_validate(rows: DataFrame, key: list[str], fold: list[str]) -> DataFrame:
    """:func:`fit` of every model, with leave-one-fold-out validation from the same sums: cv_rmse, cv_bias, cv_n (rows predicted), cv_failed
    (rows of folds whose training rows do not determine the model). The rows are summed once, into cells of a fold; a fold's
    training sums are the totals less its own, and its errors come from its own sums, so no row is read again.

    Rows with null folds make a fold of their own. Fewer than three rows of a model validate nothing."""
    by = [*key, "model"]
    c = cells(rows, [*by, *fold], key)
    carried = ["place", "p", "precision", "prior", "m1", "m2", "m3", "mt"]
    whole = W.partitionBy(by)  # as many rows as there are folds
    own = c.withColumnsRenamed({s: f"own_{s}" for s in SUMS}).withColumns({f"all_{s}": F.sum(f"own_{s}").over(whole) for s in SUMS})
    train = solve(own.withColumns({s: F.col(f"all_{s}") - F.col(f"own_{s}") for s in SUMS}), squares=("own_u",))
    u, least = F.col("own_u"), F.col("all_u") >= 3
    fine, a, b = least & F.col("b1").isNotNull(), F.col("a0"), {j: F.col(f"b{j}") for j in range(1, P + 1)}
    bias = a * u + sum(b[j] * F.col(f"own_u{j}") for j in b) - F.col("own_ut")
    predicted = F.sum(F.when(fine, u))
    total = train.groupBy(by).agg(
        *(F.first(f"all_{s}").alias(s) for s in SUMS), *(F.first(x).alias(x) for x in carried),
        F.sqrt(F.sum(F.when(fine, F.col("ss_own_u"))) / predicted).alias("cv_rmse"), (F.sum(F.when(fine, bias)) / predicted).alias("cv_bias"),
        F.sum(F.when(fine, u).when(least, 0)).cast("bigint").alias("cv_n"), F.sum(F.when(least & ~fine, u).when(least, 0)).cast("bigint").alias("cv_failed"),
    )
    return described(solve(total))


def choose(fits: DataFrame, key: list[str], criterion: str = "aicc") -> DataFrame:
    """Adds delta to the best score of a key, Akaike-style weight and ``selected``. AICc falls back to AIC where there are too few rows;
    of models within 1e-12 of the best the last is taken; models without a score take no part."""
    score = {"aic": F.col("aic"), "aicc": F.coalesce("aicc", "aic"), "bic": F.col("bic"), "cv": F.col("cv_rmse")}[criterion]
    w = W.partitionBy(key)  # as many rows as there are models
    f = fits.withColumn("_score", F.when(F.col("b1").isNotNull() | ((F.col("p") == 0) & F.col("intercept").isNotNull()), score))
    f = f.withColumn("delta", F.col("_score") - F.min("_score").over(w)).withColumn("_e", F.exp(-F.col("delta") / 2))
    tied = F.when(F.abs("delta") < 1e-12, F.col("place"))
    return f.withColumns({"weight": F.col("_e") / F.sum("_e").over(w), "selected": F.coalesce(tied == F.max(tied).over(w), F.lit(False))}).drop("_score", "_e")


def numbered(rows: DataFrame, key: list[str], block: Column, order: list[str], out: str) -> DataFrame:
    """Adds 0, 1, ... per key in the order of ``block`` and then ``order``. Rows are numbered per key and block, then blocks are added up, so a key
    with very many rows is dealt over its blocks; ``block`` must not fall as ``order`` rises."""
    d = rows.withColumn("_block", block)
    sizes = d.groupBy(*key, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*key, "_block", before.alias("_before"))
    d = d.withColumn("_own", F.row_number().over(W.partitionBy(*key, "_block").orderBy(order)))
    return d.join(sizes, [*key, "_block"]).withColumn(out, F.col("_before") + F.col("_own") - 1).drop("_block", "_before", "_own")


def drawn(seed: int, replicate: Column, number: Column, n: Column) -> Column:
    """A number in 0 .. n - 1 that depends on seed, replicate and number alone: the first 48 bits of an MD5 digest, modulo n."""
    text = F.concat_ws(":", F.lit(seed), replicate.cast("string"), number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("bigint") % n


def _joined_sums(d: DataFrame, key: list[str], block: Column, order: list[str], replicates: int, seed: int) -> DataFrame:
    """The sums of :func:`_drawn_sums` for keys of any length, by a join of all draws with their residuals."""
    d = numbered(d, key, block, order, "i")
    each = d.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("i", drawn(seed, F.col("replicate"), F.col("i"), F.col("f_n")))
    each = each.select(*key, "replicate", "i", "w", "d1", "d2", "d3", "f_w", "p", "precision", "prior").join(d.select(*key, "i", "e"), [*key, "i"])
    return each.groupBy(*key, "replicate").agg(
        (F.sum(F.col("w") * F.col("e")) / F.first("f_w")).alias("g0"), *(F.sum(F.col("w") * F.col(f"d{j}") * F.col("e")).alias(f"g{j}") for j in range(1, P + 1)),
        *(F.first(x).alias(x) for x in ("p", "precision", "prior")),
    )


#: Rows of a key that :func:`bootstrap` draws from in the memory of a task; longer keys' draws are joined.
TOGETHER = 1 << 16
_AT_ONCE = 1 << 20


def _drawn_sums(d: DataFrame, key: list[str], order: list[str], replicates: int, seed: int) -> DataFrame:
    """Per key and replicate g0 to g3, the sums of weight (and weighted regressors) times the drawn residual, and p, precision, prior. Rows come to
    a task in order, a key at a time. The digests depend on replicate and number alone, so a task makes each once for all its keys."""
    kept = ["e", "w", "d1", "d2", "d3", "p", "precision", "prior"]
    rows = d.select(*key, *(F.col(c).cast("double").alias(f"_{c}") for c in kept), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    rows = rows.repartition(*key).sortWithinPartitions(*key, *(f"_o{i}" for i in range(len(order)))).select(*key, *(f"_{c}" for c in kept))
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in key) + ", replicate int, g0 double, g1 double, g2 double, g3 double, p int, precision double, prior double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now, parts = np.empty((replicates, 0), np.int64), None, []

        def one() -> pa.RecordBatch:
            nonlocal table
            x = np.concatenate(parts)
            n, step = len(x), max(1, _AT_ONCE // replicates)
            if n > table.shape[1]:
                new = range(table.shape[1], max(n, 2 * table.shape[1]))
                table = np.hstack([table, np.array([[int(md5(b"%d:%d:%d" % (seed, r, i)).hexdigest()[:12], 16) for i in new] for r in range(replicates)])])
            g = np.zeros((replicates, 4))
            for at in range(0, n, step):
                g += x[table[:, at : min(at + step, n)] % n, 0] @ (x[at : at + step, 1:2] * np.column_stack([np.ones(min(step, n - at)), x[at : at + step, 2:5]]))
            g[:, 0] /= x[:, 1].sum()
            same = [pa.repeat(v, replicates) for v in (*now, *(pa.scalar(v, k) for v, k in zip((int(x[0, 5]), x[0, 6], x[0, 7]), (pa.int32(), pa.float64(), pa.float64()), strict=True)))]
            k = len(key)
            return pa.RecordBatch.from_arrays([*same[:k], pa.array(np.arange(replicates, dtype=np.int32)), *map(pa.array, g.T.copy()), *same[k:]], [*key, "replicate", "g0", "g1", "g2", "g3", "p", "precision", "prior"])

        for batch in batches:
            x = np.column_stack([batch.column(len(key) + i).to_numpy(zero_copy_only=False) for i in range(len(kept))])
            new = np.zeros(batch.num_rows, bool)
            for i in range(len(key)):
                code = batch.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            starts = [0, *np.flatnonzero(new), batch.num_rows] if batch.num_rows else []
            for a, b in zip(starts, starts[1:], strict=False):
                own = tuple(batch.column(i)[a] for i in range(len(key)))
                if parts and own != now:
                    yield one()
                    parts = []
                now = own
                parts.append(x[a:b])
        if parts:
            yield one()

    return rows.mapInArrow(run, kinds)


def bootstrap(rows: DataFrame, fits: DataFrame, key: list[str], block: Column, order: list[str], *, replicates: int = 200, level: float = 0.95, seed: int = 42, least_share: float = 0.5, together: int = TOGETHER) -> DataFrame:
    """Residual bootstrap of one fitted model a key: percentile intervals of the intercept and coefficients.

    ``rows`` are the exploded rows of the models in ``fits`` (:func:`fit`, one row a key; give a written table, it is read again) with ``order``
    columns. In each replicate the row numbered i gets the residual of the row numbered ``drawn(...)``; the system's inverse is known, so
    a refit needs three sums. Keys of up to ``together`` rows draw inside a task, where only numbers of one key are held; longer ones'
    draws are joined row by row. Returns key, replicates, succeeded and lower and upper ends, null where fewer than ``least_share`` succeeded."""
    keep = [*key, "model", "intercept", "b1", "b2", "b3", "v11", "v12", "v13", "v22", "v23", "v33", "w", "w1", "w2", "w3", "m1", "m2", "m3", "n"]
    f = fits.where("intercept IS NOT NULL").select([F.col(x).alias(f"f_{x}") if x not in (*key, "model") else F.col(x) for x in keep])
    b = {j: F.coalesce(F.col(f"f_b{j}"), F.lit(0.0)) for j in range(1, P + 1)}
    mid = {j: F.col(f"f_m{j}") + F.col(f"f_w{j}") / F.col("f_w") for j in range(1, P + 1)}

    def left(f: DataFrame) -> DataFrame:
        d = rows.join(f, [*key, "model"]).withColumn("e", F.col("t") - F.col("f_intercept") - sum(b[j] * F.col(f"z{j}") for j in b))
        return d.withColumns({f"d{j}": F.col(f"z{j}") - mid[j] for j in b})

    g, long = _drawn_sums(left(f.where(F.col("f_n") <= together)), key, order, replicates, seed), f.where(F.col("f_n") > together)
    if not long.isEmpty():
        g = g.unionByName(_joined_sums(left(long), key, block, order, replicates, seed))
    g = g.join(f, key)
    g = g.withColumn("g1", F.col("g1") + F.col("precision") * (F.col("prior") - b[1]))
    v = lambda j, k: F.when(F.col("p") >= max(j, k), F.col(f"f_v{min(j, k)}{max(j, k)}")).otherwise(0.0)
    g = g.withColumns({f"b{j}": b[j] + sum(v(j, k) * F.col(f"g{k}") for k in b) for j in b})
    level0 = F.col("f_intercept") + sum(b[j] * mid[j] for j in b) + F.col("g0")
    g = g.withColumn("intercept", level0 - sum(F.col(f"b{j}") * mid[j] for j in b))
    ends = {"lower": (1 - level) / 2, "upper": (1 + level) / 2}
    ok = F.count_if(F.col("intercept").isNotNull() & ~F.isnan("intercept"))
    enough = ok >= least_share * replicates
    names = {"intercept": F.lit(0), **{f"b{j}": F.lit(j) for j in b}}
    out = g.groupBy(key).agg(ok.alias("succeeded"), *(F.when(enough & (F.first("p") >= at), F.percentile(name, F.lit(q))).alias(f"{name}_{end}") for name, at in names.items() for end, q in ends.items()))
    return out.withColumn("replicates", F.lit(replicates).cast("bigint"))
