"""Model fitting: sufficient statistics by Spark, small solves on the driver.

Each pass is one aggregate over the rows; what comes back is a p x p matrix. Rows are
never collected.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorframe.functions.rates import sigmoid


@dataclass(frozen=True)
class Fit:
    names: tuple[str, ...]
    coef: np.ndarray
    se: np.ndarray
    loglik: float
    n: int

    @property
    def t(self) -> np.ndarray:
        return self.coef / np.where(self.se > 0, self.se, np.nan)

    def predictor(self) -> Column:
        """The linear predictor as a column expression."""
        return linear(self.names, self.coef)

    def table(self, spark) -> DataFrame:
        rows = [(n, float(c), float(s)) for n, c, s in zip(self.names, self.coef, self.se)]
        return spark.createDataFrame(rows, "term string, coef double, se double")


def column(name: str) -> Column:
    return F.lit(1.0) if name == "1" else F.col(name).cast("double")


def linear(names, coef) -> Column:
    return sum((column(n) * float(c) for n, c in zip(names, coef)), F.lit(0.0))


def kept(df: DataFrame, columns: list[str], more: list[str] = ()) -> DataFrame:
    """Complete rows of the columns that rounds of a fit read again; partitions that are lost are computed anew."""
    return df.select(*dict.fromkeys([*columns, *more])).dropna(subset=columns).persist()


def cross_products(df: DataFrame, names: list[str], weight: Column, target: Column, extra: dict[str, Column] | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """X'WX and X'Wz of the named columns ("1" is the intercept) and sums of extra, in one aggregate."""
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(weight * column(names[i]) * column(names[j])) for i, j in pairs] + [F.sum(weight * column(n) * target) for n in names]
    keys = list(extra or {})
    row = df.agg(*sums, *(F.sum(extra[k]) for k in keys), F.count(F.lit(1))).first()
    xx = np.zeros((p, p))
    for (i, j), v in zip(pairs, row):
        xx[i, j] = xx[j, i] = v or 0.0
    at = len(pairs)
    found = {k: row[at + p + i] for i, k in enumerate(keys)}
    return xx, np.array([v or 0.0 for v in row[at : at + p]]), found | {"n": row[-1]}


def ols(df: DataFrame, features: list[str], y: str) -> Fit:
    """Least squares with an intercept, by moments and a pseudo-inverse."""
    names = ["1", *features]
    clean = df.dropna(subset=[*features, y])
    xx, xy, s = cross_products(clean, names, F.lit(1.0), F.col(y).cast("double"), {"yy": F.col(y).cast("double") * F.col(y)})
    inverse = np.linalg.pinv(xx)
    coef = inverse @ xy
    rss = max((s["yy"] or 0.0) - coef @ xy, 0.0)
    sigma2 = rss / max(s["n"] - len(names), 1)
    n = s["n"]
    return Fit(tuple(names), coef, np.sqrt(np.maximum(np.diag(inverse) * sigma2, 0)), -n / 2 * (np.log(2 * np.pi * max(rss / max(n, 1), 1e-300)) + 1), n)


def logistic(df: DataFrame, features: list[str], y: str, weight: str | None = None, penalty: dict[str, float] | None = None, rounds: int = 30, intercept: bool = True) -> Fit:
    """Logistic regression by reweighted least squares; penalty is a ridge weight for each coefficient of its own.

    With weight, y is a count of successes among weight trials, so grouped rows do.
    """
    names = (["1"] if intercept else []) + list(features)
    ridge = np.array([(penalty or {}).get(n, 0.0) for n in names])
    clean = kept(df, [*features, y], [weight] if weight else [])
    trials = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    coef = np.zeros(len(names))
    for _ in range(rounds):
        eta = linear(names, coef)
        p = sigmoid(eta, 30.0)
        w = trials * p * (1 - p)
        gap = F.col(y).cast("double") - trials * p
        loss = {"ll": F.col(y) * F.ln(F.greatest(p, F.lit(1e-12))) + (trials - F.col(y)) * F.ln(F.greatest(1 - p, F.lit(1e-12)))}
        xx, xg, s = cross_products(clean, names, w, gap / F.greatest(w, F.lit(1e-12)), loss)
        inverse = np.linalg.pinv(xx + np.diag(ridge))
        step = inverse @ (xg - ridge * coef)
        coef = coef + step
        if np.abs(step).max() < 1e-8:
            break
    clean.unpersist()
    return Fit(tuple(names), coef, np.sqrt(np.maximum(np.diag(inverse), 0)), float(s["ll"] or 0.0), s["n"])


def log_gamma(x: Column) -> Column:
    """ln gamma for positive x, by Stirling's series after a shift of eight."""
    z = x + 8
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0)))
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.ln(product)


def negative_binomial(df: DataFrame, features: list[str], y: str, bounds: tuple[float, float] = (-5.0, 1.0), rounds: int = 12, grid: int = 25) -> tuple[Fit, float]:
    """Log-link count regression with a shared dispersion; returns the fit and ln alpha.

    For a dispersion the coefficients are reweighted least squares; the dispersion is
    the best of a grid within bounds, whose log-likelihoods are one aggregate.
    """
    names = ["1", *features]
    clean = kept(df, [*features, y])
    count = F.col(y).cast("double")
    start = clean.agg(F.avg(count)).first()[0]
    coef, log_alpha = np.zeros(len(names)), -2.0
    coef[0] = np.log(max(start, 1e-9))
    steps = np.linspace(*bounds, grid)
    s = {"n": 0}
    loglik = inverse = None
    for _ in range(rounds):
        alpha = float(np.exp(log_alpha))
        mu = F.exp(F.greatest(F.least(linear(names, coef), F.lit(20.0)), F.lit(-20.0)))
        w = mu / (1 + alpha * mu)
        xx, xg, s = cross_products(clean, names, w, (count - mu) / mu)
        inverse = np.linalg.pinv(xx)
        step = inverse @ xg
        coef = coef + step
        mu = F.exp(F.greatest(F.least(linear(names, coef), F.lit(20.0)), F.lit(-20.0)))
        # Rows of equal count and mean have equal terms: count them first.
        cells = clean.select(count.alias("y"), F.round(mu, 6).alias("mu")).groupBy("y", "mu").agg(F.count(F.lit(1)).alias("c"))
        at = lambda a: F.sum(F.col("c") * (log_gamma(F.col("y") + 1 / a) - log_gamma(F.lit(1 / a)) - log_gamma(F.col("y") + 1) + F.col("y") * F.ln(a * F.col("mu") / (1 + a * F.col("mu"))) - F.ln(1 + a * F.col("mu")) / a))
        values = np.array(cells.agg(*(at(float(np.exp(g))) for g in steps)).first(), float)
        best = float(steps[values.argmax()])
        loglik = float(values.max())
        if np.abs(step).max() < 1e-7 and best == log_alpha:
            break
        log_alpha = best
    clean.unpersist()
    return Fit(tuple(names), coef, np.sqrt(np.maximum(np.diag(inverse), 0)), loglik, s["n"]), log_alpha


def design_spec(df: DataFrame, numeric: list[str]) -> dict[str, dict[str, float]]:
    """Mean, sd, fill (the mean) and whether some value is missing, of training rows."""
    row = df.agg(*(x for c in numeric for x in (F.avg(c), F.stddev_pop(c), F.sum(F.col(c).isNull().cast("int"))))).first()
    return {c: {"mean": row[3 * i], "sd": row[3 * i + 1], "missing": row[3 * i + 2]} for i, c in enumerate(numeric)}


def apply_design(df: DataFrame, spec: dict[str, dict[str, float]], strict: bool = True) -> tuple[DataFrame, list[str]]:
    """Standardized columns x_*, and m_* for missing values where training had some; constant columns are dropped.

    strict refuses rows with a missing value where training had none.
    """
    out, names = {}, []
    for c, s in spec.items():
        if not s["sd"]:
            continue
        value = F.col(c)
        if s["missing"]:
            out[f"m_{c}"] = value.isNull().cast("double")
            names.append(f"m_{c}")
        elif strict:
            value = F.coalesce(value, F.raise_error(F.lit(f"{c} is missing here but not in training")).cast("double"))
        out[f"x_{c}"] = (F.coalesce(value, F.lit(s["mean"])) - s["mean"]) / s["sd"]
        names.append(f"x_{c}")
    return df.withColumns(out), names


def grid_fit(df: DataFrame, prob: Callable[[Column], Column], by: list[str], y: str, trials: str, grid_name: str, low: float, high: float, points: int) -> DataFrame:
    """Binomial log-loss at each value of a grid; prob gives the probability at a value, from the columns by alone.

    Rows of equal columns have equal probabilities: they are added up first, and only
    those cells meet the grid.
    """
    cells = df.groupBy(*by).agg(F.sum(y).alias(y), F.sum(trials).alias(trials))
    values = F.explode(F.array(*(F.lit(low + (high - low) * i / (points - 1)) for i in range(points)))).alias(grid_name)
    p = F.greatest(F.least(prob(F.col(grid_name)), F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = -(F.col(y) * F.ln(p) + (F.col(trials) - F.col(y)) * F.ln(1 - p))
    return cells.select("*", values).groupBy(grid_name).agg((F.sum(loss) / F.sum(trials)).alias("loss"))


def isotonic_fit(df: DataFrame, p: str, y: str, tie: list[str], parts: int = 50) -> list[tuple[float, float]]:
    """Knots of a monotone calibration: chunks of equal count in the order of p, pooled where they fall.

    Only the chunk means, about parts of them, come to the driver.
    """
    from priorframe.operators.ranking import equal_count_bins

    chunks = equal_count_bins(df.dropna(subset=[p, y]), p, tie, parts, "chunk").groupBy("bin").agg(F.avg(p).alias("x"), F.avg(y).alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    if sum(r["n"] for r in chunks) < 10:
        return [(0.0, 0.0), (1.0, 1.0)]
    pools: list[list[float]] = []
    for r in chunks:
        pools.append([r["y"], r["n"], r["x"] * r["n"]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            n = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2] + b[2]])
    return [(s / n, v) for v, n, s in pools]


def isotonic_predict(p: Column, knots: list[tuple[float, float]], eps: float = 1e-3) -> Column:
    """Linear between knots, flat beyond, clamped."""
    out = F.lit(knots[0][1])
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = F.when(p >= x0, y0 + (F.least(p, F.lit(x1)) - x0) / max(x1 - x0, 1e-12) * (y1 - y0)).otherwise(out)
    return F.greatest(F.least(out, F.lit(1 - eps)), F.lit(eps))


def hazard_states(starts: DataFrame, value: str, keep: list[str], parts: int = 9, size: int = 3) -> DataFrame:
    """One row for each part that an episode reached: completed, whether it returned for the next, outs when it stopped."""
    rows = starts.select(*keep, F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    rows = rows.filter(F.col("_v") >= F.col("part") * size)
    done = (F.col("_v") >= (F.col("part") + 1) * size).cast("int")
    partial = F.when(done == 0, F.col("_v") - F.col("part") * size)
    back = F.when((done == 1) & (F.col("part") < parts - 1), (F.col("_v") > (F.col("part") + 1) * size).cast("int"))
    return rows.select(*keep, "part", done.alias("completed"), back.alias("returned"), partial.alias("partial"))
