"""Short and normal episodes: a mixture of two negative binomial arms around a known mean.

The normal arm's mean is what is left of a row's expected count when the short arm has
had its share, so that the mixture keeps the expectation. Rows are counted by Spark in
cells of equal count and of means that are equal to 1 part in ``1 / WIDTH``; each cell has
its own mean. Fitting reads the cells alone: their number is bounded by the distinct
counts times the distinct steps of the mean, not by the rows.

Expectation maximization: responsibilities of the short arm by cell; then the share, the
short mean and both dispersions are each moved to the best of their line (the expected
log-likelihood of the cells), and a move that does not gain is not made. The likelihood
therefore never falls. It has several maxima, so there are several starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 1 / 64
#: Bounds of dispersion, share and short mean, and the least mean of the normal arm.
DISPERSION, SHARE, SHORT, LEAST = (1e-4, 5.0), (1e-5, 0.5), (1.0, 20.0), 1.0
#: Starts of share and short mean; dispersions start at these.
STARTS = [(share, short) for share in (0.02, 0.05, 0.10) for short in (5.0, 8.0, 12.0)]
FIRST_DISPERSION = (0.05, 0.02)


def cells(df: DataFrame, value: str, mean: str | Column, width: float = WIDTH) -> np.ndarray:
    """Rows (count, mean of the means, number of rows) of equal count and step of the logarithm of the mean."""
    m = F.col(mean) if isinstance(mean, str) else mean
    rows = df.select(F.col(value).cast("double").alias("y"), m.cast("double").alias("m")).filter("y >= 0 AND m > 0")
    counts = rows.groupBy("y", F.floor(F.ln("m") / width).alias("step")).agg(F.avg("m").alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    return np.array([tuple(r) for r in counts.select("y", "m", "n").orderBy("y", "m").collect()]).reshape(-1, 3)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive values, by Stirling's series after a shift of eight."""
    x = np.asarray(x, float)
    z = x + 8
    shifted = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return shifted - sum(np.log(x + i) for i in range(8))


def log_pmf(y: np.ndarray, mean: np.ndarray, dispersion: float) -> np.ndarray:
    """Negative binomial of variance mean + dispersion * mean ** 2."""
    r = 1 / min(max(dispersion, DISPERSION[0]), DISPERSION[1])
    mean = np.maximum(mean, 1e-6)
    return log_gamma(y + r) - log_gamma(y + 1.0) - log_gamma(np.asarray(r)) + r * np.log(r / (r + mean)) + y * np.log(mean / (r + mean))


@dataclass
class Mixture:
    share: float
    short: float
    short_dispersion: float
    dispersion: float
    least: float = LEAST
    loglik: float = -np.inf
    path: list[float] = field(default_factory=list)

    def rest(self, mean: np.ndarray) -> np.ndarray:
        """Mean of the normal arm."""
        return np.maximum((mean - self.share * self.short) / (1 - self.share), self.least)

    def arms(self, y: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log of share times probability, of both arms."""
        return np.log(self.share) + log_pmf(y, np.full_like(y, self.short), self.short_dispersion), np.log1p(-self.share) + log_pmf(y, self.rest(mean), self.dispersion)

    def log_pmf(self, y: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.logaddexp(*self.arms(y, mean))


def best_of_line(f, now: float, low: float, high: float, steps: int = 28) -> float:
    """The best of a golden section of the logarithm between low and high, or now if that is no worse."""
    a, b, g = np.log(low), np.log(high), (5**0.5 - 1) / 2
    # First a coarse look, since the line may have more than one hill.
    grid = np.linspace(a, b, 9)
    i = int(np.argmax([f(float(np.exp(x))) for x in grid]))
    a, b = grid[max(i - 1, 0)], grid[min(i + 1, 8)]
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(float(np.exp(x))), f(float(np.exp(y)))
    for _ in range(steps):
        if fx >= fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(float(np.exp(x)))
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(float(np.exp(y)))
    found = float(np.exp((a + b) / 2))
    return found if f(found) > f(now) else now


def fit_one(table: np.ndarray) -> tuple[float, float]:
    """(dispersion, log-likelihood) of one arm around the mean."""
    y, m, n = table.T
    f = lambda a: float(n @ log_pmf(y, m, a))
    a = best_of_line(f, FIRST_DISPERSION[0], *DISPERSION)
    return a, f(a)


def maximize(table: np.ndarray, start: Mixture, short_bounds: tuple[float, float], rounds: int, least_gain: float) -> Mixture:
    """Expectation maximization from one start; path holds the log-likelihood after each round."""
    y, m, n = table.T
    now = start
    now.loglik = float(n @ now.log_pmf(y, m))
    now.path = [now.loglik]
    for _ in range(rounds):
        one, two = now.arms(y, m)
        own = 1 / (1 + np.exp(np.clip(two - one, -700, 700)))

        def expected(**change) -> float:
            """Log-likelihood of both arms, given whose each row is."""
            at = Mixture(**{k: change.get(k, getattr(new, k)) for k in ("share", "short", "short_dispersion", "dispersion")}, least=now.least)
            a, b = at.arms(y, m)
            return float(n @ (own * a + (1 - own) * b))

        new = Mixture(now.share, now.short, now.short_dispersion, now.dispersion, now.least)
        for name, bounds in (("share", SHARE), ("short", short_bounds), ("short_dispersion", DISPERSION), ("dispersion", DISPERSION)):
            setattr(new, name, best_of_line(lambda v, name=name: expected(**{name: v}), getattr(new, name), *bounds))
        new.loglik = float(n @ new.log_pmf(y, m))
        new.path = [*now.path, new.loglik]
        done = new.loglik - now.loglik < least_gain
        now = new
        if done:
            break
    return now


def mixture_fit(table: np.ndarray, starts: list[tuple[float, float]] = STARTS, short_bounds: tuple[float, float] = SHORT, rounds: int = 200, least_gain: float = 1e-6, least: float = LEAST) -> Mixture:
    """The best of all starts."""
    fits = [maximize(table, Mixture(share, short, *FIRST_DISPERSION, least), short_bounds, rounds, least_gain) for share, short in starts]
    return max(fits, key=lambda f: f.loglik)


def tail_error(table: np.ndarray, log_probability, marks: tuple[int, ...]) -> float:
    """Mean distance of the predicted from the observed share of counts up to each mark; log_probability takes counts and means."""
    y, m, n = table.T
    errors = []
    for mark in marks:
        counts = np.arange(mark + 1, dtype=float)
        predicted = sum(np.exp(log_probability(np.full_like(m, k), m)) for k in counts)
        errors.append(abs(n @ (y <= mark) - n @ predicted) / n.sum())
    return float(np.mean(errors))
