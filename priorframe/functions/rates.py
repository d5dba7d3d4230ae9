"""Rates and probabilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prior weights and the rate of the league.
PRIOR_WEIGHT_PITCHER, PRIOR_WEIGHT_BATTER, LEAGUE_RATE = 70, 60, 0.225


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def shrink_rate(successes, trials, prior=LEAGUE_RATE, weight: float = PRIOR_WEIGHT_PITCHER) -> Column:
    """(s + w * prior) / (n + w); without trials it is the prior."""
    return (F.coalesce(col(successes), F.lit(0)) + weight * col(prior)) / (F.coalesce(col(trials), F.lit(0)) + weight)


def safe_rate(hits, trials, otherwise: float | None = None) -> Column:
    """hits / trials, or otherwise where there are none."""
    return F.when(col(trials) > 0, col(hits) / col(trials)).otherwise(F.lit(otherwise))


def gated_rate(hits, trials, least: int) -> Column:
    """hits / trials, null below least trials."""
    return F.when(col(trials) >= least, col(hits) / col(trials))


def ratio(top, bottom) -> Column:
    """top / bottom as floating point has it: over zero it is infinite, and not a number for zero over zero."""
    a, b = col(top).cast("double"), col(bottom).cast("double")
    over_zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
    return F.when((b == 0) & a.isNotNull(), over_zero).otherwise(F.try_divide(a, b))


def clamp(p, eps: float = 1e-6) -> Column:
    return F.greatest(F.least(col(p), F.lit(1 - eps)), F.lit(eps))


def logit(p, eps: float = 1e-6) -> Column:
    q = clamp(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(x, limit: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(col(x), F.lit(limit)), F.lit(-limit))))


#: Fixed value: curvature of the matchup curve.
CURVATURE = 0.84


def matchup_rate(a, b, league: float = LEAGUE_RATE, curvature: float = CURVATURE) -> Column:
    """Joint rate of two entities; two of the league's rate meet at the league's rate."""
    both = col(a) * col(b)
    return both / (curvature * both + (league - curvature * league * league))


def wilson(hits, trials, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null without trials."""
    n = F.nullif(col(trials), F.lit(0)).cast("double")
    p = col(hits) / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half
