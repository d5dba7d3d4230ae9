"""Deep dives into a linear screen: many models from one table of moments, controls, swaps.

``Moments`` of all terms are one aggregate by epoch. Any subset's fit on some epochs and
its error on others is then a small solve, so dropping each term, comparing variants and
searching for fewer terms read the rows once in all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.special import normal_cdf
from priorframe.plans import fit
from priorframe.plans.evaluate import correlation


@dataclass(frozen=True)
class Moments:
    """Sums of products of the terms ("1" first) and the target, of complete rows."""

    names: tuple[str, ...]
    xx: np.ndarray
    xy: np.ndarray
    yy: float
    n: int

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.names, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.n + other.n)

    def at(self, terms: list[str]) -> list[int]:
        return [self.names.index(t) for t in ("1", *terms)]

    def solve(self, terms: list[str]) -> np.ndarray:
        i = self.at(terms)
        return np.linalg.pinv(self.xx[np.ix_(i, i)]) @ self.xy[i]

    def t_values(self, terms: list[str]) -> np.ndarray:
        """Coefficients of the fit over their standard errors."""
        i = self.at(terms)
        inverse = np.linalg.pinv(self.xx[np.ix_(i, i)])
        b = inverse @ self.xy[i]
        sigma2 = self.errors(terms, b) * self.n / max(self.n - len(i), 1)
        return b / np.sqrt(np.maximum(np.diag(inverse) * sigma2, 1e-300))

    def errors(self, terms: list[str], b: np.ndarray) -> float:
        """Mean squared error of the coefficients b on these rows."""
        i = self.at(terms)
        return max(self.yy - 2 * b @ self.xy[i] + b @ self.xx[np.ix_(i, i)] @ b, 0.0) / max(self.n, 1)

    def correlation(self, terms: list[str], b: np.ndarray) -> float:
        """Correlation of the prediction with the target on these rows."""
        i = self.at(terms)
        p1, p2, py, y1 = b @ self.xx[i, 0], b @ self.xx[np.ix_(i, i)] @ b, b @ self.xy[i], self.xy[0]
        spread = (p2 - p1**2 / self.n) * (self.yy - y1**2 / self.n)
        return float((py - p1 * y1 / self.n) / math.sqrt(spread)) if spread > 0 else 0.0


def moments(df: DataFrame, terms: list[str], y: str, by: str) -> dict[object, Moments]:
    """Moments by epoch, of rows that have all terms and the target: one aggregate, p * p / 2 sums an epoch."""
    names = ("1", *terms)
    clean = df.select(by, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*terms, y]))).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = [F.sum(fit.column(names[i]) * fit.column(names[j])) for i, j in pairs] + [F.sum(fit.column(c) * F.col(y)) for c in names]
    out = {}
    for row in clean.groupBy(by).agg(*sums, F.sum(F.col(y) * F.col(y)), F.count(F.lit(1))).collect():
        v = np.array(row[1:], float)
        xx = np.zeros((len(names), len(names)))
        for (i, j), s in zip(pairs, v):
            xx[i, j] = xx[j, i] = s
        out[row[0]] = Moments(names, xx, v[len(pairs) : len(pairs) + len(names)], float(v[-2]), int(v[-1]))
    return out


Splits = dict[str, tuple[set, set]]


def split_moments(by: dict[object, Moments], splits: Splits) -> dict[str, tuple[Moments, Moments]]:
    """Moments of the training and of the test epochs of each split; a split without rows on a side is left out."""
    total = lambda epochs: _sum([m for e, m in by.items() if e in epochs])
    out = {}
    for name, (train, test) in splits.items():
        a, b = total(train), total(test)
        if a is not None and b is not None:
            out[name] = (a, b)
    return out


def _sum(parts: list[Moments]) -> Moments | None:
    out = None
    for m in parts:
        out = m if out is None else out + m
    return out


def rmse(train: Moments, test: Moments, terms: list[str]) -> float:
    return math.sqrt(test.errors(terms, train.solve(terms)))


def summary(term: str, rows: dict[str, dict]) -> dict:
    """SURVIVOR where every split gains, every |t| is 2 or more and all signs agree."""
    gains, ts, signs = [r["gain_pct"] for r in rows.values()], [abs(r["t"]) for r in rows.values()], {np.sign(r["coef"]) for r in rows.values()}
    passes = bool(rows) and min(gains) > 0 and min(ts) >= 2 and len(signs) == 1 and 0 not in signs
    return {"term": term, "verdict": "SURVIVOR" if passes else "REJECT", "worst_gain_pct": min(gains) if gains else None, **{f"{k}_{s}": r[k] for s, r in rows.items() for k in ("gain_pct", "t", "coef")}}


def gain_of(train: Moments, test: Moments, with_: list[str], term: str) -> dict:
    """What a term of a model is worth: error lost on the test rows without it, in per cent, its coefficient and t on the training rows."""
    without = [t for t in with_ if t != term]
    less, full = rmse(train, test, without), rmse(train, test, with_)
    at = 1 + with_.index(term)
    return {"gain_pct": 100 * (less - full) / less if less else 0.0, "coef": float(train.solve(with_)[at]), "t": float(train.t_values(with_)[at])}


def joint_drop_one(by: dict[object, Moments], base: list[str], survivors: list[str], splits: Splits) -> list[dict]:
    """Base and survivors fitted together, each left out in turn; and the block of survivors as a whole."""
    full, parts = [*base, *survivors], split_moments(by, splits)
    out = [summary(t, {s: gain_of(*m, full, t) for s, m in parts.items()}) | {"block": "base" if t in base else "candidate"} for t in full]
    whole = {s: (rmse(*m, base), rmse(*m, full), m[1].correlation(base, m[0].solve(base)), m[1].correlation(full, m[0].solve(full))) for s, m in parts.items()}
    out.sort(key=lambda r: (-(r["worst_gain_pct"] or 0.0), r["term"]))
    return out + [{"term": "survivors", "block": "all", "verdict": "BLOCK", "worst_gain_pct": min(100 * (a - b) / a for a, b, _, _ in whole.values()), **{f"gain_pct_{s}": 100 * (v[0] - v[1]) / v[0] for s, v in whole.items()}, **{f"r_{s}": v[3] for s, v in whole.items()}}]


def add_one(by: dict[object, Moments], base: list[str], candidates: list[str], splits: Splits) -> list[dict]:
    """Each candidate added to the base by itself: which representation of one thing belongs in the model."""
    parts = split_moments(by, splits)
    rows = [summary(c, {s: gain_of(*m, [*(b for b in base if b != c), c], c) for s, m in parts.items()}) for c in candidates]
    return sorted(rows, key=lambda r: (-(r["worst_gain_pct"] or 0.0), r["term"]))


def variants(by: dict[object, Moments], models: dict[str, list[str]], splits: Splits) -> list[dict]:
    """Error of each model on each split's test rows, all on the same complete rows."""
    parts = split_moments(by, splits)
    return [{"model": name, "terms": len(terms), **{f"rmse_{s}": rmse(*m, terms) for s, m in parts.items()}} for name, terms in models.items()]


def parsimony(by: dict[object, Moments], terms: list[str], splits: Splits, tolerance_pct: float = 0.0) -> list[dict]:
    """The path of models that drop, step by step, the term whose loss on the worst split is least; keep tells whether the step costs more than tolerance.

    The last row that is kept before the first that isn't is the smallest model without loss.
    """
    parts, left = split_moments(by, splits), list(terms)
    first = {s: rmse(*m, left) for s, m in parts.items()}
    out = [{"step": 0, "dropped": None, "terms": len(left), "worst_loss_pct": 0.0, "keep": True}]
    while len(left) > 1:
        loss = lambda ts: max(100 * (rmse(*m, ts) - first[s]) / first[s] if first[s] else 0.0 for s, m in parts.items())
        options = sorted((loss([x for x in left if x != t]), t) for t in left)
        worst, term = options[0]
        left = [x for x in left if x != term]
        out.append({"step": len(out), "dropped": term, "terms": len(left), "worst_loss_pct": worst, "keep": bool(worst <= tolerance_pct and out[-1]["keep"])})
    return out


def shuffled(df: DataFrame, value: str, within: list[str], key: str, seed: int, rows: int = 10_000) -> DataFrame:
    """df with value permuted among the rows of a group, at random but the same on every run.

    The rows of a group are dealt at random to parts of about `rows`, and values are
    permuted within a part: row i by one hash gets the value of row i by another. No group
    is sorted as a whole, however large it is.
    """
    parts = df.groupBy(*within).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / rows)).alias("_parts"))
    dealt = df.join(F.broadcast(parts), within).withColumn("_part", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.col("_parts")))
    place = lambda salt: F.row_number().over(Window.partitionBy(*within, "_part").orderBy(F.xxhash64(F.col(key), F.lit(seed), F.lit(salt)), F.col(key)))
    to = dealt.withColumn("_i", place("to"))
    from_ = dealt.select(*within, "_part", F.col(value).alias("_value"), place("from").alias("_i"))
    names = [c if c != value else F.col("_value").alias(value) for c in df.columns]
    return to.drop(value).join(from_, [*within, "_part", "_i"]).select(*names)


def unit_swap(df: DataFrame, models: dict[str, list[str]], y: str, splits: dict[str, tuple[Column, Column]]) -> list[dict]:
    """Logistic models of single units, one for each set of terms, on the same complete rows: squared error on each split's test rows, and coefficients."""
    rows = df.dropna(subset=list(dict.fromkeys(t for ts in models.values() for t in ts)) + [y])
    out = []
    for split, (train, test) in splits.items():
        fits = {name: fit.logistic(rows.filter(train), terms, y) for name, terms in models.items()}
        miss = lambda f: F.avg(F.pow(F.col(y) - 1 / (1 + F.exp(-f.predictor())), F.lit(2.0)))
        errors = rows.filter(test).agg(*(miss(f) for f in fits.values())).first()
        out += [{"split": split, "model": name, "brier": e, "coef": dict(zip(f.names, map(float, f.coef)))} for (name, f), e in zip(fits.items(), errors)]
    return out


def _prediction(m: Moments, terms: list[str]) -> Column:
    return fit.linear(("1", *terms), m.solve(terms))


def candidate_screen(df: DataFrame, base: list[str], candidates: list[str], y: str, by: str, splits: Splits) -> list[dict]:
    """Each candidate on top of the base, paired on the same test rows: error and its paired t, correlation with the base's residual, and calibration at a line.

    The line is set once a row, from the base's forecast (to halves, never whole), so that
    both models price the same bet; brier_gain is what the candidate brings there. Fits
    are solves of one table of moments, and a split's test rows are read once for all candidates.
    """
    table = moments(df, [*base, *candidates], y, by)
    parts = split_moments(table, splits)
    clean = df.select(by, *(F.col(c).cast("double").alias(c) for c in dict.fromkeys([*base, *candidates, y]))).dropna()
    found: dict[str, dict] = {c: {} for c in candidates}
    for s, (train, test) in parts.items():
        p0 = _prediction(train, base)
        half = F.round(p0 * 2) / 2
        line = F.when(half == F.floor(half), half + 0.5).otherwise(half)
        rows = clean.filter(F.col(by).isin(sorted(splits[s][1]))).withColumn("_p", p0).withColumn("_line", line).withColumn("_over", (F.col(y) > F.col("_line")).cast("double"))
        sd = {t: math.sqrt(max(train.errors(list(t), train.solve(list(t))), 1e-12)) for t in [tuple(base), *((*base, c) for c in candidates)]}
        chance = lambda p, t: 1 - normal_cdf((F.col("_line") - p) / sd[t])  # noqa: B023, E731
        q0 = chance(F.col("_p"), tuple(base))
        sums = []
        for c in candidates:
            p1 = _prediction(train, [*base, c])
            gain = F.pow(F.col(y) - F.col("_p"), F.lit(2.0)) - F.pow(F.col(y) - p1, F.lit(2.0))
            sums += [F.avg(gain), F.stddev_samp(gain), correlation(F.col(c), F.col(y) - F.col("_p")), F.avg(F.pow(F.col("_over") - q0, F.lit(2.0)) - F.pow(F.col("_over") - chance(p1, (*base, c)), F.lit(2.0)))]
        row = rows.agg(F.count(F.lit(1)), *sums).first()
        for i, c in enumerate(candidates):
            mean, spread, r, brier = row[1 + 4 * i : 5 + 4 * i]
            paired = mean / (spread / math.sqrt(row[0])) if spread else 0.0
            found[c][s] = gain_of(train, test, [*base, c], c) | {"paired_t": paired, "residual_r": r, "brier_gain": brier}
    out = []
    for c, rows in found.items():
        out.append(summary(c, rows) | {f"{k}_{s}": r[k] for s, r in rows.items() for k in ("paired_t", "residual_r", "brier_gain")})
    return sorted(out, key=lambda r: (-(r["worst_gain_pct"] or 0.0), r["term"]))
