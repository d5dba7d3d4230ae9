"""Promotion gates of a feature: known before, gain on held-out splits, effect, collinearity, calibration.

A feature that fails a gate is rejected there. Gate 1 is measured, not claimed: the log
is altered from a day on, the features are built again, and no row up to that day, its
own included, may change. Gates 2 and 5 fit one logistic model for each feature and line
of a split; all models of all splits are fitted together: a round reads the rows once, as
they are, each task adds up the sums of every model, and the coefficients go back with the
next round (three numbers a model).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorframe.functions.rates import clamp
from priorframe.plans.evaluate import correlation

#: Largest correlation with a partner, bounds of a coefficient by the magnitude that is claimed, fewest rows.
COLLINEAR = 0.85
MAGNITUDES = {"weak": (0.0, 2.0), "moderate": (0.001, 5.0)}
LEAST_TRAIN, LEAST_TEST, LEAST_PAIRS = 30, 20, 20


@dataclass(frozen=True)
class Claim:
    """What is said of a feature: the sign of its effect (0: none), its magnitude, and partners it may be collinear with."""

    sign: int = 0
    magnitude: str | None = None
    near: tuple[str, ...] = ()


def leak_probe(log: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str], day: str, features: list[str], edges: list[str], alter: Callable[[DataFrame, Column], DataFrame]) -> dict[str, int]:
    """For each feature, rows up to an edge that change when the log is altered from that edge on (alter gets the log and the condition).

    A row that is there in one of both tables alone counts as changed.
    """
    whole = build(log).select(*keys, *features).persist()
    changed = dict.fromkeys(features, 0)
    for edge in edges:
        start = F.lit(edge).cast("date")
        other = build(alter(log, F.col(day) >= start)).select(*keys, *(F.col(f).alias(f"_{f}") for f in features), F.lit(True).alias("_there"))
        both = whole.withColumn("_here", F.lit(True)).filter(F.col(day) <= start).join(other.filter(F.col(day) <= start), keys, "full")
        alone = F.col("_here").isNull() | F.col("_there").isNull()
        row = both.agg(*(F.coalesce(F.count_if(alone | ~F.col(f).eqNullSafe(F.col(f"_{f}"))), F.lit(0)) for f in features)).first()
        for f, n in zip(features, row):
            changed[f] += n
    whole.unpersist()
    return changed


def stacked(df: DataFrame, features: list[str], lines: dict[str, tuple[str, str]], split: list[str]) -> DataFrame:
    """Rows feature, line, x, lp (logit of the base probability), p, y and the columns of split; a null feature has no row."""
    logit = lambda p: F.ln(clamp(p) / (1 - clamp(p)))
    by_feature = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))).alias("f")
    by_line = F.explode(F.array(*(F.struct(F.lit(n).alias("line"), F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")) for n, (p, y) in lines.items()))).alias("l")
    rows = df.select(*split, by_feature, *dict.fromkeys(c for pair in lines.values() for c in pair)).filter("f.x IS NOT NULL AND NOT isnan(f.x)")
    rows = rows.select(*split, "f.feature", "f.x", by_line).filter("l.p IS NOT NULL AND l.y IS NOT NULL")
    return rows.select(*split, "feature", "x", "l.line", "l.p", "l.y", logit(F.col("l.p")).alias("lp"))


def newton_step(h: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The step of a round, no coefficient by more than 10."""
    step = np.linalg.pinv(h) @ slope
    return step * min(1.0, 10 / max(np.abs(step).max(), 1e-300))


def grouped_logistic(rows: DataFrame, keys: list[str], x: list[str], y: str, rounds: int = 25) -> dict[tuple, np.ndarray]:
    """Coefficients (intercept first) of one logistic model for each group; a round is one aggregate over all of them.

    The number of groups is small: their coefficients go back to the rows by a broadcast.
    """
    spark, p = rows.sparkSession, len(x) + 1
    terms = [F.lit(1.0), *(F.col(c).cast("double") for c in x)]
    rows = rows.select(*keys, *x, y).persist()
    betas = {tuple(r): np.zeros(p) for r in rows.select(*keys).distinct().collect()}
    open_ = set(betas)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", _b array<double>"
    for _ in range(rounds):
        if not open_:
            break
        table = spark.createDataFrame([(*k, betas[k].tolist()) for k in open_], schema)
        met = rows.join(F.broadcast(table), keys)
        eta = sum((F.col("_b")[i] * t for i, t in enumerate(terms)), F.lit(0.0))
        q = 1 / (1 + F.exp(-F.greatest(F.least(eta, F.lit(30.0)), F.lit(-30.0))))
        met = met.select(*keys, *(t.alias(f"_x{i}") for i, t in enumerate(terms)), (F.col(y).cast("double") - q).alias("_e"), (q * (1 - q)).alias("_w"))
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = [F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in pairs] + [F.sum(F.col("_e") * F.col(f"_x{i}")) for i in range(p)]
        for r in met.groupBy(*keys).agg(*sums).collect():
            key, v = tuple(r[: len(keys)]), np.array(r[len(keys) :], float)
            h = np.zeros((p, p))
            for (i, j), s in zip(pairs, v):
                h[i, j] = h[j, i] = s
            step = newton_step(h, v[len(pairs) :])
            betas[key] = betas[key] + step
            if np.abs(step).max() < 1e-8:
                open_.discard(key)
    rows.unpersist()
    return betas


def split_table(df: DataFrame, features: list[str], lines: dict[str, tuple[str, str]], splits: dict[str, tuple[Column, Column]]) -> DataFrame:
    """By place in their lists: x of a feature, lp (logit of the base probability), p, y and ok (both known) of a line, a and b (a training, a test row) of a split."""
    logit = lambda p: F.ln(clamp(p) / (1 - clamp(p)))
    double = lambda c: F.col(c).cast("double")
    columns = [double(f).alias(f"x{i}") for i, f in enumerate(features)]
    for j, (p, y) in enumerate(lines.values()):
        columns += [logit(double(p)).alias(f"lp{j}"), double(p).alias(f"p{j}"), double(y).alias(f"y{j}"), (F.col(p).isNotNull() & F.col(y).isNotNull()).alias(f"ok{j}")]
    for k, (train, test) in enumerate(splits.values()):
        columns += [F.coalesce(train, F.lit(False)).alias(f"a{k}"), F.coalesce(test, F.lit(False)).alias(f"b{k}")]
    return df.select(*columns)


def fit_sums(x: np.ndarray, lp: np.ndarray, p: np.ndarray, y: np.ndarray, b: np.ndarray) -> list[float]:
    """Rows, slope and the six different entries of the Hessian of a logistic model in lp and x."""
    q = 1 / (1 + np.exp(-np.clip(b[0] + b[1] * lp + b[2] * x, -30, 30)))
    e, w = y - q, q * (1 - q)
    wl, wx = w * lp, w * x
    return [len(x), e.sum(), e @ lp, e @ x, w.sum(), wl.sum(), wx.sum(), wl @ lp, wl @ x, wx @ x]


def miss_sums(x: np.ndarray, lp: np.ndarray, p: np.ndarray, y: np.ndarray, b: np.ndarray) -> list[float]:
    """Rows, squared error of p and of the model, and the model's miss."""
    with np.errstate(over="ignore"):
        q = 1 / (1 + np.exp(-(b[0] + b[1] * lp + b[2] * x)))
    return [len(x), (p - y) @ (p - y), (q - y) @ (q - y), (q - y).sum()]


def model_sums(rows: DataFrame, betas: dict[tuple[int, int, int], np.ndarray], side: str, sums: Callable, width: int) -> dict[tuple[int, int, int], np.ndarray]:
    """sums over the rows (of a split_table) of each model (split, feature, line) on a side ("a" or "b") of its split, in one pass."""
    models = sorted(betas)
    wanted = sorted({(k, j) for k, _, j in models})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), width))
        number = {m: i for i, m in enumerate(models)}
        for batch in batches:
            column = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            for k, j in wanted:
                at = np.flatnonzero(column[f"{side}{k}"] & column[f"ok{j}"])
                line = [column[f"{c}{j}"][at] for c in ("lp", "p", "y")]
                for k2, i, j2 in models:
                    if (k2, j2) == (k, j):
                        x = column[f"x{i}"][at].astype(float)
                        seen = ~np.isnan(x)
                        total[number[k, i, j]] += sums(x[seen], *(c[seen].astype(float) for c in line), betas[k, i, j])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models))), *(pa.array(total[:, c].copy()) for c in range(width))], names=["model", *(f"s{c}" for c in range(width))])

    found = rows.mapInArrow(run, "model long, " + ", ".join(f"s{c} double" for c in range(width))).groupBy("model").agg(*(F.sum(f"s{c}") for c in range(width))).collect()
    return {m: np.zeros(width) for m in models} | {models[r[0]]: np.array(r[1:], float) for r in found}


def held_out_gains(df: DataFrame, features: list[str], lines: dict[str, tuple[str, str]], splits: dict[str, tuple[Column, Column]], rounds: int = 25) -> dict[str, dict[str, dict]]:
    """By split and feature: base and augmented squared error on the test rows (means over lines), gain in per cent, coefficient, and the mean miss.

    The augmented model is logistic in the logit of the base probability and the feature; a null feature has no row.
    """
    rows = split_table(df, features, lines, splits).persist()
    betas = {(k, i, j): np.zeros(3) for k in range(len(splits)) for i in range(len(features)) for j in range(len(lines))}
    tested = model_sums(rows, betas, "b", miss_sums, 4)
    betas = {m: b for m, b in betas.items() if tested[m][0] >= LEAST_TEST}
    open_ = dict(betas)
    for _ in range(rounds):
        if not open_:
            break
        for m, v in model_sums(rows, open_, "a", fit_sums, 10).items():
            if v[0] < LEAST_TRAIN:
                del betas[m], open_[m]
                continue
            step = newton_step(np.array([[v[4], v[5], v[6]], [v[5], v[7], v[8]], [v[6], v[8], v[9]]]), v[1:4])
            betas[m] = open_[m] = betas[m] + step
            if np.abs(step).max() < 1e-8:
                del open_[m]
    missed = model_sums(rows, betas, "b", miss_sums, 4) if betas else {}
    rows.unpersist()
    out: dict[str, dict[str, dict]] = {s: {} for s in splits}
    line_order = sorted(range(len(lines)), key=list(lines).__getitem__)
    for k, s in enumerate(splits):
        for i, f in enumerate(features):
            of = [(k, i, j) for j in line_order if (k, i, j) in betas]
            if of:
                means = np.array([missed[m][1:] / missed[m][0] for m in of])
                base, augmented, bias = (float(v) for v in means.mean(axis=0))
                gain = 100 * (base - augmented) / base if base else 0.0
                out[s][f] = {"base": base, "augmented": augmented, "bias": bias, "coefficient": float(betas[of[-1]][2]), "lines": len(of), "gain_pct": gain}
    return out


def noise_floor(gains: dict[str, dict[str, dict]], noise: list[str]) -> float:
    """The largest gain of columns that mean nothing, each by the worse of the first two splits; at least 0.

    It is what the refit of intercept and slope alone brings, and chance.
    """
    two = [gains[s] for s in list(gains)[:2]]
    return max([0.0, *(min(g[n]["gain_pct"] for g in two) for n in noise if all(n in g for g in two))])


def partner_correlations(df: DataFrame, claims: dict[str, Claim]) -> dict[str, dict[str, float | None]]:
    """Correlation of each feature with its partners that are columns, on rows that have both: one aggregate; null below LEAST_PAIRS rows."""
    pairs = [(f, p) for f, c in claims.items() for p in c.near if p in df.columns and f in df.columns]
    if not pairs:
        return {f: {} for f in claims}
    double = lambda c: F.col(c).cast("double")
    row = df.agg(*(F.when(F.count(F.when(F.col(f).isNotNull(), F.col(p))) >= LEAST_PAIRS, correlation(double(f), double(p))) for f, p in pairs)).first()
    out: dict[str, dict] = {f: {} for f in claims}
    for (f, p), r in zip(pairs, row):
        out[f][p] = r
    return out


def feature_gates(df: DataFrame, claims: dict[str, Claim], lines: dict[str, tuple[str, str]], splits: dict[str, tuple[Column, Column]], split: list[str], changed: dict[str, int], noise: list[str] | None = None) -> list[dict]:
    """The five gates of each feature; the first two splits have to gain, in both directions of time, and the last coefficient is judged.

    changed is what leak_probe found; a feature that it does not know fails the first gate.
    noise: columns that mean nothing, whose gain is the least that counts.
    """
    names = list(claims)
    gains = held_out_gains(df, [*names, *(noise or [])], lines, splits)
    floor = noise_floor(gains, noise or [])
    near = partner_correlations(df, claims)
    first_two = list(splits)[:2]
    out = []
    for f in names:
        claim = claims[f]
        by = {s: gains[s].get(f) for s in splits}
        pct = [by[s]["gain_pct"] if by[s] else None for s in first_two]
        coefficient = next((by[s]["coefficient"] for s in reversed(list(splits)) if by[s]), None)
        sign_ok = coefficient is None or claim.sign == 0 or coefficient * claim.sign >= 0
        low, high = MAGNITUDES.get(claim.magnitude or "", (0.0, np.inf))
        gates = {
            1: changed.get(f, 1) == 0,
            2: all(x is not None and x > floor for x in pct),
            3: None if coefficient is None else bool(sign_ok and low <= abs(coefficient) <= high),
            4: not any(r is not None and abs(r) > COLLINEAR for r in near[f].values()),
            5: all(x is not None and x > 0 for x in pct),
        }
        failed = next((g for g, ok in gates.items() if ok is False), None)
        out.append({
            "feature": f, **{f"gate{g}": ok for g, ok in gates.items()}, "changed_rows": changed.get(f), **{f"gain_{s}": by[s]["gain_pct"] if by[s] else None for s in splits},
            "coefficient": coefficient, "verdict": "PROMOTED" if failed is None else "REJECTED", "failed_at": failed,
        })
    return out
