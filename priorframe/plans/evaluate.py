"""Scores of probabilities, calibration, paired tests, screens."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.rates import clamp, sigmoid, wilson
from priorframe.operators import asof
from priorframe.operators.ranking import equal_count_bins
from priorframe.plans.fit import Fit, cross_products, logistic, ols


def correlation(a: Column | str, b: Column | str) -> Column:
    """Correlation over the rows that have both, as an aggregate; null where one of them doesn't vary (Spark's own is an error there)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.when(spread > 0, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)))


def scores(p: str, y: str) -> list[Column]:
    """Brier, log-loss, bias, mean absolute and root mean square error, and count, as aggregates."""
    q = clamp(p)
    miss = F.col(p) - F.col(y)
    return [
        F.avg(miss * miss).alias("brier"), F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"), F.avg(miss).alias("bias"),
        F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.count(F.lit(1)).alias("n"),
    ]


def calibration_table(df: DataFrame, p: str, y: str, tie: list[str], bins: int = 10, rule: str = "floor") -> DataFrame:
    t = equal_count_bins(df, p, tie, bins, rule).groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(y).alias("rate"), F.sum(y).alias("hits"))
    low, high = wilson("hits", "n")
    return t.withColumn("low", low).withColumn("high", high)


def ece(table: DataFrame, squared: bool = False) -> DataFrame:
    """Expected calibration error of a table: mean absolute, or root mean square."""
    gap = F.col("p") - F.col("rate")
    value = F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n")) if squared else F.sum(F.col("n") * F.abs(gap)) / F.sum("n")
    return table.agg(value.alias("ece"))


def paired_test(df: DataFrame, a: str, b: str, y: str, cluster: list[str] | None = None) -> DataFrame:
    """Mean difference of squared errors (b less a), its standard error and z; by cluster means if given. No spread, no z."""
    d = (F.col(b) - F.col(y)) * (F.col(b) - F.col(y)) - (F.col(a) - F.col(y)) * (F.col(a) - F.col(y))
    rows = df.select(d.alias("d")) if not cluster else df.groupBy(*cluster).agg(F.avg(d).alias("d"))
    out = rows.agg(F.avg("d").alias("gain"), (F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("se"), F.count("d").alias("n"))
    return out.withColumn("z", F.when(F.col("se") > 0, F.col("gain") / F.col("se")).otherwise(F.lit(0.0)))


def paired_by_group(df: DataFrame, keys: list[str], a: str, b: str, y: str) -> DataFrame:
    """For each group: count, mean squared errors of a and b, the mean of their paired difference and its z (0 without spread)."""
    miss = lambda c: (F.col(c) - F.col(y)) * (F.col(c) - F.col(y))
    rows = df.select(*keys, miss(a).alias("_a"), miss(b).alias("_b")).withColumn("_d", F.col("_b") - F.col("_a"))
    out = rows.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_a").alias("brier_a"), F.avg("_b").alias("brier_b"), F.avg("_d").alias("gain"), (F.stddev_samp("_d") / F.sqrt(F.count("_d"))).alias("se"))
    return out.withColumn("z", F.when(F.col("se") > 1e-12, F.col("gain") / F.col("se")).otherwise(F.lit(0.0)))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns with their correlation on complete rows: one aggregate."""
    clean = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = clean.agg(*(correlation(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))).alias("x")).select("x.*", (F.abs("x.r") > 0.85).alias("collinear"))


def factor_screen(df: DataFrame, base: list[str], candidates: list[str], y: str, split: Column) -> list[dict]:
    """Gain of each candidate over the base on held-out rows: least squares by moments, errors in one second pass.

    One aggregate has the moments of base and all candidates; each model is a small
    solve on a part of it.
    """
    used = [*base, *candidates]
    clean = df.dropna(subset=[*used, y])
    train, test = clean.filter(split), clean.filter(~split)
    names = ["1", *used]
    xx, xy, _ = cross_products(train, names, F.lit(1.0), F.col(y).cast("double"))

    def model(features: list[str]) -> Fit:
        at = [names.index(n) for n in ["1", *features]]
        coef = np.linalg.pinv(xx[np.ix_(at, at)]) @ xy[at]
        return Fit(tuple(["1", *features]), coef, np.zeros(len(at)), 0.0, 0)

    first = model(base)
    miss = lambda m: (m.predictor() - F.col(y)) * (m.predictor() - F.col(y))
    stats = []
    for c in candidates:
        d = miss(first) - miss(model([*base, c]))
        stats += [F.avg(d), F.stddev_samp(d), correlation(F.col(c), F.col(y) - first.predictor())]
    row = test.agg(F.count(F.lit(1)), *stats).first()
    out = []
    for i, c in enumerate(candidates):
        gain, sd, corr = row[1 + 3 * i : 4 + 3 * i]
        se = (sd or 0.0) / max(row[0], 1) ** 0.5
        out.append({"candidate": c, "gain": gain, "t": gain / se if se else 0.0, "residual_r": corr})
    return out


def effect_directions(df: DataFrame, fit: Fit, signs: dict[str, int]) -> list[dict]:
    """Mean shift of the predicted probability when a term grows by one sd, against a contract; a term not in the model is untested.

    All rows are scored as they are and with each term moved, in one aggregate.
    """
    tested = [t for t in signs if t in fit.names]
    clean = df.dropna(subset=[n for n in fit.names if n != "1"])
    sd = clean.agg(*(F.stddev_samp(t) for t in tested)).first() if tested else ()
    moved = [F.avg(sigmoid(fit.predictor() + float(fit.coef[fit.names.index(t)]) * float(d or 0.0)) - sigmoid(fit.predictor())) for t, d in zip(tested, sd)]
    shifts = dict(zip(tested, clean.agg(*moved).first())) if tested else {}
    verdict = lambda t: "untested" if shifts.get(t) is None else "ok" if shifts[t] * signs[t] > 0 else "reversed"
    return [{"term": t, "shift": shifts.get(t), "verdict": verdict(t)} for t in signs]


def backtest(df: DataFrame, splits: dict[str, tuple[Column, Column]], features: list[str], y: str, naive: str, line: str | None = None) -> DataFrame:
    """For each temporal split: a logistic model of the training rows against a naive probability, on the test rows; with line, for each line and for all ("all")."""
    parts = []
    for name, (train, test) in splits.items():
        fit = logistic(df.filter(train), features, y)
        p = 1 / (1 + F.exp(-fit.predictor()))
        rows = df.filter(test).dropna(subset=features).withColumn("_p", p)
        miss = lambda c: F.avg((F.col(c) - F.col(y)) * (F.col(c) - F.col(y)))
        scored = [miss("_p").alias("model"), miss(naive).alias("naive"), F.count(F.lit(1)).alias("n")]
        if line is None:
            sets = rows.agg(*scored)
        else:
            sets = rows.withColumn("_line", F.col(line).cast("string")).groupingSets([["_line"], []], "_line").agg(*scored, F.grouping("_line").alias("_all"))
            sets = sets.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("_line")).alias("line"), "model", "naive", "n")
        parts.append(sets.select(F.lit(name).alias("split"), "*", (1 - F.col("model") / F.nullif("naive", F.lit(0.0))).alias("skill")))
    return reduce(DataFrame.unionByName, parts)


def drop_one(df: DataFrame, train: Column, features: list[str], y: str) -> DataFrame:
    """Each feature left out, on identical test rows: paired loss of leaving it out."""
    rows = df.dropna(subset=features)
    full = logistic(rows.filter(train), features, y)
    parts = []
    for f in features:
        less = logistic(rows.filter(train), [x for x in features if x != f], y)
        test = rows.filter(~train).withColumn("_a", 1 / (1 + F.exp(-full.predictor()))).withColumn("_b", 1 / (1 + F.exp(-less.predictor())))
        parts.append(paired_test(test, "_a", "_b", y).select(F.lit(f).alias("feature"), "*", F.when(F.col("z") >= 2, "keep").when(F.col("z") <= -2, "drop").otherwise("unclear").alias("verdict")))
    return reduce(DataFrame.unionByName, parts)


def noise_floor(df: DataFrame, base: list[str], key: str, y: str, splits: list[Column], seeds: int = 20) -> float:
    """95th percentile of the gains of seeded random features, each by its worst split; all of a split are screened in one job."""
    from priorframe.functions.names import seeded_noise

    names = [f"_noise{i}" for i in range(seeds)]
    noisy = df.withColumns({n: seeded_noise(key, i) for i, n in enumerate(names)})
    gains = np.array([[r["gain"] for r in factor_screen(noisy, base, names, y, split)] for split in splits])
    return float(np.percentile(gains.min(axis=0), 95))


def ranked_screen(df: DataFrame, base: list[str], candidates: dict[str, int], y: str, splits: list[tuple[Column, Column]], floor: float = 0.0) -> list[dict]:
    """Candidates (with the sign that is expected, 0 for none) by their gain on the worst of the splits (train, test): gains, sign of the residual correlation, verdict.

    A candidate survives if its worst gain is above floor and its sign is the expected one in all splits.
    """
    screens = [{x["candidate"]: x for x in factor_screen(df.filter(train | test), base, list(candidates), y, train)} for train, test in splits]
    out = []
    for name, sign in candidates.items():
        gains, signs = [s[name]["gain"] for s in screens], [np.sign(s[name]["residual_r"] or 0.0) for s in screens]
        fits = sign == 0 or all(x == sign for x in signs)
        out.append({"candidate": name, "gains": gains, "worst": min(gains), "sign_matches": bool(fits), "survives": bool(min(gains) > floor and fits)})
    return sorted(out, key=lambda x: (-x["worst"], x["candidate"]))


def blend_weight(df: DataFrame, model: str, fair: str, y: str, grid: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Rows (w, brier, best): squared error of fair + w (model - fair) on a grid, and the weight that is least; from three sums."""
    d, e = F.col(model) - F.col(fair), F.col(y) - F.col(fair)
    sums = df.dropna(subset=[model, fair, y]).agg(F.avg(d * e).alias("_de"), F.avg(d * d).alias("_dd"), F.avg(e * e).alias("_ee"))
    rows = sums.withColumn("w", F.explode(F.array(*map(F.lit, grid))))
    return rows.select("w", (F.col("_ee") - 2 * F.col("w") * F.col("_de") + F.col("w") * F.col("w") * F.col("_dd")).alias("brier"), F.when(F.col("_dd") > 0, F.col("_de") / F.col("_dd")).alias("best"))


def market_residual(df: DataFrame, signal: Column, residual: Column) -> DataFrame:
    """One row: slope of the residual on one sd of the signal, its standard error, t, correlation and count."""
    rows = df.select(signal.alias("v"), residual.alias("r")).dropna()
    x = rows.agg(correlation("v", "r").alias("r"), F.stddev_samp("r").alias("_sd"), F.count(F.lit(1)).alias("n"))
    x = x.withColumn("slope", F.col("r") * F.col("_sd")).withColumn("se", F.when(F.col("n") > 2, F.sqrt((1 - F.col("r") * F.col("r")) / (F.col("n") - 2)) * F.col("_sd")))
    return x.select("slope", "se", F.when(F.col("se") > 0, F.col("slope") / F.col("se")).alias("t"), "r", "n")


def window_sweep(df: DataFrame, keys: list[str], order: list[str], value: str, lengths: tuple[int, ...]) -> DataFrame:
    """Rows (length, n, r): correlation of value with its mean over the last rows, for each length; one window pass."""
    for n in lengths:
        df = asof.rolling_prior(df, keys, order, value, n, f"_m{n}")
    stats = df.agg(*(x for n in lengths for x in (F.count(F.when(F.col(value).isNotNull(), F.col(f"_m{n}"))).alias(f"_n{n}"), correlation(f"_m{n}", value).alias(f"_r{n}"))))
    return stats.select(F.explode(F.array(*(F.struct(F.lit(n).alias("length"), F.col(f"_n{n}").alias("n"), F.col(f"_r{n}").alias("r")) for n in lengths))).alias("x")).select("x.*")


def leak_recount(days: DataFrame, entity: str, day: str, count: str) -> DataFrame:
    """One row: rows of entity and day, those whose strict as-of sum differs when counted by calendar, and those that an inclusive sum would leak into."""
    x = asof.prior_sums(days, [entity], [day], [count], "by_row_")
    x = asof.asof_point(x.withColumn("_k", F.col(count)), [], entity, day, ["_k"], strict_day=True)
    whole = F.sum(count).over(Window.partitionBy(entity).orderBy(asof.day_number(day)).rangeBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_whole", whole)
    bad = lambda c: F.sum(c.cast("long"))
    return x.agg(F.count(F.lit(1)).alias("rows"), bad(F.col(f"by_row_{count}") != F.col("prior__k")).alias("differ"), bad(F.col("_whole") != F.col(f"by_row_{count}")).alias("would_leak"))


def model_analytics(df: DataFrame, p: str, naive: str, y: str, line: str) -> DataFrame:
    """By line and in all ("all"): error of model and naive, the floor mean p (1 - p) of a calibrated model, what is above it, and the gain in per cent."""
    miss = lambda c: F.avg((F.col(c) - F.col(y)) * (F.col(c) - F.col(y)))
    sets = df.withColumn("_line", F.col(line).cast("string")).groupingSets([["_line"], []], "_line").agg(
        miss(naive).alias("naive"), miss(p).alias("model"), F.avg(F.col(p) * (1 - F.col(p))).alias("floor"), F.count(F.lit(1)).alias("n"), F.grouping("_line").alias("_all")
    )
    gain = F.when(F.col("naive") > 0, 100 * (1 - F.col("model") / F.col("naive")))
    return sets.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("_line")).alias("line"), "naive", "model", "floor", (F.col("model") - F.col("floor")).alias("excess"), gain.alias("gain_pct"), "n")


def promotion_blockers(df: DataFrame, n: str, z: str, least: int = 100, need: float = 2.0) -> DataFrame:
    """Reasons that stand against a promotion; none, and the row is ready."""
    reasons = F.array_compact(F.array(F.when(F.col(n) < least, F.lit("thin_sample")), F.when(F.col(z) < need, F.lit("not_significant")), F.when(F.col(z) < 0, F.lit("worse"))))
    return df.withColumn("blockers", reasons).withColumn("ready", F.size("blockers") == 0)


def residual_feature(df: DataFrame, feature: str, on: list[str], name: str) -> DataFrame:
    """feature minus its least-squares fit on others, fitted on all rows."""
    return df.withColumn(name, F.col(feature) - ols(df, on, feature).predictor())
