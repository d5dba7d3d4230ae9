"""Probability mass functions as array columns, computed by folds in the JVM.

Index i of an array is the value i. Folds run over the units of one episode or the values
of one distribution, which are a few dozen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the early-exit mixture.
HOOK_SHARE, HOOK_MEAN, HOOK_ALPHA = 0.0213, 5.99, 1e-3
UNITS_PER_ACTOR_LIMIT = 3.8


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def normalize(pmf: Column) -> Column:
    return _let(pmf, lambda p: _let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(p, lambda x: x / t)))


def tail_at_least(pmf: Column, value: Column) -> Column:
    """P(X >= ceil(value))."""
    first = F.greatest(F.ceil(value).cast("int"), F.lit(0))
    return F.aggregate(F.slice(pmf, first + 1, F.greatest(F.size(pmf) - first, F.lit(0))), F.lit(0.0), lambda a, x: a + x)


def tail_above(pmf: Column, line: Column, refuse_whole: bool = False) -> Column:
    """P(X > line); with refuse_whole a line without a fraction is an error."""
    over = tail_at_least(pmf, F.floor(line) + 1)
    return F.when(line == F.floor(line), F.raise_error(F.lit("line must have a fraction"))).otherwise(over) if refuse_whole else over


def negbin_pmf(mu: Column, alpha: Column, top: int) -> Column:
    """Negative binomial of mean mu and dispersion alpha on 0..top, by the recurrence of its terms (not renormalized)."""

    def with_size(v: Column) -> Column:
        size, p = v["size"], v["size"] / (v["size"] + v["mu"])
        first = F.exp(size * F.ln(p))
        start = F.struct(first.alias("term"), F.array(first).alias("out"))
        step = lambda a, k: _let(a["term"] * (k - 1 + size) / k * (1 - p), lambda t: F.struct(t.alias("term"), F.array_append(a["out"], t).alias("out")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(top)), start, step)["out"]

    return _let(F.struct((1 / alpha).alias("size"), mu.cast("double").alias("mu")), with_size)


def hook_mixture_pmf(mu: Column, alpha: Column, top: int = 40, share: float = HOOK_SHARE, mean: float = HOOK_MEAN, short_alpha: float = HOOK_ALPHA) -> Column:
    """Early exit with probability share, else a normal outing whose mean keeps that of the mixture at mu."""
    normal = F.greatest((mu - share * mean) / (1 - share), F.lit(1.0))
    both = F.zip_with(negbin_pmf(F.lit(mean), F.lit(short_alpha), top), negbin_pmf(normal, alpha, top), lambda s, n: share * s + (1 - share) * n)
    return normalize(both)


def capped_mean(mu: Column, limit: Column) -> Column:
    """mu under a limit of units; no limit, no cap."""
    return F.coalesce(F.least(mu, limit / UNITS_PER_ACTOR_LIMIT), mu)


def poisson_binomial(probs: Column) -> Column:
    """Distribution of the number of successes in trials of the given probabilities."""

    def step(pmf: Column, p: Column) -> Column:
        return F.zip_with(F.array_append(pmf, F.lit(0.0)), F.array_prepend(pmf, F.lit(0.0)), lambda stay, up: stay * (1 - p) + up * p)

    return F.aggregate(probs, F.array(F.lit(1.0)), step)


def compound(probs: Column, trials: Column) -> Column:
    """Successes when the number of trials n has the pmf trials and trial i the probability probs[i].

    One fold: after n trials the state's pmf is weighted with trials[n] and added up.
    """
    size = F.size(probs) + 1
    first = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), size - 1))
    start = F.struct(first.alias("pmf"), F.transform(first, lambda x: x * F.coalesce(F.get(trials, F.lit(0)), F.lit(0.0))).alias("out"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        moved = F.zip_with(a["pmf"], F.slice(F.array_prepend(a["pmf"], F.lit(0.0)), F.lit(1), size), lambda stay, up: stay * (1 - p) + up * p)
        weight = F.coalesce(F.get(trials, a["n"] + 1), F.lit(0.0))
        return _let(moved, lambda m: F.struct(m.alias("pmf"), F.zip_with(a["out"], m, lambda o, x: o + weight * x).alias("out"), (a["n"] + 1).alias("n")))

    return F.aggregate(probs, start, step)["out"]


def binomial_pmf(n: Column, p: Column, top: int | Column) -> Column:
    """Binomial on 0..top (1 at least) by the recurrence of its terms."""
    top = F.lit(top) if isinstance(top, int) else top
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    first = F.exp(n * F.ln(1 - q))
    step = lambda a, k: _let(F.when(k <= n, a["term"] * (n - k + 1) / k * q / (1 - q)).otherwise(F.lit(0.0)), lambda t: F.struct(t.alias("term"), F.array_append(a["out"], t).alias("out")))
    return F.aggregate(F.sequence(F.lit(1), top), F.struct(first.alias("term"), F.array(first).alias("out")), step)["out"]


def binomial_mixture(mean: Column, sd: Column, p: Column, top: int | None = None) -> Column:
    """Binomial over trial counts with discretized normal weights within three sd; an sd of none is one of 0.5.

    The support ends at top, or at the row's own largest number of trials.
    """
    s = F.greatest(F.coalesce(sd, F.lit(0.5)), F.lit(0.5))
    low = F.greatest(F.floor(mean - 3 * s).cast("int"), F.lit(1))
    counts = F.sequence(low, F.greatest(low, F.ceil(mean + 3 * s).cast("int")))
    weights = normalize(F.transform(counts, lambda n: F.exp(-F.pow((n - mean) / s, F.lit(2.0)) / 2)))
    top = F.element_at(counts, -1) if top is None else F.lit(top)
    start = F.array_repeat(F.lit(0.0), top + 1)
    return F.aggregate(F.arrays_zip(counts.alias("n"), weights.alias("w")), start, lambda acc, x: F.zip_with(acc, binomial_pmf(x["n"].cast("double"), p, top), lambda a, b: a + x["w"] * b))


def survival_pmf(complete: Column, partial: Column) -> Column:
    """Values 3*j + r of an episode of parts: complete[j] = P(part j is completed), partial[j] = weights of stopping in it at r = 0, 1, 2.

    Survival is a fold over the parts; the last value is that of completing all.
    """
    start = F.struct(F.lit(1.0).alias("alive"), F.array().cast("array<double>").alias("out"), F.lit(0).alias("j"))

    def step(a: Column, c: Column) -> Column:
        stop = a["alive"] * (1 - c)
        shares = F.transform(F.get(partial, a["j"]), lambda w: w * stop)
        return F.struct((a["alive"] * c).alias("alive"), F.concat(a["out"], shares).alias("out"), (a["j"] + 1).alias("j"))

    return _let(F.aggregate(complete, start, step), lambda r: F.array_append(r["out"], r["alive"]))


def distribution_mean(pmf: Column) -> Column:
    return F.aggregate(F.transform(pmf, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
