"""The composed table of a screen: one row an episode, with what every side was known for before it.

Rates of entities, opponents, members and places are counts of earlier days of the
epoch, shrunk to the league's of the same days. League state is aggregated to one row a
day before its window runs, and joined by (epoch, day).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.rates import safe_rate
from priorframe.operators import asof


@dataclass(frozen=True)
class Rate:
    """numerator / denominator (columns of counts), shrunk to the league's rate with a weight; without a weight a plain mean."""

    top: str
    bottom: str
    weight: float | None = None


def shrunk_rates(days: DataFrame, keys: list[str], epoch: str, day: str, rates: dict[str, Rate], gate: int = 0) -> DataFrame:
    """keys, epoch, day and each rate over strictly earlier days of the epoch; null for the first gate days of a key.

    days holds counts by rows of keys, epoch and day (several a day are added up). A rate is
    null where the key has no denominator and no weight, or the league has none yet.
    """
    counts = list(dict.fromkeys(c for r in rates.values() for c in (r.top, r.bottom)))
    by_day = days.groupBy(*keys, epoch, day).agg(*(F.sum(c).alias(c) for c in counts))
    own = asof.prior_sums(by_day, [*keys, epoch], [day], counts).withColumn("_seen", F.row_number().over(Window.partitionBy(*keys, epoch).orderBy(day)) - 1)
    league = asof.prior_day_totals(by_day, [epoch], day, counts, "_league_").select(epoch, day, *(f"_league_{c}" for c in counts))
    rows = own.join(league, [epoch, day])

    def value(r: Rate) -> Column:
        top, bottom = F.col(f"prior_{r.top}").cast("double"), F.col(f"prior_{r.bottom}").cast("double")
        if r.weight is None:
            return top / F.nullif(bottom, F.lit(0.0))
        return (top + r.weight * safe_rate(f"_league_{r.top}", f"_league_{r.bottom}")) / (bottom + r.weight)

    return rows.select(*keys, epoch, day, *(F.when(F.col("_seen") >= gate, value(r)).alias(name) for name, r in rates.items()))


def ratio_to_league(days: DataFrame, keys: list[str], epoch: str, day: str, top: str, bottom: str, least: int, name: str) -> DataFrame:
    """keys, epoch, day, name: a key's mean of strictly earlier days over the league's of the same days; null below least of the denominator."""
    by_day = days.groupBy(*keys, epoch, day).agg(F.sum(top).alias(top), F.sum(bottom).alias(bottom))
    own = asof.prior_sums(by_day, [*keys, epoch], [day], [top, bottom])
    league = asof.prior_day_totals(by_day, [epoch], day, [top, bottom], "_league_").select(epoch, day, safe_rate(f"_league_{top}", f"_league_{bottom}").alias("_mean"))
    ratio = F.col(f"prior_{top}") / F.col(f"prior_{bottom}") / F.nullif(F.col("_mean"), F.lit(0.0))
    return own.join(league, [epoch, day]).select(*keys, epoch, day, F.when(F.col(f"prior_{bottom}") >= least, ratio).alias(name))


def history(days: DataFrame, entity: str, epoch: str, day: str, trials: str, hits: str) -> DataFrame:
    """entity, epoch, day, and of strictly earlier episodes: count, mean trials, mean hits, hits per trial, means of the last 3 and 5, rest."""
    w = Window.partitionBy(entity, epoch).orderBy(day)
    before, last = w.rowsBetween(Window.unboundedPreceding, -1), lambda n: w.rowsBetween(-n, -1)
    enough = lambda n, x: F.when(F.count(hits).over(last(n)) >= max(1, n // 2), x)
    return days.select(
        entity, epoch, day, F.count(F.lit(1)).over(before).alias("starts"), F.avg(trials).over(before).alias("mean_trials"), F.avg(hits).over(before).alias("mean_hits"),
        (F.sum(hits).over(before) / F.nullif(F.sum(trials).over(before), F.lit(0))).alias("hit_rate"), enough(3, F.avg(hits).over(last(3))).alias("last3"), enough(5, F.avg(hits).over(last(5))).alias("last5"),
        F.datediff(F.col(day), F.lag(day).over(w)).alias("rest"),
    )


def design(table: DataFrame, keys: list[str], features: list[str], day_key: Column, noise: int = 50) -> DataFrame:
    """table with flags of missing features (m_*), of short (4 days or fewer), long (7 or more) and unknown rest, and seeded noise columns (noise_0 ...)."""
    flags = {f"m_{f}": F.col(f).isNull().cast("int") for f in features}
    rest = {"rest_short": F.coalesce((F.col("rest") <= 4).cast("int"), F.lit(0)), "rest_long": F.coalesce((F.col("rest") >= 7).cast("int"), F.lit(0)), "rest_unknown": F.col("rest").isNull().cast("int")}
    return table.select(*keys, *features, *(v.alias(n) for n, v in (flags | rest).items()), *(lattice_noise(day_key, i).alias(f"noise_{i}") for i in range(noise)))


#: A prime, and multipliers of the key and of the seed.
PRIME, BY_KEY, BY_SEED = 1_000_003, 7_919, 104_729


def lattice_noise(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key and seed that any engine repeats: products modulo a prime."""
    base = F.pmod(key.cast("long"), F.lit(PRIME))
    mixed = F.pmod(base * (BY_KEY + 2 * seed + 1) + seed * BY_SEED, F.lit(PRIME))
    return F.pmod(mixed * mixed + base, F.lit(PRIME)) / float(PRIME)


def unit_rows(log: DataFrame, entity: str, member: str, epoch: str, day: str, order: str, hit: str, entity_rate: DataFrame, member_rate: DataFrame, least: int) -> DataFrame:
    """Training rows of single units: hit, log odds of both sides' rates before the day, second and later meetings of the episode.

    entity_rate and member_rate: (key, epoch, day, rate, prior); rows with fewer than least
    earlier trials of either side are left out.
    """
    logit = lambda c: F.ln(F.greatest(F.least(F.col(c), F.lit(1 - 1e-4)), F.lit(1e-4)) / (1 - F.greatest(F.least(F.col(c), F.lit(1 - 1e-4)), F.lit(1e-4))))
    meeting = F.row_number().over(Window.partitionBy(entity, member, day).orderBy(order))
    rows = log.withColumn("_meeting", meeting).join(entity_rate.select(entity, epoch, day, F.col("rate").alias("_e"), F.col("prior").alias("_en")), [entity, epoch, day])
    rows = rows.join(member_rate.select(member, epoch, day, F.col("rate").alias("_m"), F.col("prior").alias("_mn")), [member, epoch, day])
    rows = rows.filter((F.col("_en") >= least) & (F.col("_mn") >= least) & F.col("_e").isNotNull() & F.col("_m").isNotNull())
    return rows.select(
        order, entity, member, epoch, day, F.col(hit).alias("y"), logit("_e").alias("entity_odds"), logit("_m").alias("member_odds"), (F.col("_meeting") == 2).cast("int").alias("second"), (F.col("_meeting") >= 3).cast("int").alias("later"),
    )
