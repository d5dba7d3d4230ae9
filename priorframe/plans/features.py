"""Feature sets: compositions of as-of operators, and the registry that names them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.names import role_bucket
from priorframe.functions.rates import gated_rate, safe_rate, shrink_rate
from priorframe.operators import aggregates, asof


@dataclass(frozen=True)
class Feature:
    """A feature by name: its keys, how to build it, and what is claimed of it."""

    name: str
    keys: tuple[str, ...]
    build: Callable[[DataFrame], Column]
    expected_sign: int = 0
    known_before: bool = True
    collinear_with: tuple[str, ...] = ()


@dataclass
class Registry:
    features: dict[str, Feature] = field(default_factory=dict)

    def add(self, feature: Feature) -> Feature:
        if feature.name in self.features:
            raise ValueError(f"{feature.name} is registered already")
        self.features[feature.name] = feature
        return feature

    def apply(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """df with the named features (all that its columns allow)."""
        chosen = [self.features[n] for n in names] if names else [f for f in self.features.values() if set(f.keys) <= set(df.columns)]
        return df.withColumns({f.name: f.build(df) for f in chosen})


def entity_asof_table(days: DataFrame, entity: str, epoch: str, day: str, trials: str, successes: str, weight: float, prior: float, place: str | None = None) -> DataFrame:
    """Labels with what was known before: games, trials, successes, rate, shrunk rate, mean and sd of trials, days since and shift of place."""
    rows = days.withColumn("games", F.lit(1).cast("long"))
    rows = asof.prior_sums(rows, [entity, epoch], [day], [trials, successes, "games"])
    rows = asof.prior_mean_std(rows, [entity, epoch], [day], trials)
    rows = rows.withColumn("asof_rate", safe_rate(f"prior_{successes}", f"prior_{trials}")).withColumn("asof_shrunk", shrink_rate(f"prior_{successes}", f"prior_{trials}", prior, weight))
    return rows if place is None else asof.lag_diff(rows, [entity, epoch], [day], day, place)


def league_asof(days: DataFrame, epoch: str, day: str, sums: list[str]) -> DataFrame:
    """Sums of all entities over strictly earlier days of the epoch: one row a day."""
    return asof.prior_day_totals(days, [epoch], day, sums, "league_")


def exposure_features(days: DataFrame, entity: str, epoch: str, day: str, value: str, load: str, marks: tuple[int, ...], weight_level: float = 1.0, weight_stop: float = 24.0, weight_league: float = 200.0, log_start: str = "1900-01-01") -> DataFrame:
    """What an episode's length depends on: prior mean (shrunk to the league's), prior hazards of stopping at marks, rest, ordinals, recent load.

    A stop rate is that of episodes that got as far; both it and the level are shrunk
    to the league's of strictly earlier days, and the league's stop rate to its own mean.
    """
    flags = {f"at{m}": (F.col(value) == m).cast("long") for m in marks} | {f"to{m}": (F.col(value) >= m).cast("long") for m in marks}
    rows = days.withColumn("games", F.lit(1).cast("long")).withColumns(flags)
    sums = [value, "games", *flags]
    league = league_asof(rows, epoch, day, sums).select(epoch, day, *(f"league_{s}" for s in sums))
    rows = asof.prior_sums(rows, [entity, epoch], [day], sums).join(league, [epoch, day])
    rows = asof.ordinal(asof.rolling_prior(asof.lag_diff(rows, [entity, epoch], [day], day, value), [entity, epoch], [day], load, 5, "load5"), entity, [day], day, 50, log_start)
    mean = safe_rate(f"league_{value}", "league_games")
    out = rows.withColumn("level", safe_rate(f"prior_{value}", "prior_games")).withColumn("level_shrunk", (F.col(f"prior_{value}") + weight_level * mean) / (F.col("prior_games") + weight_level))
    for m in marks:
        base = (F.col(f"league_at{m}") + weight_league * 0.1) / (F.col(f"league_to{m}") + weight_league)
        out = out.withColumn(f"stop_{m}", (F.col(f"prior_at{m}") + weight_stop * base) / (F.col(f"prior_to{m}") + weight_stop))
    return out.withColumn("rest", role_bucket("days_since_prior")).withColumn("league_mean", mean)


def place_rate(days: DataFrame, place: str, epoch: str, day: str, trials: str, successes: str, weight: float = 400.0, gate: int = 20) -> DataFrame:
    """Rate of a place over strictly earlier days, shrunk to the league's; null below gate days."""
    at = asof.prior_day_totals(days.withColumn("d", F.lit(1).cast("long")), [place, epoch], day, [trials, successes])
    seen = F.count(F.lit(1)).over(Window.partitionBy(place, epoch).orderBy(day).rowsBetween(Window.unboundedPreceding, -1))
    league = league_asof(days, epoch, day, [trials, successes]).select(epoch, day, safe_rate(f"league_{successes}", f"league_{trials}").alias("_q"))
    rows = at.withColumn("days", seen).join(league, [epoch, day])
    return rows.select(place, epoch, day, F.when(F.col("days") >= gate, shrink_rate(f"prior_{successes}", f"prior_{trials}", "_q", weight)).alias("rate"))


def form_features(log: DataFrame, entity: str, day: str, kind: str, swing: str, whiff: str, success: str, value: str, fast: tuple[str, ...]) -> DataFrame:
    """Form of each entity over its log: rates, last five and ten days, mix breadth, share of fast kinds, recent against baseline level."""
    base = log.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), safe_rate(F.sum(whiff), F.count(F.lit(1))).alias("whiff_rate"), safe_rate(F.sum(success), F.count(F.lit(1))).alias("success_rate"), F.avg(F.col(kind).isin(*fast).cast("double")).alias("fast_share"))
    days = log.groupBy(entity, day).agg(F.count(F.lit(1)).alias("t"), F.sum(success).alias("s"))
    five = asof.last_n_rate(days, entity, [day], "s", "t", 5).select(entity, F.col("rate").alias("last5"))
    ten = asof.last_n_rate(days, entity, [day], "s", "t", 10).select(entity, F.col("rate").alias("last10"))
    mix = aggregates.usage_mix(log, entity, kind, F.col(swing) == 1, F.col(whiff) == 1).select(entity, "breadth", "weighted_rate")
    level = asof.recent_vs_baseline(log, entity, day, value, 10)
    out = base.join(five, entity).join(ten, entity).join(mix, entity).join(level, entity)
    return out.withColumn("trend", F.col("last5") - F.col("last10")).withColumn("level_delta", F.col("recent") - F.col("baseline"))


def workload_features(days: DataFrame, entity: str, day: str, load: str) -> DataFrame:
    """Rest, load of the last 15 and 30 days, longest and mean load of the last five, share of short outings before."""
    rows = asof.lag_diff(days, [entity], [day], day, load)
    rows = asof.calendar_window(asof.calendar_window(rows, [entity], day, load, 15, "load15"), [entity], day, load, 30, "load30")
    w = Window.partitionBy(entity).orderBy(day)
    rows = rows.withColumn("max5", F.max(load).over(w.rowsBetween(-5, -1))).withColumn("mean5", F.avg(load).over(w.rowsBetween(-5, -1)))
    return rows.withColumn("short_share", F.avg((F.col(load) < 3).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def training_set(labels: DataFrame, features: DataFrame, keys: list[str], least_trials: int, least_games: int) -> DataFrame:
    """Labels with their as-of features, where history and size suffice and the rate is known."""
    joined = labels.join(features, keys)
    return joined.filter((F.col("n") >= least_trials) & (F.col("prior_games") >= least_games) & F.col("asof_rate").isNotNull())


def gated_profile(log: DataFrame, entity: str, success: str, swing: str, whiff: str, least: int = 10) -> DataFrame:
    """Lineup members' rates, each with its gate."""
    g = log.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum(success).alias("s"), F.sum(swing).alias("sw"), F.sum(whiff).alias("wh"))
    return g.select(entity, "n", safe_rate("s", "n").alias("rate"), gated_rate(F.col("sw") - F.col("wh"), "sw", least).alias("contact"))
