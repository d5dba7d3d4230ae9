"""Context of an episode that is known before it: rest, travel, weather, officials, market."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorframe.functions.rates import col

#: Factor of the share of chased balls by month.
MONTH_FACTORS = {3: 1.02, 4: 1.02, 5: 1.01, 6: 1.00, 7: 0.99, 8: 0.98, 9: 0.97, 10: 0.96}


def blowout_risk(run_line, total) -> Column:
    """Risk in [0, 1] that a game is decided early, from the market's spread and total; null if either is unknown."""
    # A spread of 3 and a total of 8 to 12.
    spread, excess = F.abs(col(run_line)) / 3.0, F.greatest(col(total) - 8.0, F.lit(0.0)) / 4.0
    return F.when(spread.isNotNull() & col(total).isNotNull(), F.least((spread + excess) / 2.0, F.lit(1.0)))


def official_age(birth_year, year) -> Column:
    return (col(year) - col(birth_year)).cast("double")


def grip_penalty(humidity_pct) -> Column:
    """Loss in air drier than 35 percent, by the distance from 50; 0 where humidity is unknown."""
    h = col(humidity_pct).cast("double")
    return F.coalesce(F.when(h < 35, F.abs(h - 50.0) / 50.0 * -0.005), F.lit(0.0))


def eastward_hours(previous_zone, zone) -> Column:
    """Time zones travelled to the east; 0 if unknown."""
    return F.coalesce(F.greatest(col(zone) - col(previous_zone), F.lit(0)), F.lit(0))


def travel_fatigue(previous_zone, zone) -> Column:
    return eastward_hours(previous_zone, zone) * 0.15


def adjusted_to_zone(days_there, least: int = 3) -> Column:
    """Whether the body clock has followed: three days there, or nothing known of a journey."""
    return F.coalesce(col(days_there) >= least, F.lit(True))


def second_game(game_number) -> Column:
    return F.coalesce(col(game_number) > 1, F.lit(False))


def month_factor(day) -> Column:
    m = F.month(col(day))
    out = F.lit(1.0)
    for month, factor in MONTH_FACTORS.items():
        out = F.when(m == month, factor).otherwise(out)
    return out


def ladder_divergence(pmf, milestones, odds) -> Column:
    """Struct (spread, widest) of the differences between a model's tail and the prices' implied probabilities; null without prices.

    pmf is an array of probabilities by count; a milestone beyond it has the tail 0.
    """
    gap = lambda m, o: F.aggregate(F.slice(pmf, m + 1, F.greatest(F.size(pmf) - m, F.lit(0))), F.lit(0.0), lambda a, p: a + p) - F.when(o < 0, -o / (-o + 100.0)).otherwise(100.0 / (o + 100.0))
    gaps = F.zip_with(milestones, odds, gap)
    n = F.size(gaps)
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + g) / n
    spread = F.sqrt(F.aggregate(F.transform(gaps, lambda g: (g - mean) * (g - mean)), F.lit(0.0), lambda a, g: a + g) / n)
    # Of two equally wide gaps the first counts.
    widest = F.aggregate(gaps, F.lit(0.0), lambda a, g: F.when(F.abs(g) > F.abs(a), g).otherwise(a))
    return F.when(n > 0, F.struct(spread.alias("spread"), widest.alias("widest")))
