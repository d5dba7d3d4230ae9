"""Prices, edges and stakes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from priorframe.functions.rates import col

#: Fixed values of the decision rule.
MIN_EDGE, HOLD_MARGIN, UNCONFIRMED_MARGIN, MIN_EV = 0.03, 0.02, 0.05, 0.04
KELLY_CAP = 2.0
DENOMINATIONS = (2.0, 1.5, 1.0, 0.5, 0.25)
ALT_SIDE_MARGIN = 0.04


def parse_american(text) -> Column:
    """Signed odds of a string, which may carry U+2212 for minus; null where it is no number."""
    return F.regexp_replace(F.trim(col(text)), "−", "-").try_cast("int")


def decimal_odds(odds) -> Column:
    """Decimal odds of American odds; null for zero."""
    o = col(odds)
    return F.when(o > 0, 1 + o / 100).when(o < 0, 1 + 100 / -o)


def implied(odds) -> Column:
    """Probability that American odds imply; null for zero."""
    return 1 / decimal_odds(odds)


def no_vig(over, under) -> tuple[Column, Column]:
    """(fair probability of over, hold) of two-sided odds."""
    p, q = implied(over), implied(under)
    return p / (p + q), p + q - 1


def blend(model, fair, weight: float) -> Column:
    return weight * col(model) + (1 - weight) * col(fair)


def expected_value(prob, odds) -> Column:
    """Gain a unit staked."""
    return col(prob) * decimal_odds(odds) - 1


def edge_threshold(hold, confirmed: Column | None = None) -> Column:
    """Edge that a play needs: above the hold, and more while the lineup is not confirmed."""
    least = F.greatest(col(hold) + HOLD_MARGIN, F.lit(MIN_EDGE))
    return least if confirmed is None else least + F.when(confirmed, F.lit(0.0)).otherwise(F.lit(UNCONFIRMED_MARGIN))


def is_play(edge: Column, threshold: Column, ev: Column) -> Column:
    return (edge >= threshold) & (ev >= MIN_EV)


def strength(edge: Column, threshold: Column) -> Column:
    """By how far an edge exceeds its threshold."""
    over = edge - threshold
    return F.when(over >= 0.06, "STRONG").when(over >= 0.03, "MEDIUM").when(over >= 0, "LEAN").otherwise("NO_PLAY")


def kelly_stake(prob, odds, fraction: float = 0.25, cap: float = KELLY_CAP) -> Column:
    """Fractional Kelly stake in units of a hundredth of the bank, between 0 and cap."""
    b = decimal_odds(odds) - 1
    full = (b * col(prob) - (1 - col(prob))) / b
    return F.when(b > 0, F.greatest(F.lit(0.0), F.least(F.lit(cap), full * fraction * 100))).otherwise(F.lit(0.0))


def quantize(stake, cap: float = KELLY_CAP) -> Column:
    """To the nearest clean stake: whole units (halves to even) from 0.75 on, below that 0.5, 0.25 or none."""
    u = col(stake)
    return F.when(u < 0.125, F.lit(0.0)).when(u < 0.375, F.lit(0.25)).when(u < 0.75, F.lit(0.5)).otherwise(F.least(F.bround(u, 0), F.lit(cap)))


def quantize_down(stake, denominations: tuple[float, ...] = DENOMINATIONS) -> Column:
    """The greatest denomination that is not above stake, or 0."""
    out = F.lit(0.0)
    for d in sorted(denominations):
        out = F.when(col(stake) >= d - 1e-9, F.lit(d)).otherwise(out)
    return out


def profit(grade, stake, odds) -> Column:
    """Gain of a settled position; null for a win whose odds are unusable."""
    g = col(grade)
    return F.when(g == "WIN", col(stake) * (decimal_odds(odds) - 1)).when(g == "LOSS", -col(stake)).when(g.isin("PUSH", "VOID", "POSTPONED"), F.lit(0.0))


def grade_line(actual, line, side: Column) -> Column:
    """WIN, LOSS or PUSH of an over or under pick; null without an actual."""
    a, x = col(actual), col(line)
    over = side == "over"
    return F.when(a.isNull(), F.lit(None)).when(a == x, "PUSH").when((a > x) == over, "WIN").otherwise("LOSS")


def grade_milestone(actual, milestone) -> Column:
    a = col(actual)
    return F.when(a.isNull(), F.lit(None)).when(a >= col(milestone), "WIN").otherwise("LOSS")


def clv_probability(open_fair, close_fair) -> Column:
    """Closing line value as a difference of fair probabilities, close less open."""
    return col(close_fair) - col(open_fair)


def clv_price(open_odds, close_odds) -> Column:
    """Closing line value in percent of the price: decimal open over decimal close, less one."""
    return 100 * (decimal_odds(open_odds) / decimal_odds(close_odds) - 1)


def parse_line(text) -> Column:
    """struct(value, is_milestone) of "5.5" or "6+"."""
    t = F.trim(col(text))
    return F.struct(F.regexp_replace(t, r"\+$", "").try_cast("double").alias("value"), t.endswith("+").alias("is_milestone"))


def innings_to_outs(text) -> Column:
    """"6.2" to 20."""
    parts = F.split(col(text), r"\.")
    return parts[0].try_cast("int") * 3 + F.coalesce(F.get(parts, 1).try_cast("int"), F.lit(0))
