"""Features of a lineup against its opponent, of staff, and of an entity's own habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.rates import LEAGUE_RATE, col, gated_rate, matchup_rate, safe_rate
from priorframe.operators import asof

#: Expected turns of each of nine slots; weights of the prior by the pitcher's hand; fewest earlier trials of a regular and of a veteran.
SLOT_WEIGHTS = (4.65, 4.53, 4.41, 4.29, 4.17, 4.05, 3.93, 3.82, 3.71)
PLATOON_WEIGHT = {"R": 1670, "L": 570}
REGULAR, VETERAN = 30, 100


def first_slots(log: DataFrame, keys: list[str], member: str, order: str, slots: int = len(SLOT_WEIGHTS)) -> DataFrame:
    """keys, member, pos: the members in the order in which they first appear, as many as a lineup has slots."""
    first = log.groupBy(*keys, member).agg(F.min(order).alias("_first"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_first"))).filter(F.col("pos") <= slots).drop("_first")


def effective_side(bats, hand) -> Column:
    """The side a member stands on: one of both sides ("S") takes that opposite to the pitcher's hand."""
    return F.when(col(bats) == "S", F.when(col(hand) == "L", "R").otherwise("L")).otherwise(col(bats))


def lineup_aggregates(slots: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each lineup, from its slots: keys, pos, rate, own_rate (the opponent's), chase, contact, stands, trials.

    Unknown rates count as the league's; unknown chase and contact rates are left out of their means.
    """
    rate, own = F.coalesce("rate", F.lit(LEAGUE_RATE)), F.coalesce("own_rate", F.lit(LEAGUE_RATE))
    rows = slots.withColumn("_w", F.element_at(F.array(*map(F.lit, SLOT_WEIGHTS)), F.col("pos").cast("int")))
    weighted = lambda x: F.sum(x * F.col("_w")) / F.sum("_w")
    count = lambda x: F.sum(x.cast("long"))
    out = rows.groupBy(*keys).agg(
        weighted(rate).alias("weighted_rate"), weighted(matchup_rate(rate, own)).alias("matchup"), F.avg(rate).alias("mean_rate"), F.avg("chase").alias("chase"), F.avg("contact").alias("contact"),
        count(F.col("stands") == "L").alias("n_left"), count(F.col("trials") < REGULAR).alias("n_bench"), count(F.col("trials") < VETERAN).alias("n_rookies"), F.count(F.lit(1)).alias("n_slots"),
    )
    return out.withColumn("left_share", F.col("n_left") / F.col("n_slots")).withColumn("rookie_share", F.col("n_rookies") / F.col("n_slots"))


def member_list(slots: DataFrame, keys: list[str]) -> DataFrame:
    """keys, members: a lineup as an array of (slot, side, rate, matchup, weight) in order; a lineup has as many slots as there are weights."""
    rate, own = F.coalesce("rate", F.lit(LEAGUE_RATE)), F.coalesce("own_rate", F.lit(LEAGUE_RATE))
    weight = F.element_at(F.array(*map(F.lit, SLOT_WEIGHTS)), F.col("pos").cast("int"))
    member = F.struct(F.col("pos").cast("int").alias("slot"), F.col("stands").alias("side"), rate.alias("rate"), matchup_rate(rate, own).alias("matchup"), weight.alias("weight"))
    return slots.groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("members"))


def platoon_regressed(rate, trials, hand, prior=LEAGUE_RATE) -> Column:
    """A rate by side shrunk to prior with the weight of the pitcher's hand; the prior where it is unknown."""
    weight = F.when(col(hand) == "L", F.lit(PLATOON_WEIGHT["L"])).otherwise(F.lit(PLATOON_WEIGHT["R"]))
    return F.coalesce((col(rate) * col(trials) + weight * col(prior)) / (col(trials) + weight), col(prior))


def over_league(days: DataFrame, entity: str, day: str, trials: str, hits: str, least: int, name: str) -> DataFrame:
    """entity, day, name: rate of strictly earlier days less the league's of the same days; null below least trials."""
    own = asof.prior_day_totals(days, [entity], day, [trials, hits])
    # One row a day: the window over all days is small.
    league = asof.prior_day_totals(days.withColumn("_all", F.lit(1)), ["_all"], day, [trials, hits], "league_").select(day, safe_rate(f"league_{hits}", f"league_{trials}").alias("_q"))
    return own.join(league, day).select(entity, day, (gated_rate(f"prior_{hits}", f"prior_{trials}", least) - F.col("_q")).alias(name))


def slot_stats(log: DataFrame, entity: str, slot: str, hit: str) -> DataFrame:
    """Trials, rate and the spread of entities' rates by slot."""
    cells = log.groupBy(slot, entity).agg(F.count(F.lit(1)).alias("_n"), F.sum(hit).alias("_h"))
    return cells.groupBy(slot).agg(F.sum("_n").alias("n"), (F.sum("_h") / F.sum("_n")).alias("rate"), F.stddev_samp(F.col("_h") / F.col("_n")).alias("spread"), F.count(F.lit(1)).alias("entities"))
