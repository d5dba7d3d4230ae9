"""Candidate features of an entity's next episode, of strictly earlier days alone.

The log is aggregated once to entity and day, with the place of each unit within its
episode; all else are windows over an entity's earlier days. A day's features thus hold
nothing of the day itself or of later ones, and one shuffle by entity serves them all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.rates import gated_rate
from priorframe.operators import asof
from priorframe.plans.lineup import first_slots


@dataclass(frozen=True)
class Habits:
    """What a row of the log says, as columns: null where it says nothing."""

    done: Column
    hit: Column
    in_zone: Column
    first_try: Column
    good_try: Column
    spin: Column
    extension: Column


@dataclass(frozen=True)
class Gates:
    """Fewest rows below which a feature is null, and the ranges of an episode's units that are early and late.

    The defaults are the fixed values of the candidates.
    """

    zone: int = 50
    first: int = 20
    decay: int = 50
    measure: int = 50
    debut: int = 3
    full: int = 9
    early: int = 9
    late: tuple[int, int] = (19, 27)
    days: int = 30


def habit_days(log: DataFrame, entity: str, episode: list[str], order: list[str], h: Habits, g: Gates) -> DataFrame:
    """One row for each entity and episode: counts and sums of what the features need. episode begins with the day."""
    count = lambda at: F.sum(F.coalesce(at, F.lit(False)).cast("long"))
    seq = F.sum(F.col("_done").cast("long")).over(Window.partitionBy(entity, *episode).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = log.select(
        entity, *episode, *order, F.coalesce(h.done, F.lit(False)).alias("_done"), F.coalesce(h.hit, F.lit(False)).alias("_hit"), h.in_zone.alias("_zone"),
        F.coalesce(h.first_try, F.lit(False)).alias("_first"), F.coalesce(h.good_try, F.lit(False)).alias("_good"), h.spin.cast("double").alias("_spin"), h.extension.cast("double").alias("_ext"),
    ).withColumn("_seq", seq)
    done, hit = F.col("_done"), F.col("_done") & F.col("_hit")
    early, late = F.col("_seq") <= g.early, F.col("_seq").between(*g.late)
    return rows.groupBy(entity, *episode).agg(
        F.count(F.lit(1)).alias("rows"), count(done).alias("done"), F.count("_zone").alias("zone_n"), count(F.col("_zone")).alias("zone_in"), count(F.col("_first")).alias("first_n"), count(F.col("_first") & F.col("_good")).alias("first_good"),
        count(done & early).alias("early_n"), count(hit & early).alias("early_hit"), count(done & late).alias("late_n"), count(hit & late).alias("late_hit"),
        F.count("_spin").alias("spin_n"), F.coalesce(F.sum("_spin"), F.lit(0.0)).alias("spin_sum"), F.count("_ext").alias("ext_n"), F.coalesce(F.sum("_ext"), F.lit(0.0)).alias("ext_sum"),
    )


def habit_state(days: DataFrame, entity: str, day: str, g: Gates) -> DataFrame:
    """Each day of an entity with its habits as of the day: shares, deltas against the days before the last `days`, decay, load, rest.

    days holds one row an entity and day.
    """
    whole = Window.partitionBy(entity).orderBy(asof.day_number(day))
    before = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    rows = days
    for m in ("spin", "ext"):
        # What a day with values would be compared with: the days up to it, and all before them.
        near, all_ = whole.rangeBetween(1 - g.days, 0), whole.rangeBetween(Window.unboundedPreceding, 0)
        parts = [F.sum(f"{m}_{x}").over(w).alias(f"{name}_{x}") for name, w in (("near", near), ("all", all_)) for x in ("n", "sum")]
        rows = rows.withColumn(f"_{m}", F.when(F.col(f"{m}_n") > 0, F.struct(*parts)))
    sums = ["done", "zone_n", "zone_in", "first_n", "first_good", "early_n", "early_hit", "late_n", "late_hit"]
    rows = rows.withColumns(
        {f"p_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums}
        | {f"p_{m}": F.last(f"_{m}", ignorenulls=True).over(before) for m in ("spin", "ext")}
        | {"prior_load": F.last(F.when(F.col("done") >= g.full, F.col("rows")), ignorenulls=True).over(before), "rest": F.datediff(F.col(day), F.max(day).over(before))}
    )
    x = lambda m, field: F.col(f"p_{m}")[field]
    enough = lambda m: x(m, "all_n") >= g.measure
    near = lambda m: x(m, "near_sum") / x(m, "near_n")
    far = lambda m: F.when(x(m, "all_n") > x(m, "near_n"), (x(m, "all_sum") - x(m, "near_sum")) / (x(m, "all_n") - x(m, "near_n")))
    delta = lambda m: F.when(enough(m), near(m) - far(m))
    decays = (F.col("p_done") >= g.decay) & (F.col("p_early_n") > 0) & (F.col("p_late_n") > 0)
    early, late = F.col("p_early_hit") / F.nullif(F.col("p_early_n"), F.lit(0)), F.col("p_late_hit") / F.nullif(F.col("p_late_n"), F.lit(0))
    return rows.select(
        entity, day, gated_rate("p_zone_in", "p_zone_n", g.zone).alias("zone_share"), gated_rate("p_first_good", "p_first_n", g.first).alias("first_share"),
        delta("spin").alias("spin_delta"), F.when(delta("spin").isNotNull(), near("spin")).alias("spin_recent"),
        F.when(enough("ext"), x("ext", "all_sum") / x("ext", "all_n")).alias("extension"), delta("ext").alias("extension_delta"),
        F.when(decays, early).alias("early_rate"), F.when(decays, late).alias("late_rate"), F.when(decays, late - early).alias("decay"),
        "prior_load", "rest", F.col("p_done").alias("units"), (F.col("p_done") / 3.0).alias("innings"), (F.col("p_done") < g.debut).alias("is_debut"),
    )


def opponents_form(log: DataFrame, episode: list[str], side: str, member: str, order: str, done: Column, hit: Column, games: int = 15, least: int = 10, rookie: int = 100) -> DataFrame:
    """episode, side: mean rate of the first members over each one's last games before, and how many of them are new. episode begins with the day."""
    count = lambda at: F.sum(F.coalesce(at, F.lit(False)).cast("long"))
    own = log.groupBy(member, *episode).agg(count(done).alias("n"), count(done & hit).alias("h"))
    before = Window.partitionBy(member).orderBy(*episode).rowsBetween(Window.unboundedPreceding, -1)
    # Games in which the member had a unit are numbered; the last ones before a game are a range of those numbers.
    own = own.withColumn("_game", F.coalesce(F.sum((F.col("n") > 0).cast("long")).over(before), F.lit(0))).withColumn("career", F.coalesce(F.sum("n").over(before), F.lit(0)))
    near = Window.partitionBy(member).orderBy("_game").rangeBetween(-games, -1)
    known = own.select(member, *episode, "career", F.sum("n").over(near).alias("rn"), F.sum("h").over(near).alias("rh"))
    slots = first_slots(log, [*episode, side], member, order).join(known, [member, *episode], "left")
    return slots.groupBy(*episode, side).agg(
        F.avg(gated_rate("rh", "rn", least)).alias("recent_rate"), F.sum((F.coalesce("career", F.lit(0)) < rookie).cast("long")).alias("n_new"), F.count(F.lit(1)).alias("n_slots"),
    )


def league_share(log: DataFrame, day: str, trial: Column, hit: Column, least: int = 1000) -> DataFrame:
    """day, share: hits of trials over all strictly earlier days; null up to least trials."""
    count = lambda at: F.sum(F.coalesce(at, F.lit(False)).cast("long"))
    days = log.groupBy(day).agg(count(trial).alias("t"), count(trial & hit).alias("h"))
    # One row a day: the window over all days is small.
    state = asof.prior_sums(days.withColumn("_all", F.lit(1)), ["_all"], [day], ["t", "h"])
    return state.select(day, gated_rate("prior_h", "prior_t", least + 1).alias("share"))
