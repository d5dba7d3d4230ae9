"""The board of a day: quotes, schedule and what was known before, through gates to ledger rows.

Every quote has a row in the result: one that no gate stops is scored, priced, staked,
laddered and capped; another has the first reason that stopped it. Each step is a join on
(day, entity) or a column, but for the daily cap, which is dealt to parts of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorframe.functions import pmf as X
from priorframe.operators import market

#: Values of a distribution of hits, and its dispersion.
TOP, DISPERSION = 24, 0.2


def latest_quotes(quotes: DataFrame, captured: str, start: str, ceiling_hours: float) -> DataFrame:
    """The last quote of each day and entity before its start, and stale: whether it is older than the ceiling then."""
    rows = quotes.filter(F.col(captured) <= F.col(start))
    last = market.last_capture(rows, ["day", "entity"], captured, "quote")
    age = (F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(F.col(captured).cast("timestamp"))) / 3_600_000_000
    return last.withColumn("stale", age > ceiling_hours)


def gated(quotes: DataFrame, schedule: DataFrame, state: DataFrame, least_games: int, least_mean: float) -> DataFrame:
    """quotes with schedule (confirmed, regular) and state (games, mean, rate), and reason: the first gate that stops it, or null.

    Gates in order: stale quote, not on the schedule, not a regular game, too few
    episodes, too short ones.
    """
    x = quotes.join(schedule.withColumn("scheduled", F.lit(True)), ["day", "entity"], "left").join(state, ["day", "entity"], "left")
    reason = (
        F.when(F.col("stale"), "stale_quote").when(F.col("scheduled").isNull(), "not_scheduled").when(~F.col("regular"), "not_regular")
        .when(F.coalesce("games", F.lit(0)) < least_games, "few_appearances").when(F.col("mean") < least_mean, "short_outings")
    )
    return x.withColumn("reason", reason)


def scored(rows: DataFrame, line: str, prior_rate: Column, weight: float) -> DataFrame:
    """rows with the expected hits and their distribution, and the probability of more than the line.

    Trials are negative binomial around the mean, each a hit with the shrunk rate, so
    hits are negative binomial around the product with the same size.
    """
    rate = (F.col("hits") + weight * prior_rate) / (F.col("trials") + weight)
    x = rows.withColumn("expected", F.col("mean") * rate)
    x = x.withColumn("pmf", X.negbin_pmf(F.col("expected"), F.lit(DISPERSION), TOP))
    below = F.aggregate(F.slice("pmf", F.lit(1), F.floor(F.col(line)).cast("int") + 1), F.lit(0.0), lambda a, p: a + p)
    return x.withColumn("p_over", 1 - below)


def board(rows: DataFrame, rungs: DataFrame, line: str, over: str, under: str) -> DataFrame:
    """Ledger rows of scored quotes and of their rungs: day, entity, kind, at (line or milestone), side, odds, prob, fair, edge, status, units, capped.

    rungs: day, entity, milestone, odds. Rows that a gate stopped have its reason as
    their status. Units are what the daily cap leaves of a stake.
    """
    playable = rows.filter("reason IS NULL")
    priced = market.evaluate_edges(playable, "p_over", over, under, 0.5, F.col("confirmed"))
    key = F.concat_ws("/", F.col("day").cast("string"), F.col("entity").cast("string"))
    primary = priced.select("day", "entity", F.lit("primary").alias("kind"), F.col(line).cast("double").alias("at"), F.col("best_side").alias("side"), F.col("best_odds").alias("odds"), F.col("best_prob").alias("prob"), F.col("fair_over").alias("fair"), "edge", F.when(F.col("play"), "bet").otherwise("no_play").alias("status"), F.col("stake").alias("stake"))
    # A rung's probability is the tail of its entity's distribution.
    tail = 1 - F.aggregate(F.slice("pmf", F.lit(1), F.col("milestone")), F.lit(0.0), lambda a, p: a + p)
    steps = priced.join(rungs.withColumnRenamed("odds", "rung_odds"), ["day", "entity"]).select(key.alias("key"), F.col(line).alias("line"), F.col("best_side").alias("side"), F.col("stake").alias("units"), "expected", "milestone", F.col("rung_odds").alias("odds"), tail.alias("model"))
    names = {c: c for c in ("line", "side", "units", "expected", "milestone", "odds", "model")}
    laddered = market.evaluate_ladder(steps, "key", names).join(steps.select("key", "milestone", "odds", "model"), ["key", "milestone"])
    at = F.split("key", "/")
    ladder = laddered.select(at[0].cast("date").alias("day"), at[1].cast(rows.schema["entity"].dataType).alias("entity"), F.lit("ladder").alias("kind"), F.col("milestone").cast("double").alias("at"), F.lit("OVER").alias("side"), "odds", F.col("model").alias("prob"), "fair", "edge", "status", F.col("units").alias("stake"))
    stopped = rows.filter("reason IS NOT NULL").select("day", "entity", F.lit("primary").alias("kind"), F.col(line).cast("double").alias("at"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("int").alias("odds"), F.lit(None).cast("double").alias("prob"), F.lit(None).cast("double").alias("fair"), F.lit(None).cast("double").alias("edge"), F.col("reason").alias("status"), F.lit(0.0).alias("stake"))
    all_ = primary.unionByName(ladder).withColumn("bet", F.concat_ws("/", F.col("day").cast("string"), F.col("entity").cast("string"), "kind", F.col("at").cast("string")))
    capped = market.portfolio_cap(all_.select("day", "bet", "entity", "stake", "edge"), "day", "bet", "entity", "stake", "edge").select("bet", "units", "capped")
    rows = all_.join(capped, "bet", "left").withColumn("units", F.coalesce("units", F.lit(0.0))).withColumn("capped", F.coalesce("capped", F.lit(False)))
    return rows.drop("bet").unionByName(stopped.withColumn("units", F.lit(0.0)).withColumn("capped", F.lit(False)))
