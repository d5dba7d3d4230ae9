"""Quotes and positions: as-of captures, de-vigging, ladders, caps, settlement, equity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions import prices
from priorframe.operators.ranking import keep_last


def last_capture(quotes: DataFrame, keys: list[str], captured: str, tie: str) -> DataFrame:
    """The latest capture of each key."""
    return keep_last(quotes, keys, [F.col(captured), F.col(tie)])


def closing_capture(quotes: DataFrame, keys: list[str], captured: str, start: str, tie: str) -> DataFrame:
    """The latest capture up to the start; where there is none, the latest of all. pregame tells which."""
    rows = quotes.withColumn("pregame", F.col(captured) <= F.col(start))
    return keep_last(rows, keys, [F.col("pregame"), F.col(captured), F.col(tie)])


def line_movement(quotes: DataFrame, keys: list[str], captured: str, price: str, start: str | None = None) -> DataFrame:
    """Open, close and move of the price of each key, by time of capture (start: up to it)."""
    rows = quotes if start is None else quotes.filter(F.col(captured) <= F.col(start))
    out = rows.groupBy(*keys).agg(F.min_by(price, captured).alias("open"), F.max_by(price, captured).alias("close"), F.count(F.lit(1)).alias("captures"))
    return out.withColumn("move", F.col("close") - F.col("open"))


def fresh_quotes(quotes: DataFrame, captured: str, as_of: str, ceiling_hours: float, required: list[str]) -> DataFrame:
    """Quotes of the last hours before as_of with all required columns, and their age. Quotes captured later don't exist yet."""
    moment = F.lit(as_of).cast("timestamp")
    age = (F.unix_micros(moment) - F.unix_micros(F.col(captured).cast("timestamp"))) / 3_600_000_000
    rows = quotes.withColumn("snapshot_age_hours", age)
    return rows.dropna(subset=[captured, *required]).filter((F.col("snapshot_age_hours") >= 0) & (F.col("snapshot_age_hours") <= ceiling_hours))


def evaluate_edges(rows: DataFrame, model: str, over: str, under: str, weight: float = 0.5, confirmed: Column | None = None) -> DataFrame:
    """fair, hold, blended probability, the better side with its edge, odds, ev, threshold, strength, stake and play."""
    fair, hold = prices.no_vig(over, under)
    rows = rows.withColumn("fair_over", fair).withColumn("hold", hold)
    rows = rows.withColumn("blended_over", prices.blend(model, "fair_over", weight))
    gain = F.col("blended_over") - F.col("fair_over")
    best_over = gain >= -gain
    rows = rows.withColumn("best_side", F.when(best_over, "OVER").otherwise("UNDER")).withColumn("edge", F.abs(gain))
    rows = rows.withColumn("best_odds", F.when(best_over, F.col(over)).otherwise(F.col(under))).withColumn("best_prob", F.when(best_over, F.col("blended_over")).otherwise(1 - F.col("blended_over")))
    rows = rows.withColumn("threshold", prices.edge_threshold("hold", confirmed)).withColumn("ev", prices.expected_value("best_prob", "best_odds"))
    rows = rows.withColumn("strength", prices.strength(F.col("edge"), F.col("threshold"))).withColumn("play", prices.is_play(F.col("edge"), F.col("threshold"), F.col("ev")))
    return rows.withColumn("stake", F.when(F.col("play"), prices.quantize(prices.kelly_stake("best_prob", "best_odds"))).otherwise(F.lit(0.0)))


def devig_ladder(ladder: DataFrame, holds: DataFrame, key: str, milestone: str, odds: str) -> DataFrame:
    """Fair probabilities of one-sided rungs by the hold of the key's two-sided market, never rising along the ladder."""
    joined = ladder.join(holds.select(key, "hold"), key).withColumn("raw", prices.implied(odds) / (1 + F.col("hold")))
    w = Window.partitionBy(key).orderBy(milestone).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("fair", F.min("raw").over(w))


#: Fixed values of the ladder and of the daily cap.
GAP_MIN, RUNGS, RUNG_FRACTION, ENTITY_CAP = 1.5, 2, 0.5, 3.5
LADDER_THRESHOLD = max(2 * prices.ALT_SIDE_MARGIN + prices.HOLD_MARGIN, prices.MIN_EDGE)
DAILY_CAP, REPEAT_HAIRCUT = 10.0, 0.15
#: Parts that the bets of a day are dealt to.
DAY_PARTS = 256


def evaluate_ladder(rungs: DataFrame, entity: str, columns: dict[str, str], confirmed: Column | None = None, weight: float = 0.5) -> DataFrame:
    """Status and stake of each rung of each entity.

    columns names those of line, side, units (of the primary play), expected,
    milestone, odds, model (probability of the milestone). Statuses are a cascade of
    columns, fixed values in the order in which they apply. Only candidates can have a
    stake, and only the next RUNGS milestones are candidates: the fold in order runs over
    those, whatever the number of rungs. Rungs below 1 or without a price are no rungs.
    """
    c = {k: F.col(v) for k, v in columns.items()}
    base = F.ceil(c["line"]).cast("int")
    is_open = F.coalesce((c["side"] == "OVER") & (c["units"] > 0) & (c["expected"] - c["line"] >= GAP_MIN), F.lit(False))
    rows = rungs.filter((c["milestone"] >= 1) & prices.decimal_odds(c["odds"]).isNotNull())
    rows = rows.withColumn("fair", prices.implied(c["odds"]) / (1 + prices.ALT_SIDE_MARGIN))
    rows = rows.withColumn("blended", prices.blend(c["model"], "fair", weight)).withColumn("edge", F.col("blended") - F.col("fair"))
    rows = rows.withColumn("ev", prices.expected_value("blended", c["odds"]))
    rows = rows.withColumn("raw", F.when(F.col("edge") > 0, prices.kelly_stake("blended", c["odds"])).otherwise(F.lit(0.0)))
    limit = F.lit(LADDER_THRESHOLD) + (F.lit(0.0) if confirmed is None else F.when(confirmed, F.lit(0.0)).otherwise(F.lit(prices.UNCONFIRMED_MARGIN)))
    rows = rows.withColumn("strength", prices.strength(F.col("edge"), limit))
    far = c["milestone"] - base
    status = (
        F.when(c["milestone"] == base, "primary_equivalent").when(~is_open, "passed_gap_gate").when(~far.between(1, RUNGS), "passed_not_next_rung")
        .when(F.col("edge") <= 0, "passed_no_edge").when(F.col("ev") < prices.MIN_EV, "passed_below_ev").when(F.col("raw") < 0.1, "passed_stake_too_small")
        .when(F.col("strength") == "NO_PLAY", "passed_below_threshold").otherwise("candidate")
    )
    rows = rows.withColumn("_status", status)
    ceiling = c["units"] * F.pow(F.lit(RUNG_FRACTION), F.greatest(F.lit(1), far).cast("double"))
    item = F.struct(c["milestone"].alias("milestone"), F.col("_status").alias("status"), F.least(F.col("raw"), F.lit(prices.KELLY_CAP), ceiling).alias("most"), F.col("edge"), F.col("ev"), F.col("strength"), F.col("fair"))
    lists = rows.filter("_status = 'candidate'").groupBy(entity, c["units"].alias("_units")).agg(F.sort_array(F.collect_list(item)).alias("rungs"))
    passed = rows.filter("_status <> 'candidate'").select(entity, c["milestone"].cast("int").alias("milestone"), F.col("_status").alias("status"), F.lit(0.0).alias("units"), "edge", "ev", "strength", "fair")

    def step(acc: Column, x: Column) -> Column:
        stake = F.when(acc["left"] > 0, prices.quantize_down(F.least(x["most"], acc["left"]))).otherwise(F.lit(0.0))
        done = F.when(acc["left"] <= 0, "passed_pitcher_cap").when(stake <= 0, "passed_stake_too_small").otherwise("bet")
        row = F.struct(x["milestone"].alias("milestone"), done.alias("status"), stake.alias("units"), x["edge"].alias("edge"), x["ev"].alias("ev"), x["strength"].alias("strength"), x["fair"].alias("fair"))
        return F.struct((acc["left"] - stake).alias("left"), F.array_append(acc["out"], row).alias("out"))

    empty = F.array().cast("array<struct<milestone:int,status:string,units:double,edge:double,ev:double,strength:string,fair:double>>")
    start = F.struct((F.lit(ENTITY_CAP) - F.coalesce(F.col("_units"), F.lit(0.0))).alias("left"), empty.alias("out"))
    return lists.select(entity, F.explode(F.aggregate("rungs", start, step)["out"]).alias("r")).select(entity, "r.*").unionByName(passed)


def portfolio_cap(bets: DataFrame, day: str, key: str, episode: str, stake: str, edge: str, daily: float = DAILY_CAP) -> DataFrame:
    """Stakes under a daily cap: by edge, plays only, a repeated episode cut by the haircut, stepped down to clean stakes.

    A fold over the bets of a day that can have a stake. While a day is not spent, a
    bet whose stake is clean after the haircut too gets a positive stake, and of
    smaller ones of an episode only the first may; each of the latter that gets none
    follows a stake of its episode. So once twice as many such bets as the cap has
    least stakes came before a bet, of its day or of any part of it, the day is spent.
    Others are capped where they stand.
    """
    least = min(prices.DENOMINATIONS)
    most = 2 * (int(daily / least) + 1)
    item = F.struct((-F.col(edge)).alias("e"), F.col(key).alias("key"), F.col(episode).alias("episode"), F.col(stake).cast("double").alias("stake"))
    rows = bets.select(F.col(day), item.alias("x"), F.pmod(F.xxhash64(F.col(key)), F.lit(DAY_PARTS)).alias("part")).filter("x.stake > 0")
    small = (F.col("x.stake") * (1 - REPEAT_HAIRCUT) < least - 1e-9) & F.col("x.episode").isNotNull()
    rows = rows.withColumn("kind", F.when(F.col("x.stake") < least - 1e-9, 0).when(small, 1).otherwise(2))
    for _ in ("within parts", "within days"):
        # Bets that are out stay in their parts, where they are numbered apart.
        rows = rows.withColumn("first", F.row_number().over(Window.partitionBy(day, "part", "kind", F.when(F.col("kind") == 1, F.col("x.episode"))).orderBy("x")))
        rows = rows.withColumn("kind", F.when((F.col("kind") == 1) & (F.col("first") > 1), 0).otherwise(F.col("kind")))
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(day, "part", F.col("kind") > 0).orderBy("x")))
        rows = rows.withColumn("kind", F.when(F.col("place") > most, 0).otherwise(F.col("kind")))
        rows = rows.withColumn("part", F.when(F.col("kind") > 0, F.lit(-1).cast("long")).otherwise(F.col("part")))
    days = rows.filter("kind > 0").groupBy(day).agg(F.sort_array(F.collect_list("x")).alias("bets"))
    kind = bets.schema[episode].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        asked = F.when(F.array_contains(acc["seen"], x["episode"]), x["stake"] * (1 - REPEAT_HAIRCUT)).otherwise(x["stake"])
        given = F.when(acc["left"] > 0, prices.quantize_down(F.least(asked, acc["left"]))).otherwise(F.lit(0.0))
        seen = F.when(given > 0, F.array_append(acc["seen"], x["episode"])).otherwise(acc["seen"])
        row = F.struct(x["key"].alias("key"), given.alias("units"), (given <= 0).alias("capped"))
        return F.struct((acc["left"] - given).alias("left"), seen.alias("seen"), F.array_append(acc["out"], row).alias("out"))

    key_kind = bets.schema[key].dataType.simpleString()
    start = F.struct(F.lit(float(daily)).alias("left"), F.array().cast(f"array<{kind}>").alias("seen"), F.array().cast(f"array<struct<key:{key_kind},units:double,capped:boolean>>").alias("out"))
    staked = days.select(day, F.explode(F.aggregate("bets", start, step)["out"]).alias("b")).select(day, F.col("b.key").alias(key), "b.units", "b.capped")
    return staked.unionByName(rows.filter("kind = 0").select(day, F.col("x.key").alias(key), F.lit(0.0).alias("units"), F.lit(True).alias("capped")))


def equity_curve(days: DataFrame, scenario: list[str], order: str, gain: str, unit: float = 100.0) -> DataFrame:
    """Flat total, compounding bank (ruined once a factor is not positive), running peak and drawdown."""
    w = Window.partitionBy(*scenario).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    factor = 1 + F.col(gain) / unit
    rows = days.withColumn("flat", F.sum(gain).over(w)).withColumn("ruined", F.max((factor <= 0).cast("int")).over(w) > 0)
    growth = F.sum(F.when(factor > 0, F.ln(factor)).otherwise(F.lit(0.0))).over(w)
    rows = rows.withColumn("bank", F.when(F.col("ruined"), F.lit(0.0)).otherwise(unit * F.exp(growth)))
    rows = rows.withColumn("peak", F.greatest(F.lit(unit), F.max("bank").over(w)))
    return rows.withColumn("drawdown", 1 - F.col("bank") / F.col("peak"))


def performance_splits(settled: DataFrame, splits: list[str]) -> DataFrame:
    """Counts, gain, stake and return by each split on its own, and over all (split and level name the row)."""
    sets = [[F.col(s)] for s in splits] + [[]]
    out = settled.groupingSets(sets, *(F.col(s) for s in splits)).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("grade") == "WIN", 1).otherwise(0)).alias("wins"), F.sum(F.when(F.col("grade") == "LOSS", 1).otherwise(0)).alias("losses"),
        F.sum(F.col("gain")).alias("gain"), F.sum("stake").alias("risked"),
    )
    full = (1 << len(splits)) - 1
    name = F.lit("all")
    for i, s in enumerate(splits):
        name = F.when(F.col("_g") == full - (1 << (len(splits) - 1 - i)), s).otherwise(name)
    level = F.coalesce(*(F.col(s).cast("string") for s in splits), F.lit("all"))
    decided = F.nullif(F.col("wins") + F.col("losses"), F.lit(0))
    return out.select(name.alias("split"), level.alias("level"), "n", "wins", "losses", "gain", "risked", (F.col("wins") / decided).alias("hit_rate"), (F.col("gain") / F.nullif(F.col("risked"), F.lit(0.0))).alias("roi"))
