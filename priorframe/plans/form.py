"""Form, mix and workload of an entity before each of its days: the whole feature groups, strictly as of the day.

Both start from one row an entity and day, so that all windows share one shuffle by entity.
Kinds (of a unit) are a known vocabulary: each has its own counts, and the mix is a map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.names import age_years, long_absence
from priorframe.functions.rates import gated_rate, safe_rate, shrink_rate
from priorframe.operators import asof

#: Weight and rate that a season's rate is shrunk to, least usage of a kind that counts as breadth, share of fast kinds that is heavy, lengths of rolling rates.
SHRINKAGE, LEAGUE, USED, HEAVY, ROLLING = 70, 0.225, 0.10, 0.60, (3, 5, 10)
#: Episodes of a load distribution, least units of a full one, league means where a side has none, load of the others that is heavy, least days of an absence.
LAST, FULL, LEASH_MEAN, LEASH_STD, HEAVY_LOAD, ABSENCE = 10, 9, 88.0, 14.0, 120, 18


def count(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def form_days(log: DataFrame, entity: str, day: str, kind: str, kinds: tuple[str, ...], flags: dict[str, Column], level: Column) -> DataFrame:
    """One row an entity and day: rows, a count for each flag, sum and count of the level, and rows, swings and whiffs of each kind.

    flags: done, hit, swing, whiff, called, outside, chased, two (a decisive row), two_hit, zone_n, zone_in.
    """
    of_kind = [x for i, k in enumerate(kinds) for x in (count(F.col(kind) == k).alias(f"k{i}_n"), count((F.col(kind) == k) & flags["swing"]).alias(f"k{i}_sw"), count((F.col(kind) == k) & flags["whiff"]).alias(f"k{i}_wh"))]
    return log.groupBy(entity, day).agg(
        F.count(F.lit(1)).alias("rows"), *(count(c).alias(n) for n, c in flags.items()), F.count(level).alias("level_n"), F.coalesce(F.sum(level.cast("double")), F.lit(0.0)).alias("level_sum"), *of_kind,
    )


def form_state(days: DataFrame, entity: str, day: str, kinds: tuple[str, ...], fast: tuple[str, ...], born: Column, level_days: int = 30, least_zone: int = 50) -> DataFrame:
    """entity, day, form of strictly earlier days: rates (plain and shrunk), rolling rates of the last episodes and their trend, level against its baseline, age, mix.

    mix is a map of kinds to (usage, whiff_rate, n), of the kinds that were used.
    """
    before = Window.partitionBy(entity).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    sums = [c for c in days.columns if c not in (entity, day)]
    played = days.withColumn("_played", (F.col("done") > 0).cast("long"))
    x = played.withColumns({f"p_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in sums} | {"_game": F.coalesce(F.sum("_played").over(before), F.lit(0))})
    # Episodes with a unit are numbered; the last ones before a day are a range of numbers.
    last = lambda n: Window.partitionBy(entity).orderBy("_game").rangeBetween(-n, -1)
    x = x.withColumns({f"rolling_{n}": F.sum("hit").over(last(n)) / F.nullif(F.sum("done").over(last(n)), F.lit(0)) for n in ROLLING})
    near = Window.partitionBy(entity).orderBy(asof.day_number(day)).rangeBetween(1 - level_days, 0)
    whole = Window.partitionBy(entity).orderBy(asof.day_number(day))
    parts = F.struct(*(F.sum(f"level_{c}").over(w).alias(f"{name}_{c}") for name, w in (("near", near), ("all", whole)) for c in ("n", "sum")))
    x = x.withColumn("_level", F.when(F.col("level_n") > 0, parts)).withColumn("_level", F.last("_level", ignorenulls=True).over(before))
    v = F.col("_level")
    far = F.when(v["all_n"] > v["near_n"], (v["all_sum"] - v["near_sum"]) / (v["all_n"] - v["near_n"]))
    rate = lambda a, b: F.when(F.col("p_rows") > 0, F.coalesce(safe_rate(a, b), F.lit(0.0)))
    usage = lambda i: F.col(f"p_k{i}_n") / F.nullif(F.col("p_rows"), F.lit(0))
    whiffs = lambda i: F.coalesce(safe_rate(f"p_k{i}_wh", f"p_k{i}_sw"), F.lit(0.0))
    total = lambda terms: sum(terms, F.lit(0.0))
    every = range(len(kinds))
    entry = lambda i: F.struct(F.lit(kinds[i]).alias("key"), F.struct(usage(i).alias("usage"), whiffs(i).alias("whiff_rate"), F.col(f"p_k{i}_n").alias("n")).alias("value"))
    mix = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(f"p_k{i}_n") > 0, entry(i)) for i in every))))
    return x.select(
        entity, day, rate("p_whiff", "p_rows").alias("whiff_share"), rate(F.col("p_whiff") + F.col("p_called"), "p_rows").alias("whiff_or_called"), rate("p_hit", "p_done").alias("rate"),
        F.when(F.col("p_rows") > 0, shrink_rate("p_hit", "p_done", LEAGUE, SHRINKAGE)).alias("rate_shrunk"), rate("p_chased", "p_outside").alias("chase"), rate("p_two_hit", "p_two").alias("put_away"), F.col("p_rows").alias("total_rows"), F.col("p_done").alias("total_units"),
        *(f"rolling_{n}" for n in ROLLING), F.least(F.col("_game"), F.lit(ROLLING[-1])).alias("n_found"), F.when(F.col("_game") >= 5, F.col("rolling_5") - F.col("rolling_10")).alias("trend"),
        (v["near_sum"] / v["near_n"] - far).alias("level_delta"), age_years(born, day).alias("age"), gated_rate("p_zone_in", "p_zone_n", least_zone).alias("zone_share"),
        F.when(F.col("p_rows") > 0, total(usage(i) * whiffs(i) for i in every) / total(usage(i) for i in every)).alias("mix_whiff"), F.when(F.col("p_rows") > 0, total((usage(i) >= USED).cast("int") for i in every).cast("int")).alias("breadth"),
        F.when(F.col("p_rows") > 0, total(usage(i) for i in every if kinds[i] in fast)).alias("fast_share"), mix.alias("mix"),
    )


def workload_state(days: DataFrame, entity: str, side: str, day: str, mix: DataFrame, limits: DataFrame, full: int = FULL, heavy: int = HEAVY_LOAD) -> DataFrame:
    """entity, day, load of strictly earlier days: distribution of the last full episodes, the side's leash, fade by mix, absence, announced limit, load of the side's others.

    days: entity, side, day, rows, done (one row an entity and day). mix: entity, day,
    fast_share, breadth. limits: entity, day, announced_limit.
    """
    own = Window.partitionBy(entity).orderBy(day)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    x = days.withColumn("_full", (F.col("done") >= full).cast("long")).withColumn("_game", F.coalesce(F.sum("_full").over(before), F.lit(0)))
    near = Window.partitionBy(entity).orderBy("_game").rangeBetween(-LAST, -1)
    # At most LAST values and the shorter ones between them, which are null.
    loads = F.sort_array(F.collect_list(F.when(F.col("_full") == 1, F.col("done"))).over(near))
    x = x.withColumn("loads", loads).withColumn("rest", F.datediff(F.col(day), F.lag(day).over(own)))
    n = F.size("loads")
    mean = F.aggregate("loads", F.lit(0.0), lambda a, v: a + v) / n
    spread = F.sqrt(F.aggregate("loads", F.lit(0.0), lambda a, v: a + (v - F.col("load_mean")) * (v - F.col("load_mean"))) / (n - 1))
    shares = F.map_from_entries(F.transform(F.array_distinct("loads"), lambda v: F.struct(v.alias("key"), (F.size(F.filter("loads", lambda w: w == v)) / n).alias("value"))))
    x = x.withColumn("load_mean", F.when(n > 0, mean)).withColumn("load_std", F.when(n > 1, spread).when(n == 1, 0.0)).withColumn("load_dist", shares)

    # The leash of a side: rows of its full episodes; and what its others have done in the last days.
    sides = days.groupBy(side, day).agg(
        count(F.col("done") >= full).alias("_n"), F.coalesce(F.sum(F.when(F.col("done") >= full, F.col("rows"))), F.lit(0)).alias("_s"), F.coalesce(F.sum(F.when(F.col("done") >= full, F.col("rows") * F.col("rows"))), F.lit(0)).alias("_q"),
        F.coalesce(F.sum(F.when((F.col("done") < full) & (F.col("done") > 0), F.col("rows"))), F.lit(0)).alias("_others"),
    )
    ahead = Window.partitionBy(side).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    range_ = lambda d: Window.partitionBy(side).orderBy(asof.day_number(day)).rangeBetween(-d, -1)
    sides = sides.withColumns({f"_p{c}": F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in ("_n", "_s", "_q")} | {f"others_{d}d": F.coalesce(F.sum("_others").over(range_(d)), F.lit(0)) for d in (2, 3)})
    variance = (F.col("_p_q") - F.col("_p_s") * F.col("_p_s") / F.col("_p_n")) / (F.col("_p_n") - 1)
    leash = sides.select(
        side, day, F.when(F.col("_p_n") > 0, F.col("_p_s") / F.col("_p_n")).otherwise(LEASH_MEAN).alias("leash_mean"), F.when(F.col("_p_n") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)))).when(F.col("_p_n") == 0, LEASH_STD).alias("leash_std"),
        "others_2d", "others_3d", (F.col("others_2d") > heavy).alias("others_heavy"),
    )
    x = x.join(leash, [side, day]).join(mix.select(entity, day, "fast_share", "breadth"), [entity, day]).join(limits.select(entity, day, "announced_limit"), [entity, day], "left")
    fade = F.when(F.col("fast_share") > HEAVY, -0.04).when(F.col("breadth") >= 4, -0.02).when(F.col("fast_share").isNotNull(), -0.03).otherwise(0.0)
    return x.select(
        entity, day, "load_mean", "load_std", F.size("loads").alias("load_n"), "load_dist", "leash_mean", "leash_std", F.coalesce(F.col("fast_share") > HEAVY, F.lit(False)).alias("fast_heavy"), fade.alias("fade"),
        long_absence("rest", ABSENCE).alias("back_from_absence"), "announced_limit", "others_2d", "others_3d", "others_heavy",
    )
