"""As-of state: what was known of an entity strictly before a row or a day.

Two granularities exist and are never mixed: *prior row* (the own row is left out,
other rows of the day count) and *prior day* (the whole day is left out). Each has
functions of its own. Missing inputs stay null; an entity without history has sums
of zero and means of null.

Windows partition by the entity, or an epoch of it. League-wide state is aggregated
to days first, so that its windows run over one row a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def _before(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def day_number(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def prior_sums(df: DataFrame, keys: list[str], order: list[str], sums: list[str], prefix: str = "prior_") -> DataFrame:
    """Sums over the strictly earlier rows of the keys."""
    w = _before(keys, order)
    return df.withColumns({f"{prefix}{c}": F.coalesce(F.sum(c).over(w), F.lit(0).cast(df.schema[c].dataType)) for c in sums})


def prior_day_totals(df: DataFrame, keys: list[str], day: str, sums: list[str], prefix: str = "prior_") -> DataFrame:
    """One row for each key and day, with sums over strictly earlier days."""
    days = df.groupBy(*keys, day).agg(*(F.sum(c).alias(c) for c in sums))
    return prior_sums(days, keys, [day], sums, prefix)


def ordinal(df: DataFrame, entity: str, order: list[str], day: str, cap: int, log_start: str) -> DataFrame:
    """prior_count, capped, and debut; null while the entity was there at the start of the log and is below the cap."""
    w = Window.partitionBy(entity).orderBy(*order)
    count = F.row_number().over(w) - 1
    censored = F.min(day).over(Window.partitionBy(entity)) <= F.lit(log_start).cast("date")
    known = F.when(~censored | (count >= cap), F.least(count, F.lit(cap)))
    return df.withColumn("prior_count", known).withColumn("debut", F.when(censored, F.lit(False)).otherwise(count == 0))


def prior_mean_std(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """prior_mean and prior_std (of samples, from two rows on) of strictly earlier rows."""
    w = _before(keys, order)
    std = F.when(F.count(value).over(w) > 1, F.stddev_samp(value).over(w))
    return df.withColumn("prior_mean", F.avg(value).over(w)).withColumn("prior_std", std)


def rolling_prior(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str, how: str = "mean", min_periods: int | None = None) -> DataFrame:
    """Mean or sum of the last n earlier rows; null below min_periods (half of n, one at least)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)
    least = max(1, n // 2) if min_periods is None else min_periods
    total = F.avg(value).over(w) if how == "mean" else F.sum(value).over(w)
    return df.withColumn(name, F.when(F.count(value).over(w) >= least, total))


def offset_rolling(df: DataFrame, keys: list[str], order: list[str], value: str, recent: int = 3, skip: int = 3, length: int = 7) -> DataFrame:
    """delta: mean of the last rows minus that of the length rows before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    near = F.avg(value).over(w.rowsBetween(-recent, -1))
    far = F.avg(value).over(w.rowsBetween(-(skip + length), -(skip + 1)))
    return df.withColumn("delta", near - far)


def calendar_window(df: DataFrame, keys: list[str], day: str, value: str, days: int, name: str, same_day_order: list[str] | None = None) -> DataFrame:
    """Sum of value over the last days, own day left out; with same_day_order earlier rows of the own day count too."""
    w = Window.partitionBy(*keys).orderBy(day_number(day)).rangeBetween(-days, -1)
    total = F.coalesce(F.sum(value).over(w), F.lit(0.0))
    if same_day_order:
        total = total + F.coalesce(F.sum(value).over(_before([*keys, day], same_day_order)), F.lit(0.0))
    return df.withColumn(name, total)


def recent_vs_baseline(df: DataFrame, entity: str, day: str, value: str, days: int = 30) -> DataFrame:
    """One row an entity: mean of the last days up to its latest day, and of all before."""
    last = F.max(day).over(Window.partitionBy(entity))
    near = F.datediff(last, F.col(day)) <= days
    marked = df.withColumn("_near", near)
    return marked.groupBy(entity).agg(F.avg(F.when(F.col("_near"), F.col(value))).alias("recent"), F.avg(F.when(~F.col("_near"), F.col(value))).alias("baseline"))


def recent_vs_baseline_bulk(df: DataFrame, keys: list[str], day: str, total: str, count: str, days: int = 30) -> DataFrame:
    """The same for each row, as of its day: sums and counts of days within, and before, the range."""
    w = Window.partitionBy(*keys).orderBy(day_number(day))
    near, far = w.rangeBetween(-days, -1), w.rangeBetween(Window.unboundedPreceding, -days - 1)
    mean = lambda frame: F.sum(total).over(frame) / F.nullif(F.sum(count).over(frame), F.lit(0))
    return df.withColumn("recent", mean(near)).withColumn("baseline", mean(far))


def lag_diff(df: DataFrame, keys: list[str], order: list[str], day: str, place: str) -> DataFrame:
    """days_since_prior, previous place, and shift: how far place has moved up since (0 if down or unknown)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("days_since_prior", F.datediff(F.col(day), F.lag(day).over(w))).withColumn("prior_place", F.lag(place).over(w))
    return df.withColumn("shift", F.coalesce(F.greatest(F.lit(0), F.col(place) - F.col("prior_place")), F.lit(0)))


def last_n_rate(df: DataFrame, entity: str, order: list[str], hits: str, trials: str, n: int) -> DataFrame:
    """One row an entity: rate over its last n rows."""
    w = Window.partitionBy(entity).orderBy(*(F.desc(c) for c in order))
    rows = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return rows.groupBy(entity).agg((F.sum(hits) / F.nullif(F.sum(trials), F.lit(0))).alias("rate"), F.count(F.lit(1)).alias("rows"))


def value_distribution(df: DataFrame, entity: str, order: list[str], value: str, n: int = 10, least: int | None = None) -> DataFrame:
    """Empirical distribution of the last n values (of at least least): pmf map, mean and sd (population)."""
    rows = df if least is None else df.filter(F.col(value) >= least)
    w = Window.partitionBy(entity).orderBy(*(F.desc(c) for c in order))
    last = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    counts = last.groupBy(entity, value).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy(entity))
    shares = counts.withColumn("p", F.col("_c") / total)
    return shares.groupBy(entity).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(value), F.col("p"))))).alias("pmf"),
        F.sum(F.col(value) * F.col("p")).alias("mean"),
        F.sqrt(F.greatest(F.sum(F.col(value) * F.col(value) * F.col("p")) - F.pow(F.sum(F.col(value) * F.col("p")), F.lit(2.0)), F.lit(0.0))).alias("sd"),
    )


def asof_distribution(df: DataFrame, entity: str, day: str, value: str, support: int, weight: float = 20.0, pseudo: float = 1.0) -> DataFrame:
    """Rows (entity, day, k, p): an entity's histogram of strictly earlier days, shrunk to that of all entities as of the day.

    Histograms are day aggregates on a dense 0..support spine; the league's has a
    pseudo-count of pseudo in all bins.
    """
    # Rows are counted by value first; the spine is that of days with their few distinct values.
    cells = df.groupBy(entity, day, F.least(F.col(value), F.lit(support)).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    days = cells.groupBy(entity, day).agg(F.sum("_c").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("_v").cast("int"), "_c"))).alias("_m"))
    spine = F.explode(F.sequence(F.lit(0), F.lit(support))).alias("k")
    own = days.select(entity, day, "n", "_m", spine).select(entity, day, "k", F.coalesce(F.try_element_at("_m", "k"), F.lit(0)).alias("c"), "n")
    league = own.groupBy(day, "k").agg(F.sum("c").alias("lc"), F.sum("n").alias("ln"))
    own = prior_sums(own, [entity, "k"], [day], ["c", "n"])
    league = prior_sums(league, ["k"], [day], ["lc", "ln"])
    prior = (F.col("prior_lc") + pseudo) / (F.col("prior_ln") + pseudo * (support + 1))
    joined = own.join(league.select(day, "k", prior.alias("q")), [day, "k"])
    return joined.select(entity, day, "k", ((F.col("prior_c") + weight * F.col("q")) / (F.col("prior_n") + weight)).alias("p"))


def asof_point(events: DataFrame, episode: list[str], entity: str, day: str, sums: list[str], epoch: str | None = None, strict_day: bool = False) -> DataFrame:
    """State before each episode: all rows up to its day but its own (strict_day: of earlier days only).

    events holds one row for each episode of an entity. Sums up to and with the day,
    less the own row, are the state; no row is compared with another.
    """
    keys = [entity] + ([epoch] if epoch else [])
    w = Window.partitionBy(*keys).orderBy(day_number(day)).rangeBetween(Window.unboundedPreceding, -1 if strict_day else 0)
    own = lambda c: F.lit(0) if strict_day else F.col(c)
    return events.withColumns({f"prior_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) - own(c) for c in sums})


def leave_one_out(df: DataFrame, entity: str, sums: list[str]) -> DataFrame:
    """Sums over all other rows of the entity, later ones too: a naive baseline, not an as-of state."""
    w = Window.partitionBy(entity)
    return df.withColumns({f"other_{c}": F.sum(c).over(w) - F.col(c) for c in sums})


def previous_epoch(df: DataFrame, entity: str, epoch: str, sums: list[str], prefix: str = "last_") -> DataFrame:
    """Totals by entity and epoch, with those of the epoch before (null if none)."""
    totals = df.groupBy(entity, epoch).agg(*(F.sum(c).alias(c) for c in sums))
    before = totals.select(entity, (F.col(epoch) + 1).alias(epoch), *(F.col(c).alias(f"{prefix}{c}") for c in sums))
    return totals.join(before, [entity, epoch], "left")
