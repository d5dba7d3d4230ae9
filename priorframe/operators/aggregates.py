"""Aggregates of logs: counts, profiles, mixes, splits, hazards, decompositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.functions.rates import gated_rate, ratio, safe_rate, wilson


def count_when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def sums_in_order(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums by keys under their names, added row after row in a total order: floating-point sums that come out the same however rows are dealt.

    A sum over a whole sorted group, which can spill; all rows of a group hold it, so it matters not which is taken.
    """
    whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    added = df.withColumn("_sums", F.struct(*(F.sum(c).over(whole).alias(name) for name, c in sums.items())))
    return added.groupBy(*keys).agg(F.first("_sums").alias("_sums")).select(*keys, "_sums.*")


def classify(df: DataFrame, column: str, vocabularies: dict[str, tuple[str, ...]]) -> DataFrame:
    """An int flag for each named set of values; null counts as in none."""
    return df.withColumns({name: F.coalesce(F.col(column).isin(*values), F.lit(False)).cast("int") for name, values in vocabularies.items()})


def entity_counts(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Trials and the sum of each flag, in one pass."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), *(F.sum(f).cast("long").alias(f) for f in flags))


def wide_scan(df: DataFrame, groupings: dict[str, list[str]], measures: list[str]) -> dict[str, DataFrame]:
    """For each grouping counts, sums, sums of squares and non-null counts of the measures."""
    stats = [x for m in measures for x in (F.sum(m).alias(f"{m}_sum"), F.sum(F.col(m) * F.col(m)).alias(f"{m}_sq"), F.count(m).alias(f"{m}_n"))]
    return {name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *stats) for name, keys in groupings.items()}


def usage_mix(df: DataFrame, entity: str, kind: str, attempts: Column, hits: Column) -> DataFrame:
    """mix: map of kind to (usage, hit rate, count). Rows without a kind are in the total but not in the map."""
    by_kind = df.groupBy(entity, kind).agg(F.count(F.lit(1)).alias("n"), count_when(attempts).alias("a"), count_when(hits).alias("h"))
    total = F.sum("n").over(Window.partitionBy(entity))
    rows = by_kind.withColumn("usage", F.col("n") / total).withColumn("rate", safe_rate("h", "a", 0.0))
    entry = F.when(F.col(kind).isNotNull(), F.struct(F.col(kind), F.struct(F.col("usage"), F.col("rate"), F.col("n"))))
    return rows.groupBy(entity).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("mix"),
        count_when(F.col(kind).isNotNull() & (F.col("usage") >= 0.1)).alias("breadth"),
        F.sum(F.when(F.col(kind).isNotNull(), F.col("usage") * F.col("rate"))).alias("weighted_rate"),
    )


def rate_by_split(df: DataFrame, entity: str, split: str, levels: list[str], hit: str, least: int) -> DataFrame:
    """A gated rate for each level of a split."""
    sums = [x for v in levels for x in (F.sum(F.when(F.col(split) == v, F.col(hit))).alias(f"_h{v}"), count_when(F.col(split) == v).alias(f"_n{v}"))]
    rows = df.groupBy(entity).agg(*sums)
    return rows.select(entity, *(gated_rate(f"_h{v}", f"_n{v}", least).alias(f"rate_{v}") for v in levels))


def relief_load(df: DataFrame, team: list[str], day: str, actor: str, order: str) -> DataFrame:
    """Rows and distinct actors of a team-day other than its first actor."""
    first = df.groupBy(*team, day).agg(F.min_by(actor, order).alias("_first"))
    rest = df.join(first, [*team, day]).filter(F.col(actor) != F.col("_first"))
    return rest.groupBy(*team, day).agg(F.count(F.lit(1)).alias("load"), F.countDistinct(actor).alias("actors"))


def hazard_table(starts: DataFrame, value: str, epoch: str, top: int) -> DataFrame:
    """At risk, stopped and hazard with Wilson bounds at each k from 0 to top, for all epochs and each."""
    counts = starts.select(F.least(F.col(value), F.lit(top)).alias("k"), F.col(epoch).alias("epoch")).groupingSets([["k"], ["k", "epoch"]], "k", "epoch").agg(F.count(F.lit(1)).alias("stopped"), F.grouping("epoch").alias("_all"))
    names = counts.withColumn("epoch", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("epoch").cast("string")))
    spine = names.select("epoch").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(top))))
    rows = spine.join(names, ["epoch", "k"], "left").withColumn("stopped", F.coalesce("stopped", F.lit(0)))
    risk = F.sum("stopped").over(Window.partitionBy("epoch").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at_risk", risk)
    low, high = wilson("stopped", "at_risk")
    return rows.select("epoch", "k", "at_risk", "stopped", safe_rate("stopped", "at_risk").alias("hazard"), low.alias("low"), high.alias("high"))


def boundary_hazard(starts: DataFrame, value: str, epoch: str, parts: int, size: int) -> DataFrame:
    """P(stopped | completed j parts) by epoch, and the z of its change against the epoch before."""
    rows = starts.select(F.col(epoch).alias("epoch"), F.col(value).alias("v"), F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("j"))
    rows = rows.filter(F.col("v") >= F.col("j") * size)
    table = rows.groupBy("epoch", "j").agg(F.count(F.lit(1)).alias("n"), count_when(F.col("v") == F.col("j") * size).alias("pulled"))
    before = table.select((F.col("epoch") + 1).alias("epoch"), "j", F.col("n").alias("n0"), F.col("pulled").alias("p0"))
    both = table.join(before, ["epoch", "j"], "left")
    pooled = (F.col("pulled") + F.col("p0")) / (F.col("n") + F.col("n0"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("n0")))
    return both.select("epoch", "j", "n", "pulled", (F.col("pulled") / F.col("n")).alias("rate"), F.when(se > 0, (F.col("pulled") / F.col("n") - F.col("p0") / F.col("n0")) / se).alias("z"))


def variance_components(rows: DataFrame, entity: str, n: str, s: str) -> DataFrame:
    """One row: Bernoulli, rate, count and covariance parts of the variance of s, and its split between and within entities."""
    rate = F.col(s) / F.col(n)
    x = rows.withColumn("_p", rate)
    overall = x.agg(
        F.avg(F.col(n) * F.col("_p") * (1 - F.col("_p"))).alias("bernoulli"), (F.var_samp("_p") * F.avg(F.col(n) * F.col(n))).alias("rate_part"),
        (F.var_samp(n) * F.avg("_p") * F.avg("_p")).alias("count_part"), (2 * F.avg(n) * F.avg("_p") * F.covar_samp(n, "_p")).alias("covariance"), F.var_samp(s).alias("empirical"),
    )
    groups = x.groupBy(entity).agg(F.avg(s).alias("_m"), F.var_samp(s).alias("_v"))
    return overall.crossJoin(groups.agg(F.var_samp("_m").alias("between"), F.avg("_v").alias("within")))


def ceiling(rows: DataFrame, entity: str, value: str, least: int) -> DataFrame:
    """One row: sd within entities of at least least rows, mean absolute error and P(abs(error) <= 3) of a normal with it."""
    from priorframe.functions.special import normal_cdf

    w = Window.partitionBy(entity)
    x = rows.withColumn("_n", F.count(value).over(w)).withColumn("_d", F.col(value) - F.avg(value).over(w)).filter(F.col("_n") >= least)
    sd = x.agg(F.sqrt(F.var_samp("_d")).alias("sd"), F.count(F.lit(1)).alias("n"))
    return sd.select("n", "sd", (F.col("sd") * F.sqrt(F.lit(2 / 3.141592653589793))).alias("mae"), (2 * normal_cdf(3 / F.col("sd")) - 1).alias("within3"))


def weighted_cover_mean(df: DataFrame, keys: list[str], value: str, weight: str, least: float = 0.5, order: list[str] | None = None) -> DataFrame:
    """Weighted mean over rows with a value; null where they cover less than least of the weight, not a number where the covered weight is zero as all weight is.

    order: a total order of rows to add in, so that a cover of just least, or a mean at an edge of rounding, doesn't hang on how rows are dealt.
    """
    sums = {"_covered": F.when(F.col(value).isNotNull(), F.col(weight)), "_all": F.col(weight), "_top": F.col(value) * F.col(weight)}
    if order is None:
        added = df.groupBy(*keys).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    else:
        added = sums_in_order(df, keys, order, sums)
    return added.select(*keys, F.when(ratio("_covered", "_all") >= least, ratio("_top", "_covered")).alias("mean"))


def mix_tvd(recent: DataFrame, season: DataFrame, entity: str, kind: str, share: str, least: float = 0.9) -> DataFrame:
    """Half the sum of absolute differences of shares; null where the recent shares cover less than least."""
    a, b = recent.select(entity, kind, F.col(share).alias("_a")), season.select(entity, kind, F.col(share).alias("_b"))
    both = a.join(b, [entity, kind], "full_outer").na.fill(0.0, ["_a", "_b"])
    return both.groupBy(entity).agg(F.when(F.sum("_a") >= least - 1e-9, F.sum(F.abs(F.col("_a") - F.col("_b"))) / 2).alias("tvd"))


def tto_ratios(df: DataFrame, entity: str, bucket: str, hit: str, least_entity: int, least_cell: int) -> DataFrame:
    """Ratio of a bucket's rate to the entity's own, weighted by trials."""
    own = df.groupBy(entity).agg(F.avg(hit).alias("_r"), F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= least_entity) & (F.col("_r") > 0))
    cells = df.groupBy(entity, bucket).agg(F.avg(hit).alias("_c"), F.count(F.lit(1)).alias("_w")).filter(F.col("_w") >= least_cell)
    both = cells.join(own, entity)
    return both.groupBy(bucket).agg((F.sum(F.col("_c") / F.col("_r") * F.col("_w")) / F.sum("_w")).alias("ratio"), F.sum("_w").alias("trials"))


def calls_over_expected(df: DataFrame, entity: str, epoch: str, order: list[str], bins: list[str], taken: str, called: str, frozen: DataFrame, weight: float) -> DataFrame:
    """Prior (called - expected) / (taken + weight), expected from a frozen rate by bins; null below a third of weight."""
    w = Window.partitionBy(entity, epoch, *bins).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    prior = df.withColumn("_t", F.coalesce(F.sum(taken).over(w), F.lit(0))).withColumn("_c", F.coalesce(F.sum(called).over(w), F.lit(0)))
    joined = prior.join(frozen, bins, "left")
    total = F.sum("_t")
    value = (F.sum("_c") - F.sum(F.col("_t") * F.col("p"))) / (total + weight)
    return joined.groupBy(entity, epoch, *order).agg(F.when(total >= weight / 3, value).alias("csoe"))
