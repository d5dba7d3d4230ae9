"""Data-quality checks as reports: check, status, n, sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def report(df: DataFrame, check: str, bad: Column, key: str, sample: int = 5) -> DataFrame:
    """One row: rows that are bad, and the least few of their keys."""
    out = df.agg(F.count_if(bad).alias("n"), F.count(F.lit(1)).alias("rows"))
    some = df.filter(bad).select(F.col(key).cast("string").alias("k")).orderBy("k").limit(sample).agg(F.sort_array(F.collect_list("k")).alias("sample"))
    return out.crossJoin(some).select(F.lit(check).alias("check"), F.when(F.col("n") == 0, "ok").otherwise("fail").alias("status"), "n", "rows", "sample")


def monotonic(current: DataFrame, high_water: int) -> DataFrame:
    n = current.agg(F.count(F.lit(1)).alias("rows"))
    return n.select(F.lit("ledger_monotonic").alias("check"), F.when(F.col("rows") >= high_water, "ok").otherwise("fail").alias("status"), F.greatest(F.lit(high_water) - F.col("rows"), F.lit(0)).alias("n"), "rows", F.array().cast("array<string>").alias("sample"))


def coverage(days: DataFrame, covered: DataFrame, day: str, as_of: str, lag_days: int) -> DataFrame:
    """Days with a board but no evidence, older than the lag."""
    old = days.select(day).distinct().filter(F.datediff(F.lit(as_of).cast("date"), F.col(day)) > lag_days)
    return old.join(covered.select(day).distinct(), day, "left_anti")


def day_spine(first: str, last: str, like: DataFrame) -> DataFrame:
    return like.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))


def freshness(events: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """Each day of a range with its rows: absent or real."""
    n = events.groupBy(F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    return day_spine(first, last, events).join(n, "day", "left").select("day", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.when(F.col("rows").isNull(), "absent").otherwise("real").alias("status"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two sources by key: confirmed, disagree, or unknown where one is silent."""
    x, y = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    verdict = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown").when(F.col("_a") == F.col("_b"), "confirmed").otherwise("disagree")
    return x.join(y, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def union_reports(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)
