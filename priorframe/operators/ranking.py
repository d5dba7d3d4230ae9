"""Global ranks without a global window, bins of equal count, top-k, dedup."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from priorframe.sources.work import materialize

def ranked(df: DataFrame, value: str, tie: list[str], name: str = "rank") -> tuple[DataFrame, int]:
    """df with its rank from 0 by value (nulls first) and tie, which must be a total order, and the number of rows.

    Rows are dealt by ranges of value and tie together, so that a value on half of all
    rows is many ranges, sorted range by range and written with their place: the
    number of the range and the row's within it. What is left is to add the rows of the
    ranges before, of which there are as many as shuffle partitions.
    """
    order = [F.col(f"`{c}`") for c in (value, *tie)]
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_place", 33)
    counts = {r["_part"]: r["count"] for r in placed.groupBy(part.alias("_part")).count().collect()}
    shift, before = [], 0
    for k in sorted(counts):
        shift.append((k, before))
        before += counts[k]
    # One row a range: its size is that of the shuffle, whatever the table's.
    offsets = F.broadcast(df.sparkSession.createDataFrame(shift, "_part long, _before long"))
    at = F.col("_place").bitwiseAND((1 << 33) - 1) + F.col("_before")
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(name, at).drop("_part", "_place", "_before"), before


def global_rank(df: DataFrame, value: str, tie: list[str], name: str = "rank") -> DataFrame:
    """Rank from 0 over all rows; see ranked."""
    return ranked(df, value, tie, name)[0]


def between(low: float, high: float, share: float) -> float:
    """low * (1 - share) + high * share, its sum rounded once, as the SQL has it: of neighbours in the last bit another formula gives the other one."""
    if share == 0 or low == high:
        return low
    finite = math.isfinite(low) and math.isfinite(high)
    return math.fma(low, 1 - share, high * share) if finite else low * (1 - share) + high * share


def exact_quantiles(df: DataFrame, value: str, tie: list[str], shares: list[float]) -> list[float]:
    """Interpolated quantiles of the values that are not null: two rows of a ranked table for each, none if there are no values."""
    rows, n = ranked(df.filter(F.col(value).isNotNull()).select(value, *(t for t in tie if t != value)), value, tie, "_rank")
    if not n:
        return []
    at = [q * (n - 1) for q in shares]
    wanted = sorted({int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at})
    found = {r["_rank"]: float(r[value]) for r in rows.filter(F.col("_rank").isin(wanted)).select("_rank", value).collect()}
    return [between(found[int(x)], found[min(int(x) + 1, n - 1)], x - int(x)) for x in at]


def equal_count_bins(df: DataFrame, value: str, tie: list[str], bins: int, rule: str = "round", name: str = "bin") -> DataFrame:
    """Bins of nearly equal count of rows in the order of value.

    rule: ``round`` has edges at round(i * n / bins), halves to even; ``floor`` at
    int(i * n / bins); ``chunk`` has chunks of max(1, n // bins) rows and a tail;
    ``quantile`` has edges at interpolated quantiles of value, the lowest included.
    """
    if rule == "quantile":
        # Edges and rows have to be of one reading: a value that is made again may differ in its last bit.
        df = materialize(df, "binned")
        edges = exact_quantiles(df, value, tie, [i / bins for i in range(1, bins)])
        return df.withColumn(name, sum((F.when(F.col(value) > e, 1).otherwise(0) for e in edges), F.lit(0)))
    rows, n = ranked(df, value, tie, "_rank")
    if rule == "chunk":
        return rows.withColumn(name, F.floor(F.col("_rank") / max(1, n // bins)).cast("int")).drop("_rank")
    edge = {"round": lambda i: round(i * n / bins), "floor": lambda i: i * n // bins}[rule]
    at = sum((F.when(F.col("_rank") >= edge(i), 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return rows.withColumn(name, at).drop("_rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in a total order: a maximum, which is combined before the shuffle."""
    last = F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(last.alias("_row")).select("_row.*")
