"""Episodes rebuilt from rows: units, order, state changes, starters, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def collapse_units(df: DataFrame, unit: list[str], order: Column, first: list[str], last: list[str], top: list[str] = (), count: str = "rows") -> DataFrame:
    """One row a unit: first and last values in an order (nulls are passed over), maxima, number of rows."""
    known = lambda c: F.when(F.col(c).isNotNull(), order)
    return df.groupBy(*unit).agg(
        *(F.min_by(c, known(c)).alias(f"first_{c}") for c in first), *(F.max_by(c, known(c)).alias(f"last_{c}") for c in last),
        *(F.max(c).alias(f"max_{c}") for c in top), F.count(F.lit(1)).alias(count),
    )


def lead_diff(df: DataFrame, keys: list[str], order: list[str], state: str, total: int, ended: str | None = None, name: str = "gained") -> DataFrame:
    """What a state counter gains until the next row; the last row of a group gains what is missing to total.

    ended: column that marks last rows at which the episode stopped, which gain nothing.
    """
    ahead = F.lead(state).over(Window.partitionBy(*keys).orderBy(*order))
    gain = F.greatest(F.lit(0), F.least(F.lit(total), F.when(ahead.isNull(), total - F.col(state)).otherwise(ahead - F.col(state))))
    if ended:
        gain = F.when(ahead.isNull() & F.col(ended), 0).otherwise(gain)
    return df.withColumn(name, gain.cast("int"))


def walkoff(ahead_after: Column, scored: Column, needs_score: bool) -> Column:
    """Whether an episode stops at a row: the side is ahead after it, and (needs_score) scored on it."""
    return ahead_after & scored if needs_score else ahead_after


def reattribute(df: DataFrame, keys: list[str], order: list[str], actor: str, count: str, keep: int, own: Column, name: str = "settled") -> DataFrame:
    """Moves what exceeds keep to the next row where the actor changes there, unless own says that it stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    after = F.lead(actor).over(w)
    moved = F.when(after.isNotNull() & (after != F.col(actor)) & (F.col(count) > keep) & ~own, F.col(count) - keep).otherwise(0)
    df = df.withColumn("_moved", moved)
    return df.withColumn(name, F.col(count) - F.col("_moved") + F.coalesce(F.lag("_moved").over(w), F.lit(0))).drop("_moved")


def sequence_buckets(df: DataFrame, keys: list[str], order: list[str], edges: tuple[int, ...] = (9, 18, 27)) -> DataFrame:
    """seq from 1 in each group, and the bucket (from 1) of edges that it falls in."""
    seq = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    df = df.withColumn("seq", seq)
    return df.withColumn("bucket", sum((F.when(F.col("seq") > e, 1).otherwise(0) for e in edges), F.lit(1)).cast("int"))


def first_n_distinct(df: DataFrame, keys: list[str], member: str, order: str, n: int) -> DataFrame:
    """The first n distinct members of each group, with their place."""
    first = df.groupBy(*keys, member).agg(F.min(order).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", member))
    return first.withColumn("place", place).filter(F.col("place") <= n)


def starter(df: DataFrame, keys: list[str], actor: str, order: str) -> DataFrame:
    """The actor of the first row of each group."""
    return df.groupBy(*keys).agg(F.min_by(actor, order).alias("starter"))


def consecutive_run(df: DataFrame, keys: list[str], order: list[str], home: str) -> DataFrame:
    """run: rows since the last home row, 0 on it."""
    island = F.sum(home).over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("_island", island)
    run = F.sum(1 - F.col(home)).over(Window.partitionBy(*keys, "_island").orderBy(*order))
    return rows.withColumn("run", run).drop("_island")


def later_same_day(df: DataFrame, episode: str, teams: list[str], day: str) -> DataFrame:
    """A row for each team of an episode; later: not the team's first of the day."""
    rows = df.select(day, episode, F.explode(F.array_distinct(F.array(*teams))).alias("team"))
    return rows.withColumn("later", F.row_number().over(Window.partitionBy("team", day).orderBy(episode)) > 1)


def dominant_partner(df: DataFrame, keys: list[str], partner: str, top: int = 1) -> DataFrame:
    """The partners with most rows of each group (of equal counts the least), with their counts."""
    counts = df.groupBy(*keys, partner).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), partner))
    return counts.withColumn("place", place).filter(F.col("place") <= top)
