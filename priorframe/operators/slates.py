"""Whether actors and days are settled, from tables as they stand; ``streaming.stateful`` has the same as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def appearances(rows: DataFrame, group: list[str], actor: str, order: str) -> DataFrame:
    """group, actor, place, actors: the order in which a group's actors first appear, and how many there are."""
    first = rows.groupBy(*group, actor).agg(F.min(order).alias("_first"))
    whole = Window.partitionBy(*group)
    return first.select(*group, actor, F.row_number().over(whole.orderBy("_first", actor)).alias("place"), F.count(F.lit(1)).over(whole).alias("actors"))


def settled_flag(rows: DataFrame, order: DataFrame, group: list[str], actor: str, terminal: str) -> DataFrame:
    """appeared, settled: a later actor has appeared or the state is terminal; who has not appeared has not left.

    order is that of appearances; its key is finer than the group, which may hold many rows.
    """
    out = rows.join(order, [*group, actor], "left").withColumn("appeared", F.col("place").isNotNull())
    return out.withColumn("settled", F.col(terminal) | F.coalesce(F.col("place") < F.col("actors"), F.lit(False)))


def late_days(rows: DataFrame, day: str, as_of: str, days: int = 2) -> DataFrame:
    """Days with their rows; a day is final once it is days old and not empty."""
    n = rows.groupBy(day).agg(F.count(F.lit(1)).alias("rows"))
    return n.withColumn("is_final", (F.datediff(F.lit(as_of).cast("date"), F.col(day)) >= days) & (F.col("rows") > 0))


def carried_keys(rows: DataFrame, day: str, final: str, as_of: str, cutoff_hour: int) -> DataFrame:
    """Days that still take updates at as_of: its own, and the day before until all its keys are final or the hour has come."""
    now = F.lit(as_of).cast("timestamp")
    age = F.datediff(F.to_date(now), F.col(day))
    open_ = rows.groupBy(day).agg(F.bool_and(final).alias("done"))
    return open_.withColumn("active", (age == 0) | ((age == 1) & ~F.col("done") & (F.hour(now) < cutoff_hour)))
