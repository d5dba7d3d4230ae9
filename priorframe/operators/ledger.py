"""Append-mostly ledgers: upserts that never shrink, locks, journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filled(columns: list[str]) -> Column:
    """How many columns are neither null nor empty."""
    return sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0))


def ledger_upsert(old: DataFrame, new: DataFrame, keys: list[str], final: str, updated: str) -> DataFrame:
    """Union of two versions by key: a final row beats one that isn't, then the later, then the fuller, then the old one.

    Columns of either side are kept (headers grow). Every key of both is in the result.
    """
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    values = [c for c in both.columns if c not in (*keys, "_side")]
    order = [F.desc(F.col(final).isNotNull()), F.desc_nulls_last(updated), F.desc(filled(values)), F.asc("_side")]
    return both.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn", "_side")


def evidence_upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones by key; the rest of old stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def refuse_to_shrink(old: DataFrame, merged: DataFrame) -> DataFrame:
    """merged, or an error if it has fewer rows than old."""
    before, after = old.count(), merged.count()
    if after < before:
        raise ValueError(f"a merge would shrink the table from {before} to {after} rows")
    return merged


def lock_guard(ledger: DataFrame, final: Column, slate_end: str, created: str, as_of: str) -> DataFrame:
    """locked: final, or a day past the slate's end, or created more than half a day ago."""
    now = F.lit(as_of).cast("timestamp")
    hours = lambda c: (F.unix_seconds(now) - F.unix_seconds(F.col(c).cast("timestamp"))) / 3600
    return ledger.withColumn("locked", F.coalesce(final, F.lit(False)) | F.coalesce(hours(slate_end) > 24, F.lit(False)) | F.coalesce(hours(created) > 12, F.lit(False)))


def change_journal(old: DataFrame, new: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys whose label differs between two versions, with both labels."""
    a = old.select(*keys, F.col(label).alias("old_label"))
    b = new.select(*keys, F.col(label).alias("new_label"))
    return a.join(b, keys).filter(~F.col("old_label").eqNullSafe(F.col("new_label")))


def carry_over(prior: DataFrame, fresh: DataFrame, keys: list[str], reconstructed: Column | None = None) -> DataFrame:
    """fresh, and the rows of prior whose key it lacks (unless prior was reconstructed)."""
    old = prior if reconstructed is None else prior.filter(~reconstructed)
    return fresh.unionByName(old.join(fresh.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def fill_by_precedence(primary: DataFrame, secondary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Primary's value, else secondary's, and the source it is from; never the other way round."""
    a, b = primary.select(*keys, F.col(value).alias("_a")), secondary.select(*keys, F.col(value).alias("_b"))
    source = F.when(F.col("_a").isNotNull(), "primary").when(F.col("_b").isNotNull(), "secondary")
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("_a", "_b").alias(value), source.alias("source"))


def live_override(ledger: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Settled outcomes over live rows: final, and stale where the live row had not ended."""
    x = ledger.select(*keys, F.col("outcome").alias("_settled"))
    rows = live.join(x, keys, "left")
    settled = F.col("_settled").isNotNull()
    return rows.withColumn("stale_poll", settled & ~F.col("final")).withColumn("final", F.col("final") | settled).withColumn("value", F.coalesce("_settled", "value")).drop("_settled")
